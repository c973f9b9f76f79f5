"""Every live variant of a site is a target, however many there are; regions are scored from the first three."""

import duckdb
import pytest

from sightline.plans.relations import BASE, build, duckdb_sql
from sightline.queries import base_tables

WORDS = "Plain words that say what the tools are good for. " * 20
REGIONS = "us gb in fr de es it jp cn br ca au mx nl se kr sg ae za nz".split()
#: As a site's codes go, those behind the fortieth have no region or one that sorts before others.
PATHS = [f"{a}-{b}" for a in ("en", "fr") for b in REGIONS] + ["zu", "zz", "zh-ae", "zh-za"]
LANGS = [f"{a}-{b}" for a in ("en", "fr", "zu") for b in REGIONS]


def page(body, head=""):
    return f"<html lang=en><head><title>Acme Tools for all workshops</title>{head}</head><body><h1>Acme</h1>{body}<p>{WORDS}</p></body></html>"


@pytest.fixture(scope="module")
def tables(spark, sf):
    alternates = "".join(f'<link rel="alternate" hreflang="{c}" href="https://langs.example/{c}/">' for c in LANGS)
    alternates += '<link rel="alternate" hreflang="x-default" href="/"><link rel="alternate" hreflang="de" href="/en-us">'  # the site itself, and an address that another code has
    rows = [
        ("https://langs.example/", page("", alternates)), ("https://langs.example/en-gb/", page("", "")),
        ("https://paths.example/", page("".join(f'<a href="/{c}/">{c}</a>' for c in PATHS[::2]))), ("https://paths.example/more", page("".join(f'<a href="/{c}/">{c}</a>' for c in PATHS[1::2]))),
        ("https://few.example/", page('<a href="/fr/">fr</a><a href="/de/">de</a>')),
    ]
    return base_tables(spark, sf) | {"pages": spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")}


def test_every_live_variant_is_a_target(spark, tables):
    rows = {}
    for r in build(spark, "region_targets", tables).orderBy("site", "k").collect():
        rows.setdefault(r.site, []).append(r)
    found = {s: [r.prefix.rpartition("/")[2] for r in rows[s]] for s in ("langs.example", "paths.example", "few.example")}
    region = lambda c: c.partition("-")[2]
    assert found["langs.example"][0] == "en-us" and sorted(found["langs.example"]) == sorted(LANGS)
    assert found["langs.example"][1:] == sorted(set(LANGS) - {"en-us"}, key=lambda c: (region(c), c))
    assert found["paths.example"][:40] == sorted(PATHS[:40], key=lambda c: (region(c), c)) and found["paths.example"][40:] == ["zu", "zz", "zh-ae", "zh-za"]
    assert sorted(found["few.example"]) == ["de", "fr"]
    for site in found:
        assert [(r.k, r.audited) for r in rows[site]] == [(k, f"~{k}.{site}") for k in range(1, len(rows[site]) + 1)]


def test_targets_keep_the_names_that_regions_are_scored_by(spark, tables):
    made = {}
    targets = {(r.site, r.variant): r for r in build(spark, "region_targets", tables, None, made).collect()}
    places = {(r.site, r.variant, r.place): r for r in build(spark, "region_places", tables, None, made).collect()}
    scored = build(spark, "region_scopes", tables, None, made).collect()
    assert sum(r.site in ("langs.example", "paths.example") for r in scored) == 6
    assert {(r.site, r.scope, r.prefix) for r in scored} == {(r.site, r.audited, r.prefix) for r in targets.values() if r.is_scope and r.k <= 3}
    late = [r for r in targets.values() if (r.site, r.variant, r.place) not in places]
    assert {(r.site, r.place) for r in late} == {("paths.example", k) for k in (41, 42, 43, 44)}


def test_targets_are_those_of_the_sql(spark, tables, sf, tmp_path):
    tables["pages"].write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')" if t == "pages" else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("region_targets", "region_sample"):
        out, other = build(spark, name, tables), con.sql(duckdb_sql(name))
        assert out.columns == other.columns
        assert sorted(map(tuple, out.collect())) == sorted(other.fetchall())
