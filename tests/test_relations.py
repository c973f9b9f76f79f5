"""Every registered relation gives the same rows in Spark and in DuckDB."""

import decimal
import math

import duckdb
import pytest

from sightline.plans.oracle import by_hand
from sightline.plans.relations import BASE, RELATIONS, Settings, build, duckdb_sql
from sightline.queries import NAMES, base_tables

MADE: dict = {}


def normal(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, sf, name):
    out = build(spark, name, base_tables(spark, sf), None, MADE)
    other = duck.sql(duckdb_sql(name))
    assert out.columns == other.columns
    assert sorted(normal(list(r)) for r in out.collect()) == sorted(normal(list(r)) for r in other.fetchall())


@pytest.mark.parametrize("settings", [Settings(), Settings("strict", 6)])
def test_sql_written_by_hand_gives_the_same_rows(spark, duck, sf, settings):
    made = MADE if settings == Settings() else {}
    for name, sql in by_hand(settings).items():
        out, other = build(spark, name, base_tables(spark, sf), settings, made), duck.sql(sql)
        assert sorted(out.columns) == sorted(other.columns), name
        assert sorted(normal([r[c] for c in sorted(out.columns)]) for r in out.collect()) == sorted(normal([dict(zip(other.columns, r))[c] for c in sorted(out.columns)]) for r in other.fetchall()), name


@pytest.mark.parametrize("settings", [Settings("strict", 6, "domain"), Settings("lenient", 3)])
def test_settings_reach_both_engines(spark, duck, sf, settings):
    out = build(spark, "score_every_site", base_tables(spark, sf), settings)
    assert sorted(normal(list(r)) for r in out.collect()) == sorted(normal(list(r)) for r in duck.sql(duckdb_sql("score_every_site", settings)).fetchall())


def test_unknown_settings_are_refused():
    for bad in (Settings("odd"), Settings(scope="planet")):
        with pytest.raises(ValueError):
            bad.values()


def test_every_relation_reads_known_relations():
    for r in RELATIONS.values():
        assert all(i in RELATIONS or i in BASE for i in r.inputs), r.name


def test_sample_is_taken_before_html_is_read(spark, sf):
    plan = build(spark, "site_pages", base_tables(spark, sf), None, {k: v for k, v in MADE.items() if k != "site_pages"} | {})
    assert "html" not in plan.columns
