"""Labelled sites, invariants, settings, exports and the stream."""

import json
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from sightline.audit import audit
from sightline.functions import urls
from sightline.sources import sinks
from sightline.streaming.incremental import follow

ORG = '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"Acme Tools","url":"https://clean.example/","sameAs":["https://www.linkedin.com/company/acme"]},{"@type":"WebSite","name":"Acme Tools"}]}</script>'
NAV = '<nav><a href="/">Home</a><a href="/about">About</a><a href="/products/x">Products</a><a href="/contact">Contact us</a><a href="https://www.linkedin.com/company/acme">LinkedIn</a></nav>'
WORDS = "Plain words that say what the tools of Acme are good for, for anyone who reads them. " * 12


def page(title, body, head="", lang=' lang="en"'):
    return f'<!DOCTYPE html><html{lang}><head><title>{title}</title><meta name="viewport" content="width=device-width"><meta name="description" content="What Acme makes and sells.">{head}</head><body>{NAV}<h1>{title}</h1><p>{body}</p><footer>&copy; 2025 Acme Tools</footer></body></html>'


SITES = {
    "clean.example": {
        "/": page("Acme Tools for workshops", WORDS, ORG), "/about": page("About Acme Tools and its people", WORDS), "/contact": page("Contact Acme Tools by mail", WORDS),
        "/products/x": page("The X hammer by Acme Tools", WORDS, '<script type="application/ld+json">{"@type":"Product","name":"X","offers":{"price":"5","priceCurrency":"USD"}}</script>'),
    },
    "spa.example": {"/": '<html lang="en"><head><title>An app that loads later</title></head><body><div id="root"></div><noscript>You need to enable JavaScript</noscript><noscript>JavaScript is required</noscript></body></html>'},
    "shop.example": {"/": page("Buy our fine things here", "Only $19 today. Add to cart now. " + WORDS)},
    "blocked.example": {"/": page("Acme Tools for workshops", WORDS, ORG)},
    "stale.example": {"/": page("Old news of the village", WORDS).replace("2025", "2016"), "/blog/post": page("A post without a date", "5 min read. " + WORDS).replace("2025", "2016")},
    "contrary.example": {"/": page("Acme Tools for workshops", "Founded in 2016. " + WORDS, ORG), "/about": page("About Acme Tools and us", WORDS, '<script type="application/ld+json">{"@type":"Organization","name":"Acme","foundingDate":"2014-01-01"}</script>')},
    "hidden.example": {"/": page("Acme Tools for workshops", WORDS, '<meta name="robots" content="noindex, nofollow">')},
    "french.example": {"/": page("Outils pour tous les ateliers", "Des mots simples et utiles. " * 40, lang=' lang="fr"').replace("Contact us", "Nous joindre").replace("/products/x", "/panier")},
}


@pytest.fixture(scope="module")
def run(spark):
    rows = [(i, f"https://{site}{path}", html) for i, (site, path, html) in enumerate((s, p, h) for s, pages in SITES.items() for p, h in pages.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    robots = spark.createDataFrame([(s, "User-agent: PerplexityBot\nDisallow: /" if s == "blocked.example" else "User-agent: *\nAllow: /\nSitemap: /s.xml") for s in SITES], "site string, body string")
    return audit(pages, robots=robots, as_of="2025-06-01")


def found(run, site):
    return {(r.check_id, r.category) for r in run.table("findings").where(F.col("site") == site).collect()}


def test_labelled_sites(run):
    want = {"spa.example": "js-render-gap", "shop.example": "structured-data", "blocked.example": "crawlability", "stale.example": "freshness", "contrary.example": "entity-identity", "hidden.example": "indexability"}
    for site, category in want.items():
        assert category in {c for _, c in found(run, site)}, site
    severe = run.table("findings").where("site = 'clean.example' and severity in ('critical', 'high')").collect()
    assert not severe
    french = {k for k, _ in found(run, "french.example")}
    assert not french & {"G2", "C8", "C9", "C10", "C13", "E4"}


def test_rules_of_single_sites(run):
    ids = {s: {k for k, _ in found(run, s)} for s in SITES}
    assert {"C13", "C15", "G3", "E6", "D1"} <= ids["spa.example"]
    assert "D4" in ids["shop.example"] and "C1" in ids["blocked.example"] and "C6" in ids["hidden.example"]
    assert {"F1", "F3", "D5"} <= ids["stale.example"] and "H1" in ids["contrary.example"]
    assert "C16" in ids["blocked.example"] and "C16" not in ids["clean.example"]


def test_invariants(run):
    for r in run.table("projection").collect():
        assert 0 <= r.current <= r.after_quick_wins <= 100
    scores = {r.site: r for r in run.table("score_every_site").collect()}
    assert set(scores) == set(SITES) and all(0 <= r.value <= 100 for r in scores.values())
    quadrants = {r.site: r.quick_win + r.major_project + r.fill_in + r.low_priority for r in run.table("quadrant_counts").collect()}
    assert all(quadrants[s] == r.total for s, r in scores.items() if r.total)
    for site in SITES:
        ids = sorted(r.id for r in run.table("findings").where(F.col("site") == site).collect())
        assert ids == [f"F-{i + 1:03d}" for i in range(len(ids))]
    assert scores["clean.example"].value > scores["spa.example"].value and scores["spa.example"].provisional
    assert run.table("report_violations").count() == 0


def test_groups_profiles_and_own_rules(spark, run):
    pages = run.tables["crawl"]
    only = audit(pages, skills=["freshness-corroboration-audit"]).table("findings").select("check_id").distinct().collect()
    assert {r.check_id[0] for r in only} <= {"F", "R"} and only
    hits = pages.selectExpr("regexp_extract(url, '//([^/]*)', 1) as site", "'Z1' as check_id", "1 as n").distinct()
    check = spark.createDataFrame([("Z1", "critical", "high", "engagement", "mobile", "Own rule")], "check_id string, severity string, confidence string, dimension string, category string, title string")
    own = audit(pages, extra_hits=hits, extra_checks=check).table("findings").where("check_id = 'Z1'")
    assert own.count() == len(SITES) and own.first().penalty == 35
    with pytest.raises(ValueError):
        audit(pages, nonsense=pages)
    with pytest.raises(ValueError):
        run.table("nonsense")


def test_empty_and_odd_pages(spark):
    empty = audit(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.table("score_every_site").count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "https://a.example/", None), (3, "https://a.example/b", ""), (4, "not a url", "<p>x"), (4, "not a url", "<p>x")], "page_id long, url string, html string")
    assert audit(odd.fillna({"html": ""})).table("score_every_site").count() == 2


HREFS = ["/x", "x", "./x", "../x", "../../x", "?q=1", "#f", "", "//other.org/p", "https://o.org", "http://o.org?x=1", "mailto:a@b.c", "a b", "tel:1", "/a/../b", "/a/./b", "../../../../z", "x/y?z=1#w", "javascript:void(0)", "https://o.org/a/b/../c"]


@pytest.mark.parametrize("base", ["https://s.org/d/e/f.html?q#t", "https://s.org", "http://www.s.org:8080/d/"])
def test_link_resolution(spark, base):
    def want(href):
        u = urljoin(base, href).replace(" ", "%20")
        p = urlsplit(u)
        return f"{p.scheme}://{p.netloc}{p.path or '/'}" + (f"?{p.query}" if p.query else "") if p.scheme in ("http", "https") else None

    step = lambda e: F.expr(e.replace("$back1$", "$1").replace("$back2$", "$2"))
    rows = spark.createDataFrame([(h, base) for h in HREFS], "href string, base string").withColumn("h", step(urls.clean_href("href")))
    rows = rows.withColumn("whole", step(urls.joined("h", "base"))).select("href", step(urls.folded("whole", "h")).alias("u")).collect()
    assert {r.href: r.u for r in rows} == {h: want(h) for h in HREFS}


def test_url_parts(spark):
    def value(make, url):
        return spark.sql("SELECT " + make(":u").replace("$deep_path_segments$", "3"), args={"u": url}).first()[0]

    assert [value(urls.domain, u) for u in ("https://www.shop.co.uk/x", "http://a.b.example.com:80", "https://co.uk", "https://x.org")] == ["shop.co.uk", "example.com", "co.uk", "x.org"]
    assert value(urls.bare_host, "https://WWW.A.org:81/x") == "a.org" and value(urls.host, "https://www.a.org:81/x") == "a.org:81"
    assert [value(urls.page_type_rank, u) for u in ("https://a.org/about", "https://a.org/help/x", "https://a.org/shop?x", "https://a.org/faq/", "https://a.org/z")] == [0, 1, 2, 5, 6]
    assert [value(urls.cleaned_input, u) for u in ("a.org", "[x]( https://a.org/b )", " <`a.org`> ", "")] == ["https://a.org", "https://a.org/b", "https://a.org", ""]
    assert value(urls.is_deep, "https://a.org/b/c/") and not value(urls.is_deep, "https://a.org/b/")
    assert value(urls.locale, "https://a.org/fr-CA/x") == "fr-ca" and value(urls.locale_root, "https://a.org/fr/x") == "https://a.org/fr/"


def test_exports(spark, run, tmp_path):
    exported = run.table("exported_findings")
    sinks.write_csv(exported, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["site", *sinks.CSV_COLUMNS] and back.count() == exported.count()
    reports = sinks.report_json(run.table("site_scores"), run.table("findings"))
    assert all(json.loads(r.report)["site"] == r.site for r in reports.collect())
    (tmp_path / "saved").mkdir()
    (tmp_path / "saved" / "one.json").write_text(json.dumps(json.loads(reports.first().report), indent=2))
    assert sinks.read_reports(spark, str(tmp_path / "saved")).first().site in SITES
    for day in ("2025-01-01", "2025-01-02"):
        sinks.append_history(run.table("site_scores"), str(tmp_path / "history"), day)
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2 * len(SITES)
    briefs = {b.site: b.text for b in sinks.brief_text(run.table("brief_lines")).collect()}
    assert set(briefs) == set(SITES)
    heads = [x for x in briefs["spa.example"].split("\n") if x.startswith("#")]
    assert heads[0] == "# spa.example" and [h[3:] for h in heads[1:]] == [h for h in sinks.SECTIONS if h in briefs["spa.example"]] and "## Action plan" in briefs["spa.example"]


def test_stream_scores_the_sites_that_files_touch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(name, pages):
        (tmp_path / name).write_text("\n".join(json.dumps({"page_id": i, "url": u, "html": h}) for i, u, h in pages))
        (tmp_path / name).rename(landing / name)

    query = follow(spark, str(landing), str(tmp_path / "pages"), str(tmp_path / "scores"), str(tmp_path / "state"))
    try:
        land("1.json", [(1, "https://a.example/", SITES["spa.example"]["/"]), (2, "https://b.example/", SITES["clean.example"]["/"])])
        query.processAllAvailable()
        land("2.json", [(3, "https://a.example/", SITES["clean.example"]["/"])])
        query.processAllAvailable()
    finally:
        query.stop()
    rows = {(r.batch_id, r.site): r.value for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    assert set(rows) == {(0, "a.example"), (0, "b.example"), (1, "a.example")} and rows[1, "a.example"] > rows[0, "a.example"]


def test_library_does_not_need_the_optional_folder():
    import pathlib

    for f in (pathlib.Path(__file__).parents[1] / "sightline").rglob("*.py"):
        if "llm" not in f.parts:
            assert "sightline.llm" not in f.read_text(), f


def test_every_hreflang_code_is_a_variant_and_paths_alone_are_capped(spark):
    codes = [f"{a}-{b}" for a in ("en", "fr", "zu") for b in ("us gb in fr de es it jp cn br ca au mx nl se kr sg ae za nz".split())]
    links = "".join(f'<link rel="alternate" hreflang="{c}" href="https://many.example/{c}/">' for c in codes)
    paths = "".join(f'<a href="/{c}/">{c}</a>' for c in codes)
    pages = spark.createDataFrame([(0, "https://many.example/", page("Many", WORDS, links)), (1, "https://paths.example/", page("Paths", WORDS + paths))], "page_id long, url string, html string")
    run = audit(pages, link_status=spark.createDataFrame([("https://many.example/zu-za", 404), ("https://many.example/zu-za/", 404)], "url string, status int"), as_of="2025-06-01")
    got = run.table("region_variants").where("site = 'many.example'").collect()
    assert {r.code for r in got} == set(codes) and len(got) == 60
    summary = {r.site: r for r in run.table("region_summary").collect()}
    assert (summary["many.example"].n_variants, summary["many.example"].n_dead) == (60, 1)
    assert summary["paths.example"].n_variants == 40


def external(spark, pages, **side):
    runs = spark.createDataFrame([(s,) for s in ("clean.example", "shop.example", "stale.example", "blocked.example")], "site string")
    return {r.site: r for r in audit(pages, external_runs=runs, **side).table("external_evidence").collect()}, audit(pages, external_runs=runs, **side)


def test_outside_evidence_counts_where_it_was_gathered(spark, run):
    """No outside data, no finding about the outside; with it, present, absent and unavailable are told apart."""
    pages = run.tables["crawl"]
    assert run.table("findings").where("check_id like 'X%'").count() == 0
    assert {r.state for r in run.table("coverage_checks").where("named = 'external_verification'").collect()} == {"partial"}
    assert {r.corpus for r in run.table("external_evidence").collect()} == {"unavailable"}

    entities = spark.createDataFrame([("Acme Tools", "Q1", "https://www.clean.example/", 2), ("acme tools", "Q2", "https://other.example/", 1), ("Shop", "Q3", None, 1)], "label string, entity_id string, official_website string, hit_rank int")
    corpus = spark.createDataFrame([("shop.example", 0), ("clean.example", 3)], "domain string, records bigint")
    status = spark.createDataFrame([("https://www.linkedin.com/company/acme", 999)], "url string, status int")
    rows, seen = external(spark, pages, entities=entities, corpus_index=corpus, link_status=status)
    clean, shop, stale, spa = (rows[s] for s in ("clean.example", "shop.example", "stale.example", "spa.example"))
    assert (clean.entity_id, clean.links_back, clean.corpus, clean.verified) == ("Q1", True, "present", True)
    assert (shop.entity, shop.links_back, shop.corpus) == ("present", False, "absent")
    assert (stale.entity, stale.corpus, stale.verified) == ("absent", "unavailable", True)  # its profile answers
    assert (spa.performed, spa.verified) == (False, None)
    hits = {(r.site, r.check_id) for r in seen.table("findings").where("check_id like 'X%'").collect()}
    assert hits == {("shop.example", "X1e"), ("shop.example", "X4e"), ("stale.example", "X2e"), ("blocked.example", "X1e")}
    states = {r.site: r.state for r in seen.table("coverage_checks").where("named = 'external_verification'").collect()}
    assert states["clean.example"] == "pass" and states["spa.example"] == "partial"


def test_private_and_unknown_profiles(spark):
    links = "".join(f'<a href="{u}">p</a>' for u in ("http://10.0.0.8/github.com/a", "https://twitter.com/acme", "https://github.com/acme", "http://intranet/github.com/x", "https://twitter.com/gone"))
    pages = spark.createDataFrame([(1, "https://p.example/", page("Profiles of the brand", WORDS + links))], "page_id long, url string, html string")
    status = spark.createDataFrame([("https://twitter.com/acme", 200), ("https://twitter.com/gone", 0)], "url string, status int")
    got = {r.profile: r.state for r in audit(pages, link_status=status).table("profile_states").collect()}
    assert got["https://twitter.com/acme"] == "verified" and got["https://github.com/acme"] == "unavailable" and got["https://twitter.com/gone"] == "unreachable"
    assert got["http://10.0.0.8/github.com/a"] == "skipped" and got["http://intranet/github.com/x"] == "skipped"


def test_structured_data_written_one_after_the_other(spark):
    def types(block):
        rows = spark.createDataFrame([(1, "https://j.example/", page("Structured data of all kinds", WORDS, f'<script type="application/ld+json">{block}</script>'))], "page_id long, url string, html string")
        return sorted(r.first_type for r in audit(rows).table("page_jsonld").collect())

    assert types('{"@type":"Organization"} {"@type":"WebSite"}') == ["organization", "website"]
    assert types('{"@type":"Organization"}{"@type":"WebSite"}\n{broken') == ["organization", "website"]
    assert types('[{"@type":"A"},{"@type":"B"}]') == ["a", "b"] and types('{"@graph":[{"@type":"A"},{"@type":"B"}]}') == ["a", "b"]
    assert types("{broken") == [] and types("") == [] and types('"text"') == []


def test_what_is_no_html_is_not_sampled(spark):
    pages = spark.createDataFrame([(i, f"https://h.example/{p}", page("A page of the site here", WORDS)) for i, p in enumerate(["", "data", "about"])], "page_id long, url string, html string")
    responses = spark.createDataFrame([("https://h.example/data", 200, 1, 9, "application/json", "", ""), ("https://h.example/about", 200, 1, 9, "text/HTML; charset=x", "", ""), ("https://h.example/llms.txt", 200, 1, 9, "text/plain", "", "")], "url string, status int, elapsed_ms bigint, raw_len bigint, content_type string, x_robots string, error string")
    run = audit(pages, responses=responses)
    assert {r.url for r in run.table("site_pages").collect()} == {"https://h.example/", "https://h.example/about"}
    assert [(r.site, r.present) for r in run.table("llms_status").collect()] == [("h.example", True)]


def test_equal_findings_are_merged_with_their_pages(spark, run):
    """The stronger one stays, with the pages of both."""
    pages = run.tables["crawl"]
    hits = spark.createDataFrame([("clean.example", "Z1", 1, 2, "u1", "u1 | u2"), ("clean.example", "Z2", 1, 2, "u3", "u3 | u1")], "site string, check_id string, n bigint, n_affected bigint, example string, affected string")
    checks = spark.createDataFrame([("Z1", "low", "high", "engagement", "mobile", "Same  thing"), ("Z2", "high", "high", "engagement", "Mobile", " same Thing")], "check_id string, severity string, confidence string, dimension string, category string, title string")
    own = audit(pages)
    own.tables["check_hits"], own.tables["check_catalog"] = hits, checks
    got = own.table("findings").collect()
    assert [(r.check_id, r.severity, r.affected, r.n_affected) for r in got] == [("Z2", "high", "u3 | u1 | u2", 3)]


def test_nested_sitemaps_regions_and_evaluation(spark):
    links = '<link rel="alternate" hreflang="x-default" href="https://one.example/"><link rel="alternate" hreflang="en-nz" href="https://nz.example/"><link rel="alternate" hreflang="de-ch" href="https://ch.example/">'
    pages = spark.createDataFrame([(1, "https://one.example/", page("The main site of the brand", WORDS, links + ORG)), (2, "https://nz.example/", "<p>poor"), (3, "https://ch.example/", page("Die Seite in der Schweiz", WORDS))], "page_id long, url string, html string")
    loc = lambda *us: "".join(f"<loc> {u} </loc>" for u in us)
    maps = spark.createDataFrame([("one.example", "https://one.example/sitemap.xml", loc("https://one.example/a", "https://one.example/m/b.xml")), ("one.example", "https://one.example/m/b.xml", loc("https://one.example/c")), ("one.example", "https://one.example/m/never-named.xml", loc("https://one.example/d"))], "site string, url string, body string")
    expected = spark.createDataFrame([("nz.example", "extractability"), ("nz.example", "mobile"), ("one.example", "js-render-gap")], "site string, category string")
    limits = spark.createDataFrame([("one.example", 0, 9, "viewport"), ("nz.example", 0, 1, "viewport")], "site string, max_critical int, max_high int, absent_title string")
    run = audit(pages, sitemaps=maps, expected=expected, expected_limits=limits)
    assert {r.loc for r in run.table("sitemap_urls").collect()} == {"https://one.example/a", "https://one.example/c"}
    labels = [r.label for r in run.table("region_places").orderBy("place").collect()]
    assert labels == ["Global", "Switzerland", "New Zealand"]
    regions = {r.url: r for r in run.table("region_scores").collect()}
    assert regions["https://one.example/"].is_primary and regions["https://nz.example/"].score < regions["https://one.example/"].score
    assert run.table("region_notes").first().note.startswith("New Zealand (")
    rows = {r.site: r for r in run.table("evaluation_rows").collect()}
    assert (rows["one.example"].missed, rows["one.example"].found) == ("js-render-gap", 0) and rows["nz.example"].found == 2 and rows["nz.example"].false_positives == 2 and not rows["nz.example"].passed
    total = run.table("evaluation").first()
    assert (total.sites, total.passed, total.recall, total.false_positives) == (2, 0, 0.667, 2)


def test_search_plans_and_texts(run):
    found_ = run.find_findings("viewport", severity=["high"]).collect()
    assert {r.site for r in found_} == {"spa.example"} and run.find_findings("no such thing").count() == 0
    facets = {r.value for r in run.table("finding_facets").where("facet = 'dimension'").collect()}
    assert facets == {"discoverability", "engagement"}
    pages = run.find_pages("clean.example/", by="url").collect()
    assert [r.url for r in pages] == sorted(r.url for r in pages) and len(pages) == 4
    with pytest.raises(ValueError):
        run.find_pages(by="luck")
    plan = {(r.finding_id): r for r in run.table("action_plan").where("site = 'spa.example'").collect()}
    fixes = {r.id: r for r in run.table("fix_plan").where("site = 'spa.example'").collect()}
    ids = {r.id: r.check_id for r in run.table("findings").where("site = 'spa.example'").collect()}
    assert set(plan) == set(fixes) == set(ids) and all(p.how for p in plan.values())
    viewport = next(i for i, k in ids.items() if k == "G1")
    assert "width=device-width" in fixes[viewport].snippet and fixes[viewport].action == "add_responsive_layout"
    d1 = next(i for i, k in ids.items() if k == "D1")
    assert '"name":"Spa"' in fixes[d1].snippet and "https://spa.example/" in fixes[d1].snippet
    lines = [r.line for r in run.table("narratives").where("site = 'spa.example'").orderBy("ord").collect()]
    assert lines[0].startswith("spa.example scores ") and any("quick win" in x for x in lines)
    text = run.table("llms_text").where("site = 'clean.example'").first().text
    assert text.startswith("# Acme Tools\n\n> What Acme makes") and "- [Home](https://clean.example/)" in text and "- [Contact](https://clean.example/contact)" in text
