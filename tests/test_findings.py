"""Conflicts, boasts, coverage, regions, headers and the history."""

import pytest

from sightline.audit import audit
from sightline.sources.sinks import append_history, committed, read_history

WORDS = "Plain words that say what the tools are good for. " * 20


def page(body, head="", lang="en"):
    return f'<html lang="{lang}"><head><title>Acme Tools for all workshops</title><meta name="viewport" content="w"><meta name="description" content="x">{head}</head><body><nav><a href="/">Home</a><a href="/about">About</a></nav><h1>Acme</h1>{body}<p>{WORDS}</p></body></html>'


def node(**kw):
    import json

    return f'<script type="application/ld+json">{json.dumps({"@type": "Organization", "name": "Acme", **kw})}</script>'


@pytest.fixture(scope="module")
def run(spark):
    rows = [
        ("https://acme.example/", page('<a href="https://twitter.com/acme">t</a><a href="https://www.facebook.com/acme">f</a><p>Founded in 2001. The world\'s best company of tools, they say.</p>')),
        ("https://acme.example/about", page('<a href="https://x.com/acme_two">t</a><a href="https://facebook.com/acmehq">f</a><a href="https://instagram.com/acme">i</a><p>Founded in 2003. Most trusted since Founded in 2003.</p>')),
        ("https://acme.example/news", page('<a href="https://twitter.com/acme">t</a>', node(foundingDate="1999-05-01"))),
        ("https://wide.example/", page('<a href="/fr/">Français</a><a href="/de/">Deutsch</a><a href="/de/at/">Österreich</a>', '<link rel="alternate" hreflang="fr" href="/fr/"><link rel="alternate" hreflang="de-de" href="/de/"><link rel="alternate" hreflang="de-at" href="/de/at/"><link rel="alternate" hreflang="x-default" href="/">')),
        ("https://wide.example/fr/", page("", lang="fr")), ("https://wide.example/fr/a-propos", page("", lang="fr")),
        ("https://wide.example/de/", '<html><body><div id="root"></div></body></html>'), ("https://wide.example/de/ueber", "<html><body>kurz</body></html>"),
        ("https://wide.example/de/at/", page("", lang="de")), ("https://wide.example/de/at/ueber", page("", lang="de")), ("https://wide.example/deals", page("")),
    ]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    responses = spark.createDataFrame(
        [("https://acme.example/", 200, 5, 9, "", "", "", "https://acme.example/", '{"Content-Type": "text/html", "X-Robots-Tag": "noindex"}'), ("https://acme.example/about", 200, 5, 9, "", "", "", None, '{"content-type": "application/pdf"}'),
         ("https://acme.example/news", 200, 5, 9, "text/html", "none", "", "https://acme.example/news", None)],
        "url string, status int, elapsed_ms bigint, raw_len bigint, content_type string, x_robots string, error string, final_url string, headers string",
    )
    return audit(pages), audit(pages, responses=responses), pages


def test_each_platform_is_a_finding_of_its_own(run):
    found = {r.check_id: r for r in run[0].table("findings").where("site = 'acme.example' and check_id like 'H%'").collect()}
    assert set(found) == {"H1", "H2_twitter", "H2_facebook", "H3"}
    assert found["H2_twitter"].title == "Conflicting twitter handle across the site" and found["H2_twitter"].n == 2
    assert found["H2_twitter"].affected.split(" | ") == ["https://acme.example/", "https://acme.example/news", "https://acme.example/about"]
    assert found["H2_facebook"].penalty == found["H2_twitter"].penalty > 0


def test_pages_of_a_conflict_are_the_first_three_of_each_value(run):
    h1 = run[0].table("findings").where("site = 'acme.example' and check_id = 'H1'").first()
    assert h1.n == 3 and h1.affected.split(" | ") == ["https://acme.example/news", "https://acme.example/", *["https://acme.example/about"] * 2]


def test_boasts_have_their_context(run):
    rows = run[0].table("superlatives").where("site = 'acme.example'").orderBy("k").collect()
    assert [r.claim.lower() for r in rows] == ["world's best", "most trusted"]
    text = run[0].table("page_signals").where("url = 'https://acme.example/'").first().visible_text
    at = text.index("world's best")
    assert rows[0].context == " ".join(text[at - 30 : at + len("world's best") + 30].split())
    h3 = run[0].table("findings").where("site = 'acme.example' and check_id = 'H3'").first()
    assert h3.n_affected == 2 and h3.affected.split(" | ") == ["https://acme.example/", "https://acme.example/about"]


def test_coverage_has_a_proactive_row_and_a_summary(run):
    rows = {r.area: r for r in run[0].table("coverage").where("site = 'acme.example'").collect()}
    n = run[0].table("opportunities").where("site = 'acme.example'").count()
    assert len(rows) == 9 and rows["proactive"].findings == n and rows["proactive"].status == ("opportunities" if n else "healthy") and rows["proactive"].checks_total == 0
    s = run[0].table("coverage_summary").where("site = 'acme.example'").first()
    real = [r for a, r in rows.items() if a != "proactive"]
    assert s.areas_total == 8 and s.pages_crawled == 3 and s.areas_assessed == sum(r.status != "not_assessed" for r in real) and s.areas_fully_assessed == sum(r.status in ("healthy", "issues") for r in real)
    assert {r.site: r.assessed for r in run[0].table("kpis").collect()}["acme.example"] == s.areas_assessed


def test_regions_are_scored_from_their_own_pages(spark, run):
    rows = {r.region: r for r in run[0].table("region_scores").where("site = 'wide.example'").collect()}
    assert set(rows) == {"Primary", "fr", "Germany", "Austria"} and rows["Primary"].is_primary
    assert rows["Germany"].score < rows["Austria"].score and rows["Germany"].score != rows["Primary"].score
    pages = run[2]
    for region, prefix in (("fr", "/fr/"), ("Austria", "/de/at/")):  # as if its pages were all there is
        own = pages.where(pages["url"].startswith(f"https://wide.example{prefix}"))
        alone = audit(own).table("score_every_site").first()
        assert (rows[region].score, rows[region].findings) == (alone.value, alone.total)
    sample = {r.url: r.site for r in run[0].table("region_sample").collect()}
    assert sample["https://wide.example/de/at/ueber"] != sample["https://wide.example/de/ueber"] and "https://wide.example/deals" not in sample
    assert {r.site for r in run[0].table("score_every_site").collect()} == {"acme.example", "wide.example"}
    assert "Germany" in run[0].table("region_notes").where("site = 'wide.example'").first().note


def test_pages_are_found_by_their_grams(run):
    every = run[0].table("page_records").count()
    for text in ("about", "ABOUT", "de/at", "Acme Tools", "ü", "fr", "zzz", "e/a", "tools for all"):
        titles = {r.url: (r.url + " " + r.title).lower() for r in run[0].table("page_signals").collect()}
        assert {r.url for r in run[0].find_pages(text).collect()} == {u for u, t in titles.items() if text.lower() in t}, text
    assert run[0].find_pages().count() == every


def test_headers_tell_what_a_page_is(run):
    of = {r.url: r for r in run[1].table("response_of").collect()}
    assert (of["https://acme.example/"].content_type, of["https://acme.example/"].x_robots) == ("text/html", "noindex")
    assert of["https://acme.example/news"].x_robots == "none" and of["https://acme.example/about"].content_type == "application/pdf"
    assert {r.check_id for r in run[1].table("findings").where("site = 'acme.example'").collect()} >= {"C6"}
    assert "https://acme.example/about" not in {r.url for r in run[1].table("site_pages").collect()}  # no html


def test_a_run_that_is_written_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "history")
    scores = lambda *rows: spark.createDataFrame(rows, "site string, value int, grade string")
    assert read_history(spark, path).count() == 0
    append_history(scores(("a", 70, "C"), ("b", 80, "B")), path, "2025-06-01 10:00:00")
    append_history(scores(("a", 70, "C"), ("b", 80, "B"), ("c", 90, "A")), path, "2025-06-01 10:00:00")  # again, with what had been missing
    append_history(scores(("a", 75, "C")), path, "2025-06-01 12:00:00")
    append_history(scores(("a", 76, "C")), path, "2025-06-02 10:00:00", run="nightly")
    rows = sorted((r.domain, r.score, str(r.audit_date)) for r in read_history(spark, path).collect())
    assert rows == [("a", 70, "2025-06-01"), ("a", 75, "2025-06-01"), ("a", 76, "2025-06-02"), ("b", 80, "2025-06-01"), ("c", 90, "2025-06-01")]
    folder = next((tmp_path / "history" / "audit_date=2025-06-02").glob("run=*"))
    scores(("a", 1, "F"), ("z", 1, "F")).selectExpr("site domain", "timestamp'2025-06-02 10:00:00' audited_at", "value score", "grade", "'nightly' run_key").write.parquet(f"{folder}/attempt=zz")  # a second attempt that raced
    (folder / "attempt=broken").mkdir()
    (folder / "attempt=broken" / "part-0.parquet").write_bytes(b"not yet")  # one that never came to its end
    assert sorted((r.domain, r.score) for r in read_history(spark, path).where("audit_date = '2025-06-02'").collect()) == [("a", 76), ("z", 1)]
    assert len(committed(spark, f"{folder}/attempt=*")) == 2
