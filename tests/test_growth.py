"""Steps that all audits share cost little a page and are dealt out evenly."""

from sightline.audit import audit
from sightline.operators import extract
from sightline.plans import relations

REFERENCES = [
    "&copy; 2020 &amp;lt; &lt;b&gt; &ampamp; &&amp;amp; &nbsp &nbsp;x &#39;q&#39 &apos;&quot&hellip;&mdash &euro5 &bad; & &amp", "&", "&&", "&amp", "a & b\x02c", "\x02 none", "&l&lt;t; &am&amp;p;", "é&middot;&pound3&ndash;ü &copyx;",
    "two  blanks \t tab\nline    hard one \x0b\x0c\r end ", "   ", "a b", "",
    "x2020-01-02 2020-01-02 _2021-01-02 2021-01-023 é2022-01-02 2022-01-02é 2023-01-02-2024-01-02 20230-01-02 2120-01-01",
    "<DIV x ID='app'> </DIV>", "<div id=app></div>", "<head><LINK href=a rel='stylesheet'><link rel=\"Stylesheet\" href=b><SCRIPT src=1></SCRIPT><script async src=2></script></head>",
]


def test_long_texts_of_pages_are_gone_over_few_times_with_the_same_signals(spark, monkeypatch):
    r = relations.RELATIONS["page_signals"]
    assert r.spark.count("replace(replace(replace(bare") == r.spark.count("replace(bare, '&nbsp;'") == 0 < r.sql.count("replace(bare, '&nbsp;'")
    df = spark.createDataFrame([(t,) for t in REFERENCES], "bare string")
    for plain, fast in ((extract.decoded, extract.decoded_in_parts), (extract.squeezed, extract.squeezed_where_needed)):
        assert df.where(f"NOT ({plain('bare')} <=> {fast('bare')})").isEmpty()
    pages = spark.createDataFrame([(i, f"https://s.example/{i}", h) for i, h in enumerate(REFERENCES)], "page_id bigint, url string, html string")
    rows = []
    for words in (r.spark, r.sql):
        monkeypatch.setitem(relations.RELATIONS, "page_signals", relations.Relation(r.name, r.sql, r.stored, r.duck, words))
        rows.append(sorted(map(str, audit(pages, max_pages=50).table("page_signals").collect())))
    assert rows[0] == rows[1] and len(rows[0]) == len(REFERENCES)


URLS = [
    "https://www.a.example.co.uk:8080/About/?x=/y.png", "https://a.example.co.uk", "HTTPS://A.example.co.uk/x", "http://a.example.co.uk?q=1", "https://a.example.co.uk#f/about", "https://a.example.co.uk/i.PNG", "https://a.example.co.uk/i.png?v=1",
    "https://a.example.co.uk/i.png/", "https://a.example.co.uk/i.pngs", "https://a.example.co.uk/?i.png", "https://a.example.co.uk/shop", "https://a.example.co.uk/p/FAQS?", "https://a.example.co.uk/catalogue/x", "https://a.example.co.uk/prices",
    "ftp://f.example/about", "//n.example/x", "mailto:x@y.example", "", "https://", "https:///x", "https://u:p@b.example:1/é.js", "https://www.www.c.example/a.b/contact", "https://c.example/a.js#x", "https://d.example/bad", "https://d.example/good", "https://1.2/", "http://x.example/a\nb.css\n", "http://x.example/c.css\nd",
]


def test_addresses_are_dealt_out_before_anything_is_made_of_them(spark, monkeypatch):
    r = relations.RELATIONS["page_sample"]
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, u) for i, u in enumerate(URLS[::3])] + [(None, URLS[3]), (None, "https://d.example/null"), (-5, URLS[1])]
    pages = spark.createDataFrame([(i, u, "<p>x</p>") for i, u in rows], "page_id bigint, url string, html string")
    responses = spark.createDataFrame([("https://d.example/bad", 200, 5, 5, "image/png", "", "", None), ("https://d.example/unseen", 200, 5, 5, "image/png", "", "", None), ("https://d.example/good", 200, 5, 5, "Text/HTML", "", "", None)],
                                      "url string, status int, elapsed_ms bigint, raw_len bigint, content_type string, x_robots string, error string, headers string")
    for scope in ("host", "domain"):
        got = []
        for words in (r.spark, ""):
            monkeypatch.setitem(relations.RELATIONS, "page_sample", relations.Relation(r.name, r.sql, r.stored, r.duck, words, r.replaces))
            sample = audit(pages, scope=scope, responses=responses).table("page_sample")
            got.append(sorted(map(str, sample.collect())))
            if words:
                below = sample._jdf.queryExecution().optimizedPlan().toString().lower().split("repartitionbyexpression")[1]
                assert "scan" in below or "localrelation" in below or "logicalrdd" in below
                assert "rlike" not in below and "regexp" not in below and "substring_index" not in below
        assert got[0] == got[1] and len(got[0]) == 23


PARTS = [
    "<html lang=en><head><title>T</title></head><NAV>x</NAV><p itemprop=a>2 min read</p> < b <3 </p", "<nav id=1><meta property='og:site_name' content=N><p>Posted On monday, 5 Min Read</p>", "<p vocab='x'>Sign In to Continue. <!-- <p itemscope> --></p>", "<P ITEMTYPE=x>login and  view", "<p data-item='1'>blog in and view",
    "<meta itemprop=a content=b><div property=p>members Only</div>", "<p>SUBSCRIBERS ONLY Key İ published in x</p>", "x" * 795 + " log in to read", "x" * 300 + " min read", "x" * 390 + " posted on", "日本語 text ©", "é© plain", "ひ", "한국어 words here", "é é é", "", "<p>&copy; 2012 Name, Copyright 2013 c ©c copyrigh COPYRIGHT 2014</p>",
    "<div role='Navigation'>x</div>", "<nav", "<p>nav role=navigation</p>", "<img src=a><img src=b><img src=c alt=''><form><input type=text><iframe src=a></iframe></form><a href=/a>more</a><a rel=nofollow href=/b>here</a><a href=/c>buy</a>",
]


def both_words(spark, monkeypatch, of, name, pages):
    """The rows of `name` by Spark's own words of the relations `of`, and by their SQL."""
    rows = []
    for own in (True, False):
        with monkeypatch.context() as m:
            for r in [relations.RELATIONS[n] for n in of]:
                assert r.spark
                m.setitem(relations.RELATIONS, r.name, relations.Relation(r.name, r.sql, r.stored, r.duck, r.spark if own else "", r.replaces, r.tasks_by, r.kept))
            rows.append(sorted(map(str, audit(pages, max_pages=50).table(name).collect())))
    return rows


def test_texts_are_searched_where_a_plain_word_stands_with_the_same_result(spark, monkeypatch):
    assert "octet_length(visible_text) >" in relations.RELATIONS["page_signals"].spark
    pages = spark.createDataFrame([(i, f"https://s{i % 4}.example/{i}", h) for i, h in enumerate(PARTS)], "page_id bigint, url string, html string")
    own, plain = both_words(spark, monkeypatch, ["page_signals"], "page_signals", pages)
    assert own == plain and len(own) == len(PARTS)


def test_rules_read_the_pages_once_with_the_same_hits(spark, monkeypatch):
    counts = {n: (relations.RELATIONS[n].sql.count("{page_facts}"), relations.RELATIONS[n].spark.count("{page_facts}")) for n in ("page_count_hits", "site_rule_hits")}
    assert counts["page_count_hits"] == (4, 1) and counts["site_rule_hits"][1] <= counts["site_rule_hits"][0] - 6
    pages = spark.createDataFrame([(i, f"https://s{i % 7}.example/{['', 'about', 'blog/a', 'a/b/c/d/e'][i // 7 % 4]}?{i}", h * (1 + i % 2 * 3)) for i, h in enumerate(PARTS * 2)], "page_id bigint, url string, html string")
    for name, some in (("page_rule_hits", {"D5", "F3", "G11"}), ("page_count_hits", {"E9", "G12", "G13", "G14"}), ("site_rule_hits", {"D1", "E11", "R1", "R2", "G3", "D3", "G2", "C11"})):
        own, plain = both_words(spark, monkeypatch, [name], name, pages)
        assert own == plain
        found = {k for k in some if any(f"'{k}'" in row for row in own)}
        assert found >= some - {"R1", "C11"}


def test_what_several_tables_read_is_made_once(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", PARTS[0]), (2, "https://b.example/", PARTS[1])], "page_id bigint, url string, html string")
    run = audit(pages)
    for name in ("narratives", "fix_plan", "peer_gaps", "funnel_notes"):
        plan = run.table(name)._jdf.queryExecution().optimizedPlan().toString()
        assert "major_project" not in plan and "explode" not in plan, name
    assert all(relations.RELATIONS[n].kept for n in ("response_of", "matrix", "kpis", "pillar_scores"))
