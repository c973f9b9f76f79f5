"""Work is dealt out by rows, so that tasks stay short as tables grow."""

from sightline.audit import audit
from sightline.plans import relations
from sightline.plans.relations import build
from sightline.queries import base_tables


def rows_by_task(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_html_is_made_for_the_sample_alone_and_dealt_out_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(relations, "TASK_PAGES", 20, raising=False)
    made = {}
    for prefix in ("", "rg_"):
        html, sample = (build(spark, prefix + n, base_tables(spark, sf), None, made) for n in ("page_html", "site_pages"))
        n = sample.count()
        assert html.count() == n > 0
        assert max(rows_by_task(build(spark, prefix + "page_stream", base_tables(spark, sf), None, made).select("page_id"))) <= max(60, n // 4)


def test_words_for_spark_leave_the_sql_alone():
    for name in ("page_html", "rg_page_stream"):
        r = relations.RELATIONS[name]
        assert r.spark and r.spark != r.sql
    assert "REPARTITION" not in relations.duckdb_sql("region_notes") and "rg_page_html" not in relations.duckdb_sql("region_notes")


def above(plan, mark):
    """The nodes above the first scan whose line holds `mark`, in a plan as Spark prints it."""
    lines = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in plan.splitlines()]
    at = next(i for i, (_, x) in enumerate(lines) if "FileScan" in x and mark in x)
    depth, out = lines[at][0], []
    for d, x in reversed(lines[:at]):
        if d < depth:
            depth = d
            out.append(x.lstrip(" :+-*()0123456789"))
    return out


def test_texts_of_pages_are_moved_once_for_their_facts(spark, sf, monkeypatch):
    made = {}
    whole = build(spark, "page_facts", base_tables(spark, sf), None, made)
    del made["page_facts"]
    monkeypatch.setattr(relations, "durable", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = build(spark, "page_facts", base_tables(spark, sf), None, made)
        moves = [x for x in above(facts._jdf.queryExecution().executedPlan().toString(), "visible_text") if x.startswith("Exchange")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(moves) == 1, moves
    assert whole.exceptAll(facts).isEmpty() and facts.exceptAll(whole).isEmpty()


ODD = [
    "<a href='a/../b'>x</a><a href='./c/.'>y</a><a href='../../../up'>z</a><a href='https://o.example/p/../q'>w</a><a href='/d/..'>v</a><a href='.hidden'>u</a><a href='?q=/../r'>t</a><a href=''>s</a>",
    "<a href='/k'>one <b>two</b> < three</a><a href='/l'>1 <!-- c -->2</a><a href='/m'>&lt;i&gt;</a><h1>a <i>b</i></h1><h2>plain</h2><h2></h2>",
    "<p>plain words</p>", "",
    "<link rel='alternate' hreflang='fr' href='../fr/./x'><link rel='alternate' hreflang='de' href='/de'><link rel='alternate' hreflang='en' href='//h.example/./y'>",
]


def test_spared_regular_expressions_leave_the_rows_as_they_are(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://s.example/{i}/deep/page", h) for i, h in enumerate(ODD)], "page_id bigint, url string, html string")
    names, rows = ("page_links", "page_headings", "page_hreflang"), {}
    for words in ("spark", "sql"):
        for n in names:
            r = relations.RELATIONS[n]
            assert r.spark and r.spark != r.sql
            monkeypatch.setitem(relations.RELATIONS, n, relations.Relation(n, r.sql, r.stored, r.duck, getattr(r, words)))
        run = audit(pages)
        rows[words] = {n: sorted(map(str, run.table(n).collect())) for n in names}
        monkeypatch.undo()
    assert rows["spark"] == rows["sql"] and all(rows["sql"].values())


def test_sites_and_entities_of_one_name_do_not_all_meet(spark):
    n = 60
    sites = spark.createDataFrame([(f"s{i}.example.org", "Same Name", 1) for i in range(n)] + [("s1.example.org", "s1", 2), ("lone.example.net", "lone", 1)], "site string, name string, place int")
    sites = sites.selectExpr("site", "lower(name) AS name", "place")
    rows = [("same NAME", f"Q{i:03d}", f"https://s{i}.example.org/" if i % 3 else "https://fan.example.net/", i % 7) for i in range(n)] + [("S1", "Q900", "https://example.org/", 1), ("lone", None, None, 2), (None, "Q901", None, 1)]
    entities = spark.createDataFrame(rows, "label string, entity_id string, official_website string, hit_rank int")
    tables, r = {"brand_candidates": sites, "entities": entities}, relations.RELATIONS["entity_matches"]
    got = build(spark, "entity_matches", tables)
    views = {"brand_candidates": "scale_candidates", "entities": "scale_entities"}
    for k, v in views.items():
        tables[k].createOrReplaceTempView(v)
    plain = spark.sql(relations.NAMED.sub(lambda m: views[m[1]], r.sql))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == n + 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join Inner")
    assert "nth" in plan[joined:] and "<= 8" in plan[joined:], plan


def test_what_many_relations_read_is_written_once(spark, sf):
    made = {}
    build(spark, "check_hits", base_tables(spark, sf), None, made)
    for n in ("site_totals", "external_evidence", "brand_names"):
        assert made[n].inputFiles() and all("/tables/" in f for f in made[n].inputFiles()), n
        assert "MATERIALIZED" not in relations.duckdb_sql(n).split(f"r_{n} AS")[1][:14]


UNSEEN_PAGES = [
    "a<!-- x > y -->b<!--never closed <p>c", "<head/>d<head>e</head>f<header>g</header>", "<script a='>'>h</script >i<SCRIPT>j</ScRiPt\n>k<style>l", "1 < 2 <3 <é> <!x> </> </p  > <", "<svg width=1/>m<svg>n</svg><template>o<noscript>p</template>q</noscript>r",
    "<!doctype html>s|t<br/>u", "", "plain", "<noscript", "<!-", "<p\n>v</p", "<headline>w</headline><styles>x",
]


def test_the_fast_pattern_of_unseen_text_is_the_same(spark, monkeypatch):
    from sightline.operators import extract

    df = spark.createDataFrame([(h,) for h in UNSEEN_PAGES + ODD], "html string")
    fast = extract.unmarked("html").replace(extract.UNSEEN, extract.UNSEEN_FAST)
    assert df.where(f"NOT ({extract.unmarked('html')} <=> {fast})").isEmpty()
    r = relations.RELATIONS["page_signals"]
    assert fast in r.spark and fast not in r.sql
    pages = spark.createDataFrame([(i, f"https://s.example/{i}", h) for i, h in enumerate(UNSEEN_PAGES + ODD)], "page_id bigint, url string, html string")
    rows = []
    for words in (r.spark, r.sql):
        monkeypatch.setitem(relations.RELATIONS, "page_signals", relations.Relation(r.name, r.sql, r.stored, r.duck, words))
        rows.append(sorted(map(str, audit(pages).table("page_signals").collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 12
