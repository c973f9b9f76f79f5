"""The bucketed page table and the page folder of the stream."""

import json

from sightline.audit import audit
from sightline.sources.pages import bucketed
from sightline.streaming import incremental
from sightline.streaming.incremental import PageFolder, follow, scored

SCHEMA = "page_id bigint, url string, html string"


def page(title, words=80):
    return f"<html lang='en'><head><title>{title}</title><meta name='viewport' content='width=device-width'></head><body><h1>{title}</h1><p>{'word ' * words}</p><a href='/about'>About us here</a></body></html>"


def crawl(spark, sites=6, pages=20):
    return spark.createDataFrame([(s * 100 + p, f"https://s{s}.example/{'' if p == 0 else f'p{p}'}", page(f"Page {p} of {s}", 10 * p)) for s in range(sites) for p in range(pages)], SCHEMA)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_pages_are_not_shuffled_for_their_html(spark):
    spark.sql("DROP TABLE IF EXISTS crawl_pages")
    plain = crawl(spark)
    table = bucketed(plain, "crawl_pages", 4)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, plain.collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = audit(table).table("page_stream")
        plan = exchanges(joined)
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1, plan
        html = next(line for line in plan.splitlines() if "FileScan" in line and "html" in line.split("ReadSchema")[-1])
        assert "Bucketed: true" in html, html
        shuffled = exchanges(audit(plain).table("page_stream"))
        assert shuffled.count("Exchange hashpartitioning") == 2
        rows = {(r.site, r.url) for r in joined.select("site", "url").collect()}
        assert rows == {(r.site, r.url) for r in audit(plain).table("page_stream").select("site", "url").collect()} and len(rows) == 6 * 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_table_of_no_pages_and_of_nulls(spark):
    spark.sql("DROP TABLE IF EXISTS few_pages")
    assert bucketed(spark.createDataFrame([], SCHEMA), "few_pages", 2).count() == 0
    rows = [(1, None, "x"), (None, "https://a.example/", None), (1, None, "x")]
    assert sorted(map(str, bucketed(spark.createDataFrame(rows, SCHEMA), "few_pages", 2).collect())) == sorted(map(str, spark.createDataFrame(rows, SCHEMA).collect()))


def test_html_may_lie_in_a_table_of_its_own(spark):
    pages = crawl(spark, 3, 5)
    apart = audit(pages.select("page_id", "url"), html=pages.select("page_id", "url", "html"))
    scores = lambda run: sorted(map(tuple, run.table("score_every_site").collect()))
    assert scores(apart) == scores(audit(pages)) and len(scores(apart)) == 3


def test_page_folder_has_the_latest_pages_with_and_without_snapshots(spark, tmp_path):
    folders = [PageFolder(spark, str(tmp_path / name)) for name in ("plain", "snapshots")]
    truth, seen = {}, []
    for b in range(5):
        rows = [(10 * b + i, f"https://s{i % 3}.example/{(b * i) % 4}", page(f"{b} {i}")) for i in range(6)] + [(99, None, "x")]
        for folder in folders:
            folder.add(spark.createDataFrame(rows, SCHEMA), b)
        if b in (1, 3):
            folders[1].snapshot(b)
        new = {}
        for page_id, url, html in rows:
            if url is not None:
                new[url] = max(new.get(url, (-1, "")), (page_id, html))
        truth |= {u: (b, *v) for u, v in new.items()}
        seen.append(dict(truth))
    for folder in folders:
        for b in (4, 2, 0):  # a batch that is run again sees what it saw
            latest = folder.addresses(b)
            assert {r.url: (r.batch, r.page_id) for r in latest.collect()} == {u: v[:2] for u, v in seen[b].items()}
            assert {r.url: (r.page_id, r.html) for r in folder.html(latest).collect()} == {u: v[1:] for u, v in seen[b].items()}
        assert {r.site for r in folder.touched(4).collect()} == {"s0.example", "s1.example", "s2.example"}


def test_batches_read_the_html_of_sampled_pages_alone(spark, tmp_path):
    folder = PageFolder(spark, str(tmp_path / "pages"))
    for b in range(3):
        folder.add(spark.createDataFrame([(100 * b + p, f"https://a.example/{b}{p:02}", page(f"{b} {p}")) for p in range(15)], SCHEMA), b)
    run = scored(folder, 2)
    assert run.tables["page_html"].count() == 12  # of 45 pages of the site
    every = spark.createDataFrame([(100 * b + p, f"https://a.example/{b}{p:02}", page(f"{b} {p}")) for b in range(3) for p in range(15)], SCHEMA)
    assert run.table("score_every_site").collect() == audit(every).table("score_every_site").collect()


def test_stream_by_snapshots_scores_as_an_audit_of_all_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SNAPSHOT", 2)
    landing = tmp_path / "landing"
    landing.mkdir()
    query = follow(spark, str(landing), str(tmp_path / "pages"), str(tmp_path / "scores"), str(tmp_path / "state"))
    every = {}
    try:
        for b in range(3):
            rows = [(10 * b + i, f"https://s{i % 2}.example/{i + b}", page(f"{b} {i}", 30 * i)) for i in range(4)] if b != 1 else [(50, "https://s0.example/", page("Home", 400))]
            every |= {u: (i, u, h) for i, u, h in rows}
            (tmp_path / "x").write_text("\n".join(json.dumps({"page_id": i, "url": u, "html": h}) for i, u, h in rows))
            (tmp_path / "x").rename(landing / f"{b}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    assert (tmp_path / "pages" / "_addresses" / "upto=1" / "_SUCCESS").exists()
    last = spark.read.parquet(str(tmp_path / "scores")).where("batch_id = 2").drop("batch_id", "run")
    whole = audit(spark.createDataFrame(list(every.values()), SCHEMA)).table("score_every_site")
    assert sorted(map(tuple, last.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect())) and last.count() == 2
