import corpus_pipeline
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_near_dup import brute as classes


def test_stages_against_brute_force(spark, sf):
    """Every stage but the first is checked on its own input; the first keeps all documents with a sure language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 34", "en", "s", 5), (None, "the and of that is with them", "en", "s", 9)], docs.schema)
    at, rows = docs.unionByName(odd), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows[name] = [(r.doc_id, r.text) for r in out.collect()]
        at = spark.createDataFrame([tuple(r) for r in out.collect()], docs.schema)
    assert {i for i, _ in rows["language_id"]} == {r.doc_id for r in docs.collect()} | {None}
    key = lambda x: sorted(x, key=str)
    assert key(rows["line_dedup"]) == key((i, t) for i, _, _, t in lines(rows["language_id"]))
    group = classes(rows["line_dedup"])
    assert key(rows["near_dedup"]) == key((i, t) for i, t in rows["line_dedup"] if i is None or group[i] == i)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in hits(rows["near_dedup"], bench) if r[5]}
    assert key(rows["decontaminate"]) == key((i, t) for i, t in rows["near_dedup"] if i not in bad)


def test_run_has_a_row_for_each_document_kept(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200


def test_rows_without_an_id_or_with_a_shared_one_are_judged_each(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) >= 12").first().text
    words = lambda a: " ".join(f"{a}{i}" for i in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    kept = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)

    rows = [(None, f"before {bench} after"), (None, "clean without an id"), (7, f"before {bench} after"), (7, "clean with a shared id"), (8, None)]
    assert kept(corpus_pipeline.drop_contaminated(spark, frame(rows), sf)) == sorted([rows[1], rows[3], rows[4]], key=str)

    rows = [
        (5, words("a")), (5, words("b")), (5, words("b")), (None, words("c")), (None, words("c")), (None, words("d")), (None, words("a")), (9, words("e")),
        (2, words("e") + " more"), (None, "..."), (None, "..."), (3, "..."), (3, "..."), (3, "!"), (4, "..."), (None, None), (None, None),
    ]
    want = [(5, words("a")), (5, words("b")), (None, words("c")), (None, words("d")), (2, words("e") + " more"), (None, "..."), (3, "..."), (3, "!"), (4, "..."), (None, None)]
    assert kept(corpus_pipeline.drop_near_duplicates(spark, frame(rows), sf)) == sorted(want, key=str)


def test_clean_rows(spark):
    import sightline.llm.decontaminate as module
    from tests.llm.test_decontaminate import data

    docs, items = data()
    d = spark.createDataFrame([(a, b, 0, 1) for a, b in docs], "doc_id long, text string, n_words int, h1 int")
    got = module.clean_rows(d, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == d.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted([x for x in docs if not hits([x], items)[0][5]], key=str)
