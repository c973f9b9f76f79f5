import hashlib

import numpy as np

from sightline.llm.line_dedup import CuckooFilter, LineStore, built, dedup_lines, rewritten


def brute(rows):
    """What the contract says, line by line."""
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                if len(k := line.strip(strip).translate(low)) >= 10:
                    holders.setdefault(k, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(k := x.strip(strip).translate(low)) < 10 or len(holders[k]) < 2 or doc_id == min(holders[k])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [
    (3, "A shared line here\nown line of three\nshort"), (1, "a SHARED line here \nshort\na shared line here"), (2, "\tA shared line here\r\n\nzwölf Zeichen ÄÖ"), (5, "zwölf zeichen ÄÖ\nZwölf Zeichen ÄÖ"),
    (4, None), (6, ""), (None, "A shared line here"), (7, "own line of seven\n" * 3), (3, "A shared line here\nown line of three\nshort"), (8, "x" * 100_000 + "\na shared line here"),
]


def frame(spark, rows):
    """With columns whose names clash with the operator's own."""
    return spark.createDataFrame([(a, "clash", b, 1, 2, "x", 3, 4) for a, b in rows], "doc_id long, k1 string, text string, n_lines int, N_DROPPED int, _keys string, shard int, _id long")


def test_against_brute_force(spark):
    out = dedup_lines(frame(spark, ROWS))
    assert out.columns == ["doc_id", "k1", "text", "_keys", "shard", "_id", "n_lines", "n_dropped"]
    out = out.collect()
    assert {(r.k1, r._keys, r.shard, r._id) for r in out} == {("clash", "x", 3, 4)}
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out], key=str)
    assert got == brute(ROWS)


def test_empty_table(spark):
    assert dedup_lines(frame(spark, [])).count() == 0


def test_deleting_what_was_inserted_restores_the_store(spark):
    base = [r for r in ROWS if r[0] in (1, 2, 5, 7)]
    more = [(3, ROWS[0][1]), (9, "own line of seven\nzwölf zeichen äö")]
    start = LineStore.build(frame(spark, base))
    grown = start.insert(frame(spark, more))
    back = grown.delete(frame(spark, more).select("doc_id"))

    def state(store):
        refs = sorted((r.k1, r.k2, r.doc_id) for r in store.references.collect())
        counts = sorted(tuple(r) for r in store.counts.collect())
        filters = {r.shard: r.n_keys for r in store.filters.collect() if r.n_keys}
        return refs, counts, filters, store.size

    assert state(back) == state(start)
    assert state(grown) != state(start)
    every = frame(spark, base + more)
    texts = lambda df: sorted((r.doc_id, r.n_dropped, r.text) for r in df.collect())
    assert texts(rewritten(every, grown.duplicates(every))) == texts(dedup_lines(every))
    assert texts(rewritten(frame(spark, base), back.duplicates(frame(spark, base)))) == texts(dedup_lines(frame(spark, base)))


def test_a_store_begun_with_one_row_grows_to_more_shards(spark, monkeypatch):
    import sightline.llm.line_dedup as module

    monkeypatch.setattr(module, "SHARD_KEYS", 20)
    monkeypatch.setattr(module, "PARTS", 2)
    rows = [(i, "\n".join(f"a line numbered {(i * j) % 37}" for j in range(1, 12))) for i in range(1, 25)]
    store = LineStore.build(frame(spark, rows[:1]))
    assert store.shards == 1
    for lo in (1, 7, 13, 19):
        store = store.insert(frame(spark, rows[lo : lo + 6]))
    store = store.delete(frame(spark, rows[5:8]).select("doc_id"))
    left = rows[:5] + rows[8:24]
    assert store.shards > 3 and store.size == store.references.count() <= 2 * 20 * store.shards
    got = rewritten(frame(spark, left), store.duplicates()).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got], key=str) == brute(left)


def test_cuckoo_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    f = built(k[0, :10_000], k[1, :10_000])
    assert f.contains(k[0, :10_000], k[1, :10_000]).all()
    assert f.contains(k[0, 10_000:], k[1, 10_000:]).mean() < 0.002
    f.delete(k[0, :5_000], k[1, :5_000])
    assert f.contains(k[0, 5_000:10_000], k[1, 5_000:10_000]).all()
    assert f.contains(k[0, :5_000], k[1, :5_000]).mean() < 0.01
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(k[0, 5_000:10_000], k[1, 5_000:10_000]).all()


def test_digest_column_matches_hashlib(spark):
    from sightline.llm.queries import op4_line_dedup

    rows = {r.doc_id: r for r in op4_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for doc_id, n, dropped, text in brute(docs):
        assert (rows[doc_id].n_lines, rows[doc_id].n_dropped) == (n, dropped)
        assert rows[doc_id].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
