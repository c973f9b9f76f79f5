import random

import numpy as np
import pytest

from sightline.llm.near_dup import alike, dart_signatures, near_duplicates, weighted_set


def shingles(text, n=5):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    """The class of each doc_id: rows that share one are one document, which is like another if any of their texts is."""
    docs = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if i != j and a and b and len(a & b) >= threshold * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i in up}


def text(rng, n=120):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau phi chi psi omega".split()) + str(rng.randrange(60)) for _ in range(n))


def test_signature_agreement_is_the_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for similarity in (0.5, 0.8, 0.95):
        m = round(1200 * similarity / (1 + similarity))
        b = np.concatenate([a[:m], rng.integers(0, 2**63, 600 - m, dtype=np.uint64)])
        s = dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], 600), 2, 3000)
        assert abs((s[0] == s[1]).mean() - m / (1200 - m)) < 0.04
    assert (dart_signatures(a[:1], np.array([0]), 2, 50)[0] != 0).all()


def test_counted_weights_tell_repeats_apart():
    h, row = np.array([5, 5, 7, 5], np.uint64), np.array([0, 0, 0, 1])
    assert len(weighted_set(h, row, "binary")[0]) == 3
    x, r, height = weighted_set(h, row, "count")
    assert len(x) == 4 and len(set(x[r == 0].tolist())) == 3 and x[r == 1][0] in x[r == 0] and (height == 1).all()


def test_real_weights_give_the_weighted_similarity():
    """Signatures of sets with weights 1 + ln(count) agree as often as the sum of least by the sum of greatest weights."""
    rng = np.random.default_rng(8)
    items = rng.integers(0, 2**63, 300, dtype=np.uint64)
    counts = rng.integers(1, 9, (2, 300))
    h = np.concatenate([np.repeat(items, counts[0]), np.repeat(items, counts[1])])
    x, r, height = weighted_set(h, np.repeat([0, 1], counts.sum(1)), "log")
    w = 1 + np.log(counts)
    assert np.allclose([height[r == i].sum() for i in (0, 1)], w.sum(1), rtol=1e-5)
    s = dart_signatures(x, r, 2, 4000, height)
    want = np.minimum(*w).sum() / np.maximum(*w).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    order = [np.argsort(x[r == i]) for i in (0, 1)]
    sets = [(x[r == i][o], height[r == i][o]) for i, o in enumerate(order)]
    assert alike(*sets, want - 0.001) and not alike(*sets, want + 0.001)


@pytest.mark.parametrize("leaders", [1, 8])
def test_classes_against_brute_force(spark, monkeypatch, leaders):
    import sightline.llm.near_dup as module

    monkeypatch.setattr(module, "LEADERS", leaders)
    monkeypatch.setattr(module, "BLOCK", 7)
    rng = random.Random(leaders)
    rows, n = [], 0
    for _ in range(6):
        base = text(rng).split()
        for edits in [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6]:
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, text(rng)) for i in range(20)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, two!"), (905, "one two three"), (0, rows[0][1]), (None, rows[0][1]), (906, "word " * 30_000)]
    out = near_duplicates(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, keys int")).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == want
    assert [r.class_id for r in out if r.doc_id is None] == [None]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(5)
    a, b, c, d, e = (text(rng) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, d), (5, None), (6, "?"), (6, None), (7, e), (8, e + " end"), (8, d), (None, a), (9, ""), (9, c + " more")]
    out = near_duplicates(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()
    assert len(out) == 2 * len(rows)
    assert {(r.doc_id, r.class_id) for r in out if r.doc_id is not None} == set(brute(rows).items()) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 5), (8, 5), (9, 4)}


@pytest.mark.parametrize("weights", ["count", "log"])
def test_weighted_classes(spark, weights):
    rng = random.Random(6)
    base = text(rng)
    rows = [(1, base), (2, base + " tail of it"), (3, base + " " + " ".join(["one two three four five"] * 20)), (4, text(rng))]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weights=weights).collect()}
    assert got == {1: 1, 2: 1, 3: 3 if weights == "count" else 1, 4: 4}


def test_block_comparison_finds_the_links_of_a_bucket(spark, monkeypatch):
    import sightline.llm.near_dup as module

    monkeypatch.setattr(module, "BLOCK", 4)
    rng = random.Random(9)
    base = text(rng).split()
    rows = [(i, " ".join(base[:110] + [f"x{i}"] * 10)) for i in range(12)] + [(20 + i, text(rng)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same = module.signed(docs, 5, "binary", 25, 5).withColumn("node", module.F.col("doc_id"))
    texts = module.Texts(same, docs, False, 5, 0.8, "binary", 125)
    rest = spark.createDataFrame([(1, i, i, 20) for i, _ in rows], "key long, node long, component long, main long")
    links = {(r.a, r.b) for r in texts.across(rest).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert links == {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
