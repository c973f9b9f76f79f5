import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sightline.llm.spelling import Sums, corpus_variants, near_words, variants

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def edits(w, letters):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}) - {w}


def at_one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) < 2 and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(counts):
    out = []
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and at_one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 5 * n:
            form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, len(near[w]), f and counts[f]))
    return sorted(out, key=str)


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def check(spark, docs):
    got = corpus_variants(spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int")).collect()
    want = brute(words_of(docs))
    assert sorted(map(tuple, got), key=str) == want
    return want


def test_equals_brute_force(spark):
    rng = random.Random(5)
    stems = ["window", "Éclairs", "straße", "letters", "better", "ÿøþæöä", "aaaaaa", "abababab"]
    docs = []
    for i in range(400):
        words = []
        for _ in range(rng.choice([0, 3, 40])):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                p = rng.randrange(len(w) + 1)
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abeé") + w[p + 1 :], w[:p] + rng.choice("ab") + w[p:]])
            words.append(rng.choice([w, w.upper(), w]))
        docs.append((rng.choice([i, i, None, 7]), rng.choice([" ", ", ", "1"]).join(words)))
    docs += [(1, None), (2, ""), (3, "x" * 3000 + " " + "x" * 3001), *[(4, ("y" * 70_000 + " ") * 5 + ("y" * 70_001 + " ") * 25)] * 2]
    want = check(spark, docs)
    assert max(len(w) for w, *_ in want) == 70_001 and sum(f is not None for _, f, *_ in want) > 50


def test_words_of_the_test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(check(spark, docs)) > 100


def test_chains_ties_repeats_and_nulls(spark):
    counts = [("aaaaaab", 5), ("aaaaaabc", 25), ("aaaaaabcd", 125), ("aaaaaabcde", 700), ("aaaaaabcdef", 2000), ("aaaaaabcdef", 1500), ("zzzzzz", 5), ("zzzzzy", 30), ("zzzzzx", 30), (None, 9), ("nonono", None)]
    got = {r.word: r for r in variants(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert len(got) == 8 and got["aaaaaab"].root == "aaaaaabcdef" and got["aaaaaab"].form == "aaaaaabc"
    assert (got["zzzzzz"].form, got["zzzzzz"].form_n, got["zzzzzz"].n_near) == ("zzzzzx", 30, 2)
    assert (got["zzzzzx"].form, got["zzzzzx"].root, got["zzzzzx"].n_near, got["aaaaaabcdef"].n) == (None, "zzzzzx", 2, 3500)
    assert variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        variants(spark.createDataFrame(counts, "word string, n long"), 1)


def test_neighbourhoods_hold_all_reduced_edits():
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(7)))
        around = {*Sums(w).neighbours(0, 99).tolist(), *Sums(w).own().tolist()}
        assert all(int(Sums(x).own()[0]) in around for x in edits(w, "abcé"))
        assert len(around) < 40 * (len(w) + 1)


def test_hub_of_many_near_words(spark):
    letters = [chr(c) for c in range(0xE0, 0xFF) if c != 0xF7]
    counts = [("center", 10_000)] + [("center"[:p] + c + "center"[p:], 6) for p in range(7) for c in letters]
    rows = near_words(spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counts)], "id long, word string, n long")).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.id] += 1
    assert by[0] == len(counts) - 1
