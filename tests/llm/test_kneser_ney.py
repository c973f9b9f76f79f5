import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import sightline.llm.kneser_ney as module
from sightline.llm.kneser_ney import FALLBACK, corpus_scores, train

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
S, E = object(), object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), E]


def discounts(counts):
    n = [sum(c == k for c in counts.values()) for k in range(5)]
    if min(n[1:]) == 0:
        return FALLBACK
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else FALLBACK


class Brute:
    """The model by dictionaries of tuples."""

    def __init__(self, texts, order):
        self.order, top, self.raw = order, Counter(), Counter()
        for t in texts:
            w = [S, *tokens(t)]
            self.raw.update(w[1:])
            for i in range(1, len(w)):
                top[tuple(w[max(0, i - order + 1) : i + 1])] += 1
        self.levels = {}
        rows = top
        for k in range(order, 0, -1):
            own = {g: n for g, n in rows.items() if len(g) == k}
            self.levels[k] = own
            rows = Counter({g: n for g, n in rows.items() if len(g) < k})
            rows.update(Counter(g[1:] for g in own))
        self.d = {k: discounts(v) for k, v in self.levels.items()}
        self.after = {k: defaultdict(list) for k in self.levels}
        for k, v in self.levels.items():
            for g, n in v.items():
                self.after[k][g[:-1]].append(n)

    def p(self, gram):
        k = len(gram)
        low = self.p(gram[1:]) if k > 1 else 1 / (len(self.raw) + 1)
        there = self.after[k].get(gram[:-1])
        if not there:
            return low
        n, d = self.levels[k].get(gram, 0), (0, *self.d[k])
        return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in there) * low) / sum(there)

    def score(self, text):
        w = [S, *tokens(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(w)))


def learned(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2


def corpus(n=300):
    rng = random.Random(3)
    words = ["alpha", "Beta", "γάμμα", "d4", "e,", "the", "É", "x" * 30]
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words[: rng.choice([2, 4, 8])]) for _ in range(rng.choice([0, 1, 3, 30])))) for i in range(n)]
    return docs + [(3, "alpha alpha"), (3, "alpha alpha"), (None, "null id"), (9001, None), (9002, ""), (9003, " \n "), (9004, "unseen words only"), (9005, "the " * 9000 + "end")]


def check(spark, docs, order):
    got = corpus_scores(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, held_out string"), order).collect()
    model = Brute([t for i, t in docs if learned(i)], order)
    n = sum(model.raw.values())
    want = []
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((model.raw[x] + 1) / (n + len(model.raw) + 1)) for x in w)
        want.append((str(i), not learned(i), len(w), sum(model.raw[x] > 0 for x in w), n, base, model.score(t)))
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 4))
    got = sorted([(str(r[0]), *r[1:]) for r in got], key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_equals_a_model_of_dictionaries(spark, order):
    check(spark, corpus(), order)


def test_long_texts_in_parts_and_frequent_words_over_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 300)  # in this process; long texts below are cut in the workers too
    s = [t for c in (["word " * 200 + "end", "x" * 2000 + " y", None, "", "a b"],) for t in module.stretches(pa.array(c), 3)]
    assert sum(int(x.own.sum()) for x in s) == 202 + 3 + 1 + 1 + 3
    check(spark, [(1, "long " * 150_000 + "tail of it"), (2, "x" * 900_000 + " y x y"), (4, "y x")], 3)


def test_probabilities_sum_to_one(spark):
    docs = corpus(60)
    model = train(spark.createDataFrame(docs, "doc_id long, text string"), 3)
    brute = Brute([t for _, t in docs], 3)
    for context in ((S,), (S, "alpha"), ("alpha", "beta"), ("never", "the")):
        assert sum(brute.p((*context, w)) for w in [*brute.raw, "unknown"]) == pytest.approx(1)
    assert model.known == len(brute.raw) and model.tokens == sum(brute.raw.values())


def test_nothing_to_learn_from(spark):
    assert corpus_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if not learned(i))
    (row,) = corpus_scores(spark.createDataFrame([(held, "two words")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_held_out_texts_are_likelier_than_by_single_words(spark, sf_small):
    rows = corpus_scores(spark.read.parquet(f"{sf_small}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
