from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.llm.language_id import identified, language_of, temperature, train
from sightline.llm.toxicity import Network, affixes, inner, sigmoid, toxicity, windows_of
from sightline.llm.wordhash import words_of


def test_language_accuracy_on_held_out_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_defined_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the and of " * 50_000, "x"), (None, "und der die das ist nicht", "x")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in identified(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[4].lang_pred == "en" and rows[None].lang_pred == "de"
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_of(none).collect()] == [("und", 0.0)]
    assert language_of(none.limit(0)).count() == 0


def test_language_against_brute_force(spark, sf, monkeypatch):
    """Scores from single n-grams counted one by one, with texts cut at any place; repeated rows and clashing columns."""
    import sightline.llm.language_id as module

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs)
    texts = [t for (t,) in docs.select("text").limit(12).collect()] + ["ΑΣ ΣΑΣ", "ab", "a", "İstanbul", "漢字" * 50]
    monkeypatch.setattr(module, "CHUNK", 37)
    got = model.probabilities(texts)
    for t, p in zip(texts, got):
        t = t.lower() + "\n"
        total, n_all = np.zeros(len(model.languages)), 0
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                code = np.frombuffer(t[i : i + n].encode("utf-32-le"), np.uint32)
                total += model.weights[module.grams(code)[n - 1][0]]
                n_all += 1
        z = (total / n_all + model.bias) / model.temperature
        assert np.allclose(p, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-6)
    for (at, count), t in zip(module.counts_of(texts), texts):
        t = t.lower() + "\n"
        want = Counter(int(module.grams(np.frombuffer(t[i : i + n].encode("utf-32-le"), np.uint32))[n - 1][0]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
        assert dict(zip(at.tolist(), count.tolist())) == want
    twice = docs.union(docs).withColumn("score", F.lit("clash")).withColumn("h", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    one, two = sorted(map(tuple, language_of(docs).collect())), sorted(map(tuple, language_of(twice.repartition(7)).collect()))
    assert [r[2] for r in two] == [r[2] for r in one for _ in range(2)]
    odd = spark.createDataFrame([(4, "some words here", "en"), (4, "einige Wörter hier", "de"), (4, "some words here", "de")] * 20, "doc_id long, text string, lang string")
    assert sorted(map(tuple, language_of(odd).collect())) == sorted(map(tuple, language_of(odd.repartition(5)).collect()))


def test_lang_of_a_held_out_row_is_no_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    lied = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted(tuple(r) for r in language_of(df).collect())
    assert key(docs) == key(lied)


def test_temperature_softens_overconfident_logits():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((4000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(temperature(5 * z, y) - 5) < 0.5


def test_network_gradients():
    rng = np.random.default_rng(2)
    net = Network(rng, d=3, h=4, a=5)
    x, mask, y = rng.standard_normal((6, 7, 3)), np.ones((6, 7)), np.array([0, 1, 1, 0, 1, 0.0])
    mask[2, 4:] = 0
    x *= mask[:, :, None]
    loss = lambda: float((np.log1p(np.exp(z := net.forward(x, mask))) - y * z).sum())
    z, cache = net.forward(x, mask, keep=True)
    grads = net.backward(cache, sigmoid(z) - y)
    gx = grads.pop("x")
    for i in ((0, 0, 0), (1, 3, 2), (2, 2, 1), (5, 6, 0)):
        was, e = x[i], 1e-5
        x[i] = was + e
        up = loss()
        x[i] = was - e
        down = loss()
        x[i] = was
        assert abs((up - down) / (2 * e) - gx[i]) < 1e-5
    for name, g in grads.items():
        flat, gf = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in rng.permutation(len(flat))[:5]:
            was, e = flat[i], 1e-5
            flat[i] = was + e
            up = loss()
            flat[i] = was - e
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * e) - gf[i]) < 1e-5, name


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 37, 37 + 32, 200])
    row, start, end = windows_of(first)
    for r in range(5):
        seen = set()
        for a, b in zip(start[row == r], end[row == r]):
            assert first[r] <= a < b <= first[r + 1] and b - a <= 32
            seen |= set(range(a, b))
        assert seen == set(range(first[r], first[r + 1]))


def test_words_with_a_common_beginning_share_character_inputs():
    w = next(words_of(pa.array(["preface prefab", "preface"])))
    slots, (runs, owner) = affixes(w), inner(w)
    assert slots[0, 0] == slots[2, 0] != slots[1, 0]
    assert set(slots[0, 1:5]) & set(slots[1, 1:5])
    assert len(runs[owner == 0]) == len("preface") - 6


def test_toxicity_scores_against_brute_force(spark):
    """Every window of a text one by one, words and affixes looked up alone; the score is that of the likeliest window."""
    from sightline.llm import toxicity as module

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    texts = [t for (t,) in docs.select("text").orderBy("doc_id").limit(15).collect()] + ["", "one", "漢字" * 200, "word " * 33]
    for text in texts:
        w = next(words_of(pa.array([text])))
        x = []
        for k in range(len(w.start)):
            own = next(words_of(pa.array([w.text(k, k + 1).decode()])))
            slots, (runs, _) = affixes(own), inner(own)
            seen = [model.table[i] for i in [*slots[0, 1:][slots[0, 1:] >= 0], *runs]] or [0.0]
            odds = [model.table[slots[0, 0]], max(seen), min(seen), np.mean(seen), min(6, np.log1p(w.end[k] - w.start[k])) - 1.8]
            learned = [model.vectors.affix[i >> (module.BITS - module.LEARNED_BITS)] for i in slots[0, 1:] if i >= 0]
            x.append([*odds, *model.vectors.word[slots[0, 0] >> (module.BITS - module.LEARNED_BITS)], *(np.sum(learned, 0) / max(1, len(learned)) if learned else np.zeros(module.LEARNED))])
        x = np.array(x).reshape(-1, module.INPUTS)
        begins = {min(a, max(0, len(x) - 32)) for a in range(0, max(1, len(x) - 32 + 16), 16)} if len(x) else ()
        best = max((float(model.network.forward(x[None, a : a + 32], np.ones((1, len(x[a : a + 32]))))[0]) for a in begins), default=None)
        want = 0.0 if best is None else sigmoid(model.slope * best + model.shift)
        assert abs(model.scores(w)[0] - want) < 1e-4


def test_toxicity_repeats_clashes_and_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    clash = docs.withColumn("toxic", F.lit("x")).withColumn("h", F.lit("x")).withColumn("score", F.lit("x"))
    one = sorted(map(tuple, toxicity(docs, labels).collect()))
    two = sorted(map(tuple, toxicity(clash.union(clash).repartition(9), labels.union(labels).withColumn("text", F.lit("x"))).collect()))
    assert [r[:2] + r[3:] for r in two] == [r[:2] + r[3:] for r in one for _ in range(2)]
    assert max(abs(a[2] - b[2]) for a, b in zip(two, [r for r in one for _ in range(2)])) < 1e-4  # sums in another order
    assert toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_held_out_and_defined_cases(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "?!"), (None, "fine words"), (10**9 + 3, "you pathetic worthless idiot, stupid scum and loser")], "doc_id long, text string")
    rows = toxicity(docs.select("doc_id", "text").union(odd), labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    by = {r.doc_id: r for r in rows}
    assert [by[10**9 + i].score for i in range(3)] == [0, 0, 0] and by[10**9 + 3].predicted == 1 and by[None].score < 0.5
    held = [r for r in rows if r.held_out and r.toxic is not None]
    recall = np.mean([r.predicted for r in held if r.toxic == 1])
    false = np.mean([r.predicted for r in held if r.toxic == 0])
    assert recall > 0.8 and false < 0.06
    empty = labels.limit(0)
    assert {r.score for r in toxicity(odd, empty).collect()} == {0.0}


def test_all_windows_of_a_long_text_are_learned_from(spark):
    """What makes a text toxic stands once in 190 windows, after others that look worse at first: no window is left out of the fit."""
    from sightline.llm import toxicity as module

    rng = np.random.default_rng(3)
    w = lambda n: " ".join(rng.choice(["calm", "plain", "words", "that", "say", "little"], n))
    docs = [(i, w(1500) + (" vile foul curse " * 3 if i % 2 else " ") + w(1500)) for i in range(40)]
    docs += [(i + 1000, docs[i][1]) for i in range(3)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(5000 + i, 1, 0) for i in range(3000)], "doc_id long, toxic int, quality int")
    rows = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels, 40).collect()
    assert len(rows) == 43 and all(r.predicted == r.doc_id % 2 for r in rows), "labels without documents take no place in the sample"
    assert module.OTHERS == 4
