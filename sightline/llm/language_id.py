"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text, weighted by term frequency (as a share of the
text's n-grams of that length) times inverse document frequency. Document frequencies come from all rows that may be
learned from, summed in Spark. The weights are fitted with follow-the-regularised-leader (FTRL-proximal) under an
elastic-net penalty on a bounded sample, SAMPLE rows with the smallest hashes of doc_id (then text and lang), which is the same at every size
of the input; a fifth of it is kept back to fit the softmax temperature.

Learned from: rows with text and lang whose `crc32(doc_id as text) mod 4` is not 2. Predictions use text alone.

Defined cases: `und` with score 0 for a text that is null or has no letter, or if nothing can be learned from; a null
doc_id counts as not held out; texts of any length are read whole, in parts of CHUNK; rows that repeat get equal results and are learned from once; columns beyond
doc_id, text and lang play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import durable, freed, only, slices

BITS, ORDERS = 16, (1, 2, 3)
SAMPLE = 2_000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.5, 1.0, 2e-3, 1e-3
#: Code points handled at once.
CHUNK = 200_000
SCALE = 30.0



@dataclass
class Piece:
    """Code points of several rows' texts, one after the other; of a long text, a part."""

    code: np.ndarray
    row: list[int]
    start: np.ndarray
    end: np.ndarray
    more: np.ndarray  # code points that follow the row's own here, up to two; the next part begins with them

    def spans(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the n-grams that belong to each row here."""
        return self.start, np.maximum(self.start, np.minimum(self.end, self.end + self.more - n + 1))


def pieces(texts: list[str]) -> Iterator[Piece]:
    """All texts, lower-cased and each with a line feed at its end, in parts of about CHUNK code points."""
    held, size = [], 0

    def packed() -> Piece:
        code = np.frombuffer("".join(t for _, t, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in held])])
        more = np.array([m for _, _, m in held])
        return Piece(code, [r for r, _, _ in held], off[:-1], off[1:] - more, more)

    for r, text in enumerate(texts):
        text = text.lower() + "\n"
        for lo in range(0, len(text), CHUNK):
            part = text[lo : lo + CHUNK + 2]
            held.append((r, part, max(0, len(part) - CHUNK)))
            size += len(part)
            if size >= CHUNK:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def grams(code: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the n-grams that begin at each place, for each order. The last n-1 reach beyond and are dropped by the caller."""
    out, h = [], np.zeros(len(code), np.uint32)
    for n in ORDERS:
        h = h * np.uint32(0x01000193)
        h[: len(code) - n + 1] += code[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        f = h ^ (h >> np.uint32(15))
        f = f * np.uint32(0x85EBCA6B)
        f = f ^ (f >> np.uint32(13))
        out.append(((f * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def counts_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each text's n-grams, in order."""
    total = None
    for p in pieces(texts):
        every = [(g, *p.spans(n)) for n, g in zip(ORDERS, grams(p.code))]
        for k, last in enumerate((p.more == 0).tolist()):
            f = np.concatenate([g[a[k] : b[k]] for g, a, b in every])
            if last and total is None and len(f) < 1_000:
                yield np.unique(f, return_counts=True)
                continue
            total = np.bincount(f, minlength=1 << BITS) + (0 if total is None else total)
            if last:
                yield np.flatnonzero(total), total[total > 0]
                total = None


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (features, languages), idf and scale multiplied in
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        total, n_all = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for p in pieces(texts):
            for n, g in zip(ORDERS, grams(p.code)):
                w = self.weights[g]
                part = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w, axis=0, dtype=np.float64)])
                a, b = p.spans(n)
                np.add.at(total, p.row, part[b] - part[a])
                np.add.at(n_all, p.row, b - a)
        return softmax((total / np.maximum(1, n_all)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with a learning rate for each coordinate."""
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)).tolist():
            at, x = rows[r]
            w, b = weights(z[at], n[at]), weights(zb, nb)
            p = softmax(x @ w + b)
            p[labels[r]] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    return weights(z, n), weights(zb, nb)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()

    a, b, g = np.log(0.5), np.log(20.0), (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learnable(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held, F.lit(False)))


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    rows = only(learnable(docs), "doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in slices(freed(batches)):
            for at, _ in counts_of(batch.column(0).to_pylist()):
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["f", "n"])

    counts = only(rows, "text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts) or counts["n"].sum() == 0:
        return None
    total = int(counts.loc[counts["f"] == -1, "n"].sum())
    counts = counts[counts["f"] >= 0]
    idf = np.full(1 << BITS, np.log(1 + total))
    idf[counts["f"].to_numpy()] = np.log((1 + total) / (1 + counts["n"].to_numpy())) + 0.1  # common n-grams keep some weight

    # The rows with the smallest hashes of id, text and lang, each once: the same rows in the same order, however the table is dealt.
    order = [F.xxhash64(F.lit(17), "doc_id").alias("h"), F.xxhash64("text").alias("x"), "lang"]
    chosen = durable(rows.select(*order).distinct().orderBy("h", "x", "lang").limit(sample))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            at, counts = [], []
            for a, c in counts_of(batch.column(3).to_pylist()):
                at.append(a.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["h", "x", "lang", "at", "counts"])

    picked = rows.select(*order, "text").join(F.broadcast(chosen), ["h", "x", "lang"]).dropDuplicates(["h", "x", "lang"])  # `sample` rows at most
    picked = picked.select("h", "x", "lang", "text").mapInArrow(vectors, "h long, x long, lang string, at binary, counts binary").orderBy("h", "x", "lang").collect()
    languages = sorted({r["lang"] for r in picked})
    labels = np.array([languages.index(r["lang"]) for r in picked])
    xs = []
    for r in picked:
        at, count = np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int32)
        xs.append((at, SCALE * count / max(1, count.sum()) * idf[at]))
    kept = np.arange(len(xs)) % 5 == 4
    w, b = ftrl([x for x, k in zip(xs, kept) if not k], labels[~kept], len(languages))
    logits = np.array([x @ w[at] + b for (at, x), k in zip(xs, kept) if k]).reshape(-1, len(languages))
    return LanguageModel(languages, (w * (SCALE * idf)[:, None]).astype(np.float32), b, temperature(logits, labels[kept]))


def identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of `docs`, and lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(freed(batches)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ok = [m is not None and any(map(str.isalpha, t)) for t in texts]
            names, score = ["und"] * len(texts), [0.0] * len(texts)
            if any(ok):
                p = m.probabilities([t if k else "" for t, k in zip(texts, ok)])
                for i, (k, best) in enumerate(zip(ok, p.argmax(1).tolist())):
                    if k:
                        names[i], score[i] = m.languages[best], float(p[i, best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def language_of(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learned from the rows that may be learned from."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identified(only(docs, "doc_id", "text"), train(docs, sample)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
