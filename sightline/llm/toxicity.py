"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

Inputs of a word are two learned vectors, of the word and of its affixes (prefixes and suffixes of UTF-8 bytes), and what
a bounded labelled sample says of it: the smoothed log-odds of the word, and of its characters (affixes and inner runs:
their largest, smallest and mean). In learning, the log-odds that a document sees come from the other parts of
the sample, never from itself. The network reads overlapping windows of WINDOW words, each new one STRIDE words on, in both
directions; attention pools the states of a window into a logit. A label marks a whole document, so a toxic document's
windows are learned as a bag: the likeliest window of the bag counts as toxic, the others take no part. The score of a
text is the calibrated logit of its likeliest window, over all windows of the whole text.

Learned from: rows with a label whose `crc32(doc_id as text) mod 5` is not 0, SAMPLE of each label value with the
smallest hashes of doc_id (and of text, for rows that share one), of the labels whose documents are there. Tasks read their whole texts; to the driver go
the inputs of all their words, some 40 bytes each, and the fit looks at all windows of them. Rows alone are bounded. Scores use text alone.

Defined cases: a text without words (null, empty) scores 0; if nothing can be learned from (no labels, or one value
only), all score 0; a null doc_id counts as not held out and has no label; null labels are left out; a doc_id with
several labels is toxic if one says so; rows that repeat get equal scores and are learned from once; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, only, spans_of
from .wordhash import Words, mix, words_of

WINDOW, STRIDE = 32, 16
SAMPLE, FOLDS = 1_200, 4
#: Further windows of a row that is not toxic that an epoch learns from, beside its likeliest.
OTHERS = 4
#: Looks at all windows at most, however often a small sample is read.
LOOKS = 12
BITS, LEARNED_BITS, LEARNED, HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 17, 13, 4, 8, 8, 6, 128, 0.01
PREFIXES, SUFFIXES, RUN = (3, 4, 5, 6), (3, 4, 5), 5
ODDS, AFFIXES = 5, 7
INPUTS = ODDS + 2 * LEARNED
#: Pseudo-count of the log-odds.
PRIOR = 1.0
#: Gradient steps at least; small samples are read more often.
UPDATES = 300
ROWS_AT_ONCE = 2_048
#: The learned vector of what is not there.
NONE = 1 << LEARNED_BITS


def slot(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> np.uint64(64 - BITS)).astype(np.int32)


def affixes(w: Words) -> np.ndarray:
    """(words, 1 + AFFIXES) slots of each word and its prefixes and suffixes; -1 where the word is too short."""
    size = w.end - w.start
    out = np.full((len(size), 1 + AFFIXES), -1, np.int32)
    out[:, 0] = slot(w.hash, 1)
    for k, (kind, n) in enumerate([(1, n) for n in PREFIXES] + [(2, n) for n in SUFFIXES], 1):
        at = np.flatnonzero(size >= n)
        a = w.start[at] if kind == 1 else w.end[at] - n
        out[at, k] = slot(w.stretch(a, a + n), kind * 100 + n)
    return out


def inner(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(slots, the word of each) of the runs of RUN bytes that are neither the prefix nor the suffix of a word."""
    size = w.end - w.start
    at = np.flatnonzero(size > RUN)
    more = size[at] - RUN - 1
    begin = np.repeat(w.start[at] + 1, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    return slot(w.stretch(begin, begin + RUN), 300), np.repeat(at, more)


def odds_of(w: Words, slots: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(words, ODDS): log-odds of the word; largest, smallest and mean of its characters'; its length."""
    out = np.zeros((len(slots), ODDS), np.float32)
    if not len(slots):
        return out
    some = slots[:, 1:] >= 0
    v = np.where(some, table[slots[:, 1:]], 0)
    n, total = some.sum(1), v.sum(1)
    high, low = np.where(some, v, -np.inf).max(1), np.where(some, v, np.inf).min(1)
    runs, owner = inner(w)
    if len(runs):
        v = table[runs]
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        whose = owner[head]
        high[whose] = np.maximum(high[whose], np.maximum.reduceat(v, head))
        low[whose] = np.minimum(low[whose], np.minimum.reduceat(v, head))
        total[whose] += np.add.reduceat(v, head)
        n[whose] += np.diff(np.append(head, len(v)))
    out[:, 0] = table[slots[:, 0]]
    out[:, 1], out[:, 2], out[:, 3] = np.where(n > 0, high, 0), np.where(n > 0, low, 0), total / np.maximum(n, 1)
    out[:, 4] = np.minimum(np.log1p(w.end - w.start), 6) - 1.8
    return out


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all windows, from the index of each row's first word."""
    count = np.diff(first)
    n = np.where(count > WINDOW, 1 + -(-(count - WINDOW) // STRIDE), (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[row] + np.minimum(k * STRIDE, np.maximum(count[row] - WINDOW, 0))
    return row, start, np.minimum(start + WINDOW, first[row + 1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers, one for each direction, attention over both, and a logit."""

    def __init__(self, rng: np.random.Generator, d: int = INPUTS, h: int = HIDDEN, a: int = ATTENTION):
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {}
        for side in "fb":
            self.p |= {f"W{side}": g(d, 3 * h), f"U{side}": g(h, 3 * h), f"c{side}": np.zeros(3 * h)}
        self.p |= {"A": g(2 * h, a), "e": np.zeros(a), "v": g(a), "o": g(2 * h), "q": np.zeros(1)}
        self.h = h

    def to_float32(self) -> Network:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def gates(self, x, side):
        return x @ self.p[f"W{side}"] + self.p[f"c{side}"]

    def _side(self, gates, mask, side, keep):
        h, U = self.h, self.p[f"U{side}"]
        n, length = mask.shape
        steps = range(length) if side == "f" else range(length - 1, -1, -1)
        state, out, cache = np.zeros((n, h), gates.dtype), np.zeros((n, length, h), gates.dtype), []
        for t in steps:
            u = state @ U
            zr = sigmoid(gates[:, t, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[:, t, 2 * h :] + r * u[:, 2 * h :])
            m = mask[:, t, None]
            before, state = state, state + m * (1 - z) * (new - state)
            out[:, t] = state
            if keep:
                cache.append((t, before, z, r, new, u[:, 2 * h :], m))
        return out, cache

    def forward(self, x, mask, keep=False):
        """Logits of windows from their inputs."""
        logit, cache = self.pooled(self.gates(x, "f"), self.gates(x, "b"), mask, keep)
        return (logit, (x, *cache)) if keep else logit

    def pooled(self, forth, back, mask, keep=False):
        f, cf = self._side(forth, mask, "f", keep)
        b, cb = self._side(back, mask, "b", keep)
        states = np.concatenate([f, b], 2)
        u = np.tanh(states @ self.p["A"] + self.p["e"])
        s = np.where(mask > 0, u @ self.p["v"], -1e9)
        e = np.exp(s - s.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = (alpha[:, :, None] * states).sum(1)
        return pooled @ self.p["o"] + self.p["q"], (cf, cb, states, u, alpha, pooled)

    def backward(self, cache, d_logit):
        """Gradients of the parameters, and at "x" of the inputs."""
        x, cf, cb, states, u, alpha, pooled = cache
        p, h = self.p, self.h
        g = {"o": pooled.T @ d_logit, "q": np.array([d_logit.sum()]), "x": 0.0}
        d_pooled = d_logit[:, None] * p["o"]
        d_alpha = (states * d_pooled[:, None, :]).sum(2)
        d_states = alpha[:, :, None] * d_pooled[:, None, :]
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
        g["v"] = (u * d_s[:, :, None]).sum((0, 1))
        d_u = d_s[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["e"] = np.einsum("btk,bta->ka", states, d_u), d_u.sum((0, 1))
        d_states = d_states + d_u @ p["A"].T
        for side, c, d_out in (("f", cf, d_states[:, :, :h]), ("b", cb, d_states[:, :, h:])):
            U, d_state = p[f"U{side}"], np.zeros((len(x), h))
            gU, d_gates = np.zeros_like(U), np.zeros((*x.shape[:2], 3 * h))
            for t, before, z, r, new, un, m in reversed(c):
                d_state = d_state + d_out[:, t]
                d_new = d_state * m * (1 - z) * (1 - new * new)
                d_z = d_state * m * (before - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                d_gates[:, t] = np.concatenate([d_z, d_r, d_new], 1)
                d_un = np.concatenate([d_z, d_r, d_new * r], 1)
                gU += before.T @ d_un
                d_state = d_state * (1 - m * (1 - z)) + d_un @ U.T
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = gU, np.einsum("btd,btg->dg", x, d_gates), d_gates.sum((0, 1))
            g["x"] = g["x"] + d_gates @ p[f"W{side}"].T
        return g


def learned_rows(slots: np.ndarray) -> np.ndarray:
    """Which learned vectors stand for the slots of `affixes`."""
    return np.where(slots >= 0, slots >> (BITS - LEARNED_BITS), NONE).astype(np.uint16)


class Vectors:
    """Learned vectors of words and of affixes. They begin at zero, so what was never seen says nothing."""

    def __init__(self):
        self.word, self.affix = (np.zeros((NONE + 1, LEARNED), np.float32) for _ in range(2))
        self.seen = [np.full(len(t), 1e-3) for t in (self.word, self.affix)]

    def of(self, at: np.ndarray) -> np.ndarray:
        """(..., 2 * LEARNED) inputs from `learned_rows`."""
        n = np.maximum(1, (at[..., 1:] < NONE).sum(-1))[..., None]
        return np.concatenate([self.word[at[..., 0]], self.affix[at[..., 1:]].sum(-2) / n.astype(np.float32)], -1)

    def learn(self, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """A step of Adagrad, with one sum of squares for each vector."""
        some = (at[..., 1:] < NONE)[..., None]
        share = np.where(some, grad[..., None, LEARNED:] / np.maximum(1, some.sum(-2, keepdims=True)), 0)
        for k, (table, i, g) in enumerate([(self.word, at[..., 0], grad[..., :LEARNED]), (self.affix, at[..., 1:], share)]):
            rows, whose = np.unique(i, return_inverse=True)
            total = np.zeros((len(rows), LEARNED))
            np.add.at(total, whose.reshape(-1), g.reshape(-1, LEARNED))
            self.seen[k][rows] += (total * total).mean(1)
            table[rows] -= (rate * total / np.sqrt(self.seen[k][rows])[:, None]).astype(np.float32)
            table[-1] = 0


@dataclass
class ToxicityModel:
    table: np.ndarray
    vectors: Vectors
    network: Network
    slope: float
    shift: float

    def logits(self, w: Words) -> np.ndarray:
        """The largest window logit of each row; -inf for a row without words."""
        out = np.full(w.hi - w.lo, -np.inf)
        slots = affixes(w)
        x = np.concatenate([odds_of(w, slots, self.table), self.vectors.of(learned_rows(slots))], 1)
        forth, back = self.network.gates(x, "f"), self.network.gates(x, "b")  # of each word once, whatever windows it is in
        row, start, end = windows_of(w.first)
        for lo in range(0, len(row), ROWS_AT_ONCE):
            part = slice(lo, lo + ROWS_AT_ONCE)
            at, mask = places(start[part], end[part], len(x))
            np.maximum.at(out, row[part], self.network.pooled(forth[at], back[at], mask.astype(np.float32))[0])
        return out

    def scores(self, w: Words) -> np.ndarray:
        z = self.logits(w)
        return np.where(np.isfinite(z), np.round(sigmoid(self.slope * np.where(np.isfinite(z), z, 0) + self.shift), 6), 0.0)


def places(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, mask) of windows, as wide as the widest of them."""
    at = start[:, None] + np.arange(min(WINDOW, int((end - start).max())))
    return np.minimum(at, n - 1), at < end[:, None]


def log_odds(count: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each slot, from how many of the `docs` (2) documents of each label hold it (2, slots).

    Counts are held against those expected if the slot had nothing to do with the label, so an unseen slot is at zero.
    """
    expected = count.sum(0) * (docs / max(1, docs.sum()))[:, None]
    odds = np.log((count + PRIOR) / (expected + PRIOR))
    return (odds[1] - odds[0]).astype(np.float32)


@dataclass
class Row:
    """A labelled row's words: log-odds inputs (words, ODDS) and learned_rows (words, 1 + AFFIXES)."""

    toxic: int
    odds: np.ndarray
    at: np.ndarray


def fit(rows: list[Row], held: np.ndarray, table: np.ndarray) -> ToxicityModel | None:
    """The rows that are `held` calibrate the scores; the others are learned from. Each has a word at least. Empties `rows`."""
    y = np.array([r.toxic for r in rows])
    if len(set(y[~held].tolist())) < 2:
        return None
    rng = np.random.default_rng(5)
    network, vectors, state = Network(rng), Vectors(), {}
    learn = np.flatnonzero(~held)
    epochs = max(EPOCHS, -(-UPDATES * BATCH // (len(learn) * 4)))
    again = max(1, epochs // LOOKS)  # epochs from one look at all windows to the next
    word = np.concatenate([[0], np.cumsum([len(r.odds) for r in rows])])  # each row's first word
    odds, at = (np.concatenate([getattr(r, name) for r in rows]) for name in ("odds", "at"))
    rows.clear()  # the driver holds the words once
    row, start, end = windows_of(word)
    first = np.searchsorted(row, np.arange(len(y) + 1))  # each row's first window

    def inputs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, mask, numbers of the words) of windows."""
        i, mask = places(start[k], end[k], len(odds))
        return np.concatenate([odds[i], vectors.of(at[i])], 2) * mask[:, :, None], mask.astype(np.float32), i

    def looked_at(of_words) -> np.ndarray:
        """A value of every window: of_words(lo, hi) gives that of places and masks among the words lo..hi-1."""
        out = np.empty(len(row))
        for a, b in spans_of(word, 40_000):
            value = of_words(int(word[a]), int(word[b]))
            for lo in range(first[a], first[b], ROWS_AT_ONCE):
                hi = min(lo + ROWS_AT_ONCE, first[b])
                out[lo:hi] = value(*places(start[lo:hi] - word[a], end[lo:hi] - word[a], int(word[b] - word[a])))
        return out

    def likelihoods(lo: int, hi: int):
        x = np.concatenate([odds[lo:hi], vectors.of(at[lo:hi])], 1)
        forth, back = network.gates(x, "f"), network.gates(x, "b")
        return lambda i, mask: network.pooled(forth[i], back[i], mask.astype(np.float32))[0]

    def largest_odds(lo: int, hi: int):
        most = odds[lo:hi, :2].max(1)
        return lambda i, mask: np.where(mask, most[i], -np.inf).max(1)

    for epoch in range(epochs):
        if epoch % again == 0:
            z = looked_at(likelihoods if epoch else largest_odds)
        pick, t = [], []
        for d in learn.tolist():
            own = np.arange(first[d], first[d + 1])
            best = int(own[np.argmax(z[own])])  # the likeliest window; at first, the one with the largest log-odds
            now = [best] if y[d] else [best, *(i for i in rng.permutation(own)[:OTHERS].tolist() if i != best)]
            pick += now
            t += [y[d]] * len(now)
        order = rng.permutation(len(pick))
        pick, t = np.array(pick)[order], np.array(t, np.float64)[order]
        weight = np.where(t > 0, (t == 0).sum() / max(1, (t > 0).sum()), 1.0) ** 0.5
        rate = RATE * (0.5 if epoch >= epochs - 2 else 1)
        for part in np.array_split(np.arange(len(pick)), max(1, len(pick) // BATCH)):
            x, live, i = inputs(pick[part])
            logit, cache = network.forward(x, live, keep=True)
            grads = network.backward(cache, weight[part] * (sigmoid(logit) - t[part]) / weight[part].sum())
            vectors.learn(at[i][live > 0], grads.pop("x")[live > 0][:, ODDS:], rate)
            adam(network, grads, rate, state)
    best = np.maximum.reduceat(looked_at(likelihoods), first[:-1])
    use = np.flatnonzero(held) if len(set(y[held].tolist())) == 2 else np.arange(len(y))
    a, b = platt(best[use], y[use])
    return ToxicityModel(table, vectors, network.to_float32(), a, b)


def adam(network: Network, grads: dict, rate: float, state: dict) -> None:
    state["t"] = t = state.get("t", 0) + 1
    for k, g in grads.items():
        m, v = state.get(k, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        state[k] = m, v
        network.p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-back logits, by Newton steps with a little shrinkage to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + b * 0.1])
        s = p * (1 - p)
        hess = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.05)), float(b)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(h, x, fold, toxic, text) of the rows to learn from, each once."""
    named = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("_id"), "toxic", F.xxhash64(F.lit(3), "doc_id").alias("h"))
    named = durable(named.hint("merge").join(only(docs, "doc_id").hint("merge"), F.col("_id") == F.col("doc_id"), "left_semi"))
    few = durable(named.where("toxic = 0").orderBy("h").limit(sample).union(named.where("toxic = 1").orderBy("h").limit(sample)))
    rows = only(docs, "doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"))  # of ids, 2 * sample at most
    rows = rows.select("h", F.xxhash64("text").alias("x"), F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "toxic", "text")
    keys = rows.select("toxic", "h", "x").distinct()
    chosen = durable(keys.where("toxic = 0").orderBy("h", "x").limit(sample).union(keys.where("toxic = 1").orderBy("h", "x").limit(sample)))
    return durable(rows.join(F.broadcast(chosen.drop("toxic")), ["h", "x"]).dropDuplicates(["h", "x"]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel | None:
    rows, spark = sampled(docs, labels, sample), docs.sparkSession
    n = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    if {y for _, y in n} != {0, 1}:
        return None

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of each fold and label hold each slot; FOLDS * 2 * 2^BITS rows at most."""
        count = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
        for batch in freed(batches):
            fold, toxic = (batch.column(i).to_numpy() for i in (0, 1))
            for w in words_of(batch.column(2), 100_000):
                slots, (runs, owner) = affixes(w), inner(w)
                row = w.row[owner]
                for r in range(w.hi - w.lo):
                    a, b = np.searchsorted(row, [r, r + 1])
                    seen = np.unique(np.concatenate([slots[w.first[r] : w.first[r + 1]].reshape(-1), runs[a:b]]))
                    count[fold[w.lo + r], toxic[w.lo + r], seen[seen >= 0]] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.reshape(-1)[at], pa.int64())], ["at", "n"])

    found = rows.select("fold", "toxic", "text").mapInArrow(held, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    count, docs_of = np.zeros(FOLDS * 2 << BITS, np.float32), np.array([[n.get((f, y), 0) for y in (0, 1)] for f in range(FOLDS)])
    count[found["at"].to_numpy()] = found["n"].to_numpy()
    count = count.reshape(FOLDS, 2, 1 << BITS)
    tables = np.stack([log_odds(count.sum(0) - count[f], docs_of.sum(0) - docs_of[f]) for f in range(FOLDS)])
    sent = spark.sparkContext.broadcast(tables)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            fold = batch.column(0).to_numpy()
            for w in words_of(batch.column(3), 1):  # a row at a time
                if len(w.start):
                    slots = affixes(w)
                    value = [odds_of(w, slots, sent.value[fold[w.lo]]), learned_rows(slots)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(w.lo, 1) for i in range(3)), *(pa.array([v.tobytes()], pa.binary()) for v in value)], ["fold", "toxic", "h", "odds", "at"])

    got = rows.select("fold", "toxic", "h", "text").mapInArrow(read, "fold int, toxic int, h long, odds binary, at binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["h", "toxic", "at"], kind="stable")
    words = [Row(int(r.toxic), np.frombuffer(r.odds, np.float32).reshape(-1, ODDS), np.frombuffer(r.at, np.uint16).reshape(-1, 1 + AFFIXES)) for r in got.itertuples()]
    kept, table = got["fold"].to_numpy() == FOLDS - 1, log_odds(count.sum(0), docs_of.sum(0))
    del got, count, found, tables
    return fit(words, kept, table)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document row."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in freed(batches):
            for w in words_of(batch.column(1), 100_000):
                score = model.scores(w) if model else np.zeros(w.hi - w.lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(score)], ["doc_id", "score"])

    scored = only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
