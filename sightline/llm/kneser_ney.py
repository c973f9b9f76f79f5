"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark.

A text's tokens are its words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end. A start stands before the first and
is context alone. Words are 64-bit hashes (two words of a vocabulary of a billion share one with a chance of 3 %), n-grams are
hashes of their context's hash and their last word.

Counting goes by levels, from the highest order down. Tasks count the n-grams of a stretch of texts; these are dealt to
parts, and the task that reads a part sums them, writes the part's sorted array of hashes with their counts to the folder that all workers
share, and hands on what the next lower order needs: how many words precede each suffix (its adjusted count), and, for
each context, its total and how many of its continuations were seen once, twice or more often. N-grams that begin
with the start keep their own count, as nothing precedes them. All n-grams of all learned texts are counted, none is pruned.

An n-gram's part is the highest bits of its hash, which are those of its context, so that most contexts lie together
and their counts meet before they move. Contexts that end in a frequent word (a two-thousandth of all tokens or more: at most 2,000 words,
found by a pass over all texts) take the bits of the whole n-gram, so a word or pair that makes up a third of a
corpus is dealt to all parts.

Scoring maps the arrays into memory: a worker looks the sorted, distinct hashes of a stretch of texts up part by part, so
each part is read forward once a stretch. p(w | h) = max(a(hw) - D(a(hw)), 0) / a(h.) + gamma(h) p(w | h'), where D depends on counts of 1, 2 or
more as Chen and Goodman have it and gamma is what the discounts leave; below the single words lies the uniform 1 / (V + 1), so
unknown words have probability too. Where one of the counts of counts 1 to 4 is zero, or a discount falls outside
of its range, that order takes discounts of 0.5, 1 and 1.5.

Defined cases: a null text is empty, and an empty one has the end alone; a null doc_id is the text '' in the hash that
holds rows out; with nothing to learn from, V and N are 0 and every probability is 1; rows that repeat are counted as
often; texts of any length are read in parts; columns beyond doc_id and text play no part.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, only, shared_dir, slices, text_buffer
from .wordhash import mix, words_in

#: Words of an n-gram. The production query takes 2: with 3 the counts of the check tables take more disk than its budget (README).
ORDER = 2
START, END, PAD = np.uint64(0x5354415254000001), np.uint64(0x454E440000000003), np.uint64(0)
#: Bytes of text read at once; tokens, and rows for the next lower order, that a task sums before it hands them on.
CHUNK, HELD, HANDED = 1_200_000, 4_000_000, 1_500_000
#: A word is frequent if it is one of so many tokens.
FREQUENT = 2_000
#: Bits of the number of parts at least, and tokens a part beyond that.
LEAST_BITS, PART_TOKENS = 10, 1 << 22
FALLBACK = (0.5, 1.0, 1.5)
SPACE = 0x20
TOP, LOW = ["n"], ["raw", "adjusted", "total", "once", "twice", "more"]
LOW_TYPE = np.dtype([("raw", "<i8"), ("total", "<f8"), ("adjusted", "<f4"), ("once", "<f4"), ("twice", "<f4"), ("more", "<f4")])
TOP_TYPE = np.dtype([("adjusted", "<f4")])
HEADER = ["entries", "raw", "adjusted", "n1", "n2", "n3", "n4", "known", "seen"]


def _fold() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x09:0x0E] = SPACE
    out[ord("A") : ord("Z") + 1] += 32
    return out


FOLD = _fold()


@dataclass
class Stretch:
    """Tokens of several texts in order, each text with a start before and an end behind it; of a long text, a part."""

    token: np.ndarray
    row: np.ndarray
    since: np.ndarray  # tokens since the start
    own: np.ndarray  # neither a start nor context repeated from the stretch before

    def __len__(self) -> int:
        return len(self.token)


def stretches(column: pa.Array, order: int) -> Iterator[Stretch]:
    """All tokens of all rows. A text longer than CHUNK is cut at white space; what follows begins with the tokens before."""
    raw, off = text_buffer(column)
    at, of, opens = [], [], []
    long = np.flatnonzero(np.diff(off) > CHUNK)
    begin = 0
    for r in [*long.tolist(), len(off) - 1]:
        at += off[begin:r].tolist()
        of += range(begin, r)
        opens += [True] * (r - begin)
        begin = r + 1
        if r < len(off) - 1:
            cut = int(off[r])
            while True:
                at.append(cut)
                of.append(r)
                opens.append(cut == off[r])
                if off[r + 1] - cut <= CHUNK:
                    break
                spaces = np.flatnonzero(FOLD[raw[cut + 1 : cut + CHUNK]] == SPACE)
                if len(spaces):
                    cut += 1 + int(spaces[-1])
                else:
                    later = next((x for lo in range(cut + CHUNK, int(off[r + 1]), CHUNK) if len(x := lo + np.flatnonzero(FOLD[raw[lo : min(lo + CHUNK, off[r + 1])]] == SPACE))), None)
                    if later is None:
                        break
                    cut = int(later[0])
    of, opens = np.array(of, np.int64), np.array(opens, bool)
    closes = np.append(opens[1:], True)
    carry, carried = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for w in words_in(raw, np.array([*at, off[-1]], np.int64), CHUNK, FOLD, SPACE):
        k = np.arange(w.lo, w.hi)
        marks = np.stack([opens[k], closes[k]], 1).ravel()  # in order: each part's start, its end
        place = np.stack([w.first[:-1], w.first[1:]], 1).ravel()[marks]
        kind = np.tile(np.array([START, END]), len(k))[marks]
        token = np.concatenate([carry, np.insert(w.hash, place, kind)])
        row = np.insert(of[w.lo + w.row], place, np.repeat(of[k], 2)[marks])
        row = np.concatenate([np.full(len(carry), of[w.lo]), row])
        place = np.arange(len(token))
        since = place - np.maximum.accumulate(np.where(token == START, place, -(1 << 40)))
        since[: len(carry)] = carried
        if len(carry) and opens[w.lo]:
            raise AssertionError("context before a start")
        rest = np.flatnonzero(since[len(carry) :] > 1 << 39) + len(carry)
        since[rest] = np.arange(1, len(rest) + 1) + (carried[-1] if len(carry) else 0)
        own = token != START
        own[: len(carry)] = False
        yield Stretch(token, row, since, own)
        going = not closes[w.hi - 1]
        keep = order - 1 if going else 0
        carry, carried = (token[len(token) - keep :], since[len(token) - keep :]) if keep else (token[:0], since[:0])


def joined(context: np.ndarray, word: np.ndarray, last: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of n-grams from those of their contexts, the words that follow and the contexts' last words."""
    h = mix(context * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    low = np.uint64((1 << (64 - bits)) - 1)
    return np.where(among(last, hot), h, (mix(context) & ~low) | (h & low))


def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of `x` are in the sorted `values`."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def hash_of(words: list[np.ndarray], hot: np.ndarray, bits: int) -> np.ndarray:
    h = words[0]
    for before, word in zip(words, words[1:]):
        h = joined(h, word, before, hot, bits)
    return h


def part_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def frequent(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(tokens, the words that make up one of FREQUENT / 2 tokens or more, and of the others some that make up one of FREQUENT).

    A stretch names the words that are one of FREQUENT of its own tokens. Of a word that is one of FREQUENT / 2 overall, the stretches that
    don't name it hold less than half, so its sum here is at least one of FREQUENT; at most FREQUENT words have that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            for s in stretches(batch.column(0), 1):
                words, n = np.unique(s.token, return_counts=True)
                keep = n * FREQUENT >= len(s)
                yield pa.RecordBatch.from_arrays([as_long(np.append(words[keep], PAD)), pa.array(np.append(n[keep], len(s)).astype(np.int64))], ["word", "n"])

    named = durable(texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = named.where(F.col("word") == int(PAD)).first()
    tokens = total["n"] if total else 0
    hot = named.where((F.col("word") != int(PAD)) & (F.col("n") * FREQUENT >= tokens)).select("word").collect()
    return tokens, np.sort(np.array([r["word"] for r in hot], np.int64).view(np.uint64))


def counted(texts: DataFrame, order: int, hot: np.ndarray, bits: int) -> DataFrame:
    """(part, w1.., n): the n-grams of the highest order, summed over HELD tokens or so; places before the start are PAD."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(held, axis=1)
        held.clear()
        words = words[:, np.lexsort(words[::-1])]
        first = np.flatnonzero(np.append(True, (words[:, 1:] != words[:, :-1]).any(0)))
        n = np.diff(np.append(first, words.shape[1])).astype(np.int64)
        words = words[:, first]
        return pa.RecordBatch.from_arrays([pa.array(part_of(hash_of(list(words), hot, bits), bits)), *map(as_long, words), pa.array(n)], ["part", *names(order), "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(freed(batches)):
            for s in stretches(batch.column(0), order):
                at = np.flatnonzero(s.own)
                held.append(np.stack([np.where(s.since[at] >= back, s.token[np.maximum(at - back, 0)], PAD) for back in range(order - 1, -1, -1)]))
                size += len(at)
                if size >= HELD:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return texts.select("text").mapInArrow(run, ", ".join(["part int", *(f"{w} long" for w in names(order)), "n long"]))


def names(order: int) -> list[str]:
    return [f"w{i + 1}" for i in range(order)]


def level(rows: DataFrame, order: int, top: bool, hot: np.ndarray, bits: int, folder: str) -> DataFrame:
    """Writes the parts of one order and returns the rows of the next lower one: summands of the columns LOW, by part and words."""
    cols = TOP if top else LOW
    lower = names(order - 1)

    def summed(words: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not words.shape[1]:
            return words, values
        first = np.flatnonzero(np.append(True, (words[:, 1:] != words[:, :-1]).any(0)))
        return words[:, first], np.add.reduceat(values, first, axis=1)

    def needs(words: np.ndarray, raw: np.ndarray, adjusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = words[0] == PAD
        seen = begins | (adjusted > 0)
        w, n, begins = words[:, seen], adjusted[seen], begins[seen]
        follows = np.zeros((len(LOW), w.shape[1]), np.int64)
        follows[0], follows[1] = raw[seen], np.where(begins, n, 1)
        inner = ~begins
        ahead = np.zeros((len(LOW), inner.sum()), np.int64)
        ahead[2], ahead[3], ahead[4], ahead[5] = n[inner], n[inner] == 1, n[inner] == 2, n[inner] > 2
        return np.concatenate([w[1:], w[:-1, inner]], axis=1), np.concatenate([follows, ahead], axis=1)

    def handed_on(rows_: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        both, values = (np.concatenate(x, axis=1) for x in zip(*rows_))
        place = np.lexsort(both[::-1])
        both, values = summed(both[:, place], values[:, place])
        return pa.RecordBatch.from_arrays([pa.array(part_of(hash_of(list(both), hot, bits), bits)), *map(as_long, both), *map(pa.array, values)], ["part", *lower, *LOW])

    def finish(part: int, held: list[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        words = np.stack([table[w].to_numpy().view(np.uint64) for w in names(order)])
        words, values = summed(words, np.stack([table[c].to_numpy() for c in cols]))
        raw, adjusted = (values[0], values[0]) if top else (values[0], values[1])
        entry = words[0] != PAD
        write(folder, order, part, hash_of(list(words[:, entry]), hot, bits), raw[entry], adjusted[entry], None if top else values[2:, entry])
        return [needs(words, raw, adjusted)] if order > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, below = -1, [], []
        for batch in freed(batches):
            p = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if p[lo] != part and held:
                    below += finish(part, held)
                    held = []
                    if sum(w.shape[1] for w, _ in below) > HANDED:
                        yield handed_on(below)
                        below = []
                part = int(p[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            below += finish(part, held)
        if below:
            yield handed_on(below)

    dealt = rows.select("part", *names(order), *cols).repartition("part").sortWithinPartitions("part", *names(order))
    return dealt.mapInArrow(run, ", ".join(["part int", *(f"{w} long" for w in lower), *(f"{c} long" for c in LOW)]))


def path_of(folder: str, order: int, part: int) -> str:
    return f"{folder}/{order}-{part}"


def write(folder: str, order: int, part: int, h: np.ndarray, raw: np.ndarray, adjusted: np.ndarray, context: np.ndarray | None) -> None:
    """One part's file: HEADER, sorted hashes, their values; of the highest order those seen more than once, then the sorted hashes of those seen once.

    A task that runs again writes the same file; renaming puts it in place whole.
    """
    place = np.argsort(h)
    single = h[:0]
    if context is None:
        single, place = h[place[adjusted[place] == 1]], place[adjusted[place] != 1]
    values = np.zeros(len(place), TOP_TYPE if context is None else LOW_TYPE)
    values["adjusted"] = adjusted[place]
    if context is not None:
        values["raw"] = raw[place]
        for name, c in zip(LOW[2:], context):
            values[name] = c[place]
    head = np.array([len(h), raw.sum(), adjusted.sum(), *((adjusted == k).sum() for k in (1, 2, 3, 4)), (raw > 0).sum(), (adjusted > 0).sum()], np.int64)
    own = f"{folder}/.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for x in (head, h[place], values, single):
            f.write(x.tobytes())
    os.replace(own, path_of(folder, order, part))


def mapped(name: str, top: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, values, hashes of what was seen once) of a part's file, in place."""
    head = np.fromfile(name, np.int64, len(HEADER)).tolist()
    n, kind = head[0] - (head[3] if top else 0), TOP_TYPE if top else LOW_TYPE
    data = np.memmap(name, np.uint8, "r")[8 * len(HEADER) :]
    after = n * (8 + kind.itemsize)
    return data[: 8 * n].view(np.uint64), data[8 * n : after].view(kind), data[after : len(data)].view(np.uint64)


@dataclass
class Discounts:
    of: tuple[float, float, float]

    @staticmethod
    def from_counts(n1: int, n2: int, n3: int, n4: int) -> Discounts:
        if min(n1, n2, n3, n4) == 0:
            return Discounts(FALLBACK)
        y = n1 / (n1 + 2 * n2)
        d = tuple(k - (k + 1) * y * after / n for k, n, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        return Discounts(d if all(0 <= x <= k for k, x in enumerate(d, 1)) else FALLBACK)

    def taken(self, count: np.ndarray) -> np.ndarray:
        """count less its discount."""
        return np.maximum(count - np.array([0.0, *self.of])[np.minimum(count, 3).astype(np.int64)], 0)


@dataclass
class KneserNey:
    """A model whose arrays lie in `folder`, which all workers can map."""

    folder: str
    order: int
    bits: int
    hot: np.ndarray
    discounts: list[Discounts]  # by order, from 1
    tokens: int  # N
    known: int  # V
    adjusted: int  # sum of the adjusted counts of single words
    backed: float  # what single words leave to the uniform distribution
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def part(self, order: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        key = (order, part)
        if key not in self._open:
            if len(self._open) >= 16_384:  # maps that a process may hold
                self._open.clear()
            self._open[key] = None
            if os.path.exists(name := path_of(self.folder, order, part)):
                self._open[key] = mapped(name, order == self.order)
        return self._open[key]

    def found(self, order: int, h: np.ndarray) -> np.ndarray:
        """The values of these n-grams, zeros where there are none; distinct hashes are looked up in order, part by part."""
        keys, back = np.unique(h, return_inverse=True)
        out = np.zeros(len(keys), TOP_TYPE if order == self.order else LOW_TYPE)
        part = part_of(keys, self.bits)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            if there := self.part(order, int(part[lo])):
                many, values, single = there
                if len(many):
                    at = np.minimum(np.searchsorted(many, keys[lo:hi]), len(many) - 1)
                    hit = np.flatnonzero(many[at] == keys[lo:hi])
                    out[lo + hit] = values[at[hit]]
                if len(single):
                    out["adjusted"][lo:hi][among(keys[lo:hi], single)] = 1
        return out[back]

    def scored(self, s: Stretch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its count in the learned texts, log10 of the base and of the model's probability; places that are not `own` mean nothing."""
        at = self.found(1, s.token)
        raw = at["raw"].astype(np.float64)
        base = np.log10((raw + 1) / (self.tokens + self.known + 1))
        p = np.full(len(s), 1 / (self.known + 1))
        if self.adjusted:
            p = self.discounts[0].taken(at["adjusted"].astype(np.float64)) / self.adjusted + self.backed * p
        h = s.token
        for k in range(2, self.order + 1):
            before, d = at, self.discounts[k - 1]
            h = np.append(h[:1], joined(h[:-1], s.token[1:], s.token[:-1], self.hot, self.bits))
            at = self.found(k, h)
            total = np.append(0.0, before["total"][:-1].astype(np.float64))
            rest = np.append(0.0, sum(x * before[c][:-1].astype(np.float64) for x, c in zip(d.of, LOW[3:])))
            inside = (s.since >= k - 1) & (np.arange(len(s)) >= k - 1) & (total > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(inside, d.taken(at["adjusted"].astype(np.float64)) / total + rest / total * p, p)
        return raw, base, np.log10(p)


def local(folder: str) -> str:
    """The path of a folder that processes can open and map."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise ValueError(f"arrays can't be mapped from {folder}: give a shared folder that is mounted on all machines")
    return folder


def train(texts: DataFrame, order: int = ORDER, folder: str | None = None) -> KneserNey:
    """A model of all rows' texts. `folder` is shared by all machines; without one, spark.checkpoint.dir is."""
    spark = texts.sparkSession
    if order < 2:
        raise ValueError("order must be 2 or more")
    folder = f"{local(folder or shared_dir(spark))}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder)
    tokens, hot = frequent(texts)
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(tokens, 1) / PART_TOKENS))))
    rows = counted(texts, order, hot, bits)
    for k in range(order, 0, -1):
        rows = level(rows, k, k == order, hot, bits, folder)
    rows.count()  # runs all levels; the last hands nothing on
    sums = headers(spark, folder, order, bits)
    discounts = [Discounts.from_counts(*(sums[k][f"n{i}"] for i in (1, 2, 3, 4))) for k in range(1, order + 1)]
    one = sums[1]
    left = np.dot(discounts[0].of, [one["n1"], one["n2"], one["more"]]) / one["adjusted"] if one["adjusted"] else 1.0
    return KneserNey(folder, order, bits, hot, discounts, one["raw"], one["known"], one["adjusted"], float(left))


def headers(spark, folder: str, order: int, bits: int) -> dict[int, dict[str, int]]:
    """Sums of the parts' headers, by order; `more` is how many n-grams have an adjusted count above 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"level": [], **{c: [] for c in HEADER}}
            for part in batch.column(0).to_pylist():
                for k in range(1, order + 1):
                    if os.path.exists(name := path_of(folder, k, part)):
                        head = np.fromfile(name, np.int64, len(HEADER))
                        for c, x in zip(["level", *HEADER], [k, *head.tolist()]):
                            out[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], list(out))

    cols = ["level", *HEADER]
    read = spark.range(0, 1 << bits, 1, min(1 << bits, 64)).mapInArrow(run, ", ".join(f"{c} long" for c in cols))
    found = {r["level"]: r.asDict() for r in read.groupBy("level").agg(*(F.sum(c).alias(c) for c in cols[1:])).collect()}
    none = dict.fromkeys(cols[1:], 0)
    return {k: (x := found.get(k, none)) | {"more": x["seen"] - x["n1"] - x["n2"]} for k in range(1, order + 1)}


def scores(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    rows = only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            n, known, base, score = np.zeros((4, batch.num_rows))
            for s in stretches(batch.column(2), model.order):
                raw, low, high = model.scored(s)
                row = s.row[s.own]
                for total, x in ((n, 1.0), (known, (raw > 0)[s.own]), (base, low[s.own]), (score, high[s.own])):
                    total += np.bincount(row, np.broadcast_to(x, row.shape), batch.num_rows)
            whole = [pa.array(x.astype(np.int64)) for x in (n, known, np.full(batch.num_rows, model.tokens))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *whole, pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def corpus_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """All rows scored by a model of those that are not held out."""
    return scores(docs, train(only(docs, "doc_id", "text").where(~held_out(F.col("doc_id"))), order))
