"""Spelling variants: words grouped under their more frequent neighbours by one edit, found through a reduced alphabet.

Letters are hashed to SYMBOLS symbols. Two words that differ by one inserted, deleted or replaced letter have reduced words that are
equal or differ by one such edit too, so the full one-edit neighbourhood of a reduced word (itself, each symbol deleted,
replaced by each other one, each symbol inserted everywhere) holds the reduced words of all its near words. Neighbourhoods are
64-bit hashes made of prefix sums, so a neighbour costs the same for a word of any length. They are joined with the
reduced vocabulary, and what they find is verified on the words themselves: a colliding hash costs time, never a link.
A Bloom filter of the reduced vocabulary (64 MB at most) drops most neighbours before they are shuffled; a fuller filter lets more
through, which the join then drops.

A word's form is its near word with the largest count (ties: smallest in code-point order), if that is at least RATIO times its
own. Counts grow by that factor along forms, so chains are short; roots are found by doubling steps.

Words are runs of `[A-Za-z\\u00C0-\\u00FF]`, with A-Z alone lower-cased. `planted` takes a letter out of one in 199 pairs of document and word
(by crc32 of `<doc_id>:<word>`), as the query's contract asks; `variants` takes any table of words and counts.

Defined cases: a null text has no words, a null doc_id is the text ''; rows that repeat are counted as often; words of
any length take part; a word that occurs in several rows of `variants`' input counts with their sum, null words and counts, and counts below 1, don't; a word without
near words has 0, itself as root and null for the rest; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, only, slices
from .decontaminate import bloom, let_through
from .wordhash import mix

SYMBOLS = 16
#: Code points of a word, occurrences of a word, how many times the count of a word its form has.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many pairs of document and word loses a letter.
PLANTED = 199
#: Distinct words that a task holds before it hands their counts on; places of words whose neighbours are made at once.
HELD, PLACES = 200_000, 20_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})

_random = np.random.default_rng(20240712)
_SYMBOL = _random.integers(0, SYMBOLS, 512)
_VALUE = _random.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))


def _of_length(n: int) -> np.uint64:
    return np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)


def word_counts(docs: DataFrame, planted: int = PLANTED, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of all texts after planting, those that are long and frequent enough."""

    def packed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(freed(batches)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(RUN.findall(text.translate(LOWER)) if text else ())
                if planted:
                    for word in [w for w in own if zlib.crc32(f"{doc_id}:{w}".encode()) % planted == 0]:
                        at = zlib.crc32(f"{doc_id}:{word}".encode()) % len(word)
                        n = own.pop(word)
                        counts[word[:at] + word[at + 1 :]] += n
                counts.update(own)
                if len(counts) > HELD:
                    yield packed(Counter({w: n for w, n in counts.items() if len(w) >= least_length}))
                    counts.clear()
        yield packed(Counter({w: n for w, n in counts.items() if len(w) >= least_length}))

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reduced(word: str) -> np.ndarray:
    code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[(code ^ (code >> np.uint32(9))) & np.uint32(511)]


class Sums:
    """A reduced word's prefix sums, of which its own hash and those of its neighbours are made."""

    def __init__(self, word: str):
        self.symbol = reduced(word)
        n = len(self.symbol)
        self.power = np.full(n + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.before = np.append(np.uint64(0), np.cumsum(_VALUE[self.symbol] * self.power[:n]))
        self.length = n

    def own(self) -> np.ndarray:
        return mix(self.before[-1:] + _of_length(self.length))

    def neighbours(self, lo: int, hi: int) -> np.ndarray:
        """Hashes of the neighbours edited at places lo..hi-1; at the last place, behind the word, symbols are only inserted."""
        n, all_ = self.length, self.before[-1]
        at = np.arange(lo, min(hi, n))
        deleted = self.before[at] + (all_ - self.before[at + 1]) * _INVERSE + _of_length(n - 1) if n else self.before[:0]
        replaced = all_ + (_VALUE[None, :] - _VALUE[self.symbol[at], None]) * self.power[at, None] + _of_length(n)
        at = np.arange(lo, min(hi, n + 1))
        inserted = self.before[at, None] + _VALUE[None, :] * self.power[at, None] + (all_ - self.before[at, None]) * np.uint64(_BASE) + _of_length(n + 1)
        return mix(np.concatenate([deleted, replaced.ravel(), inserted.ravel()]))


def reduced_vocabulary(words: DataFrame) -> DataFrame:
    """(id, h): the hash of each word's reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            h = np.concatenate([np.zeros(0, np.uint64), *(Sums(w).own() for w in batch.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64))], ["id", "h"])

    return words.select("id", "word").mapInArrow(run, "id long, h long")


def neighbourhoods(words: DataFrame, filter_: np.ndarray) -> DataFrame:
    """(id, h): the distinct hashes of each reduced word and all its neighbours that the filter lets through."""
    sent = words.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            ids, found = [], []
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Sums(word)
                parts = [s.own()]
                for lo in range(0, s.length + 1, PLACES):
                    h = s.neighbours(lo, lo + PLACES)
                    parts.append(h[let_through(sent.value, h)])
                found.append(np.unique(np.concatenate(parts)))
                ids.append(np.full(len(found[-1]), i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found).view(np.int64))], ["id", "h"])

    return words.select("id", "word").mapInArrow(run, "id long, h long")


def near_words(words: DataFrame) -> DataFrame:
    """(id, near_id, near, near_n): each word of (id, word, n) with each word at one edit."""
    keys = durable(reduced_vocabulary(words))
    named = durable(keys.hint("merge").join(words.hint("merge"), "id").select("h", F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    asked = durable(neighbourhoods(words, bloom(keys.select("h").distinct())))
    met = asked.hint("merge").join(named.hint("merge"), "h").where(F.col("id") != F.col("near_id")).select("id", "near_id", "near", "near_n")
    both = durable(met).hint("merge").join(words.select("id", "word").hint("merge"), "id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("id", "near_id", "near", "near_n")


def roots(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """(id, root): where forms, (id, form), lead to. A chain has as many steps as `most` can be divided by the ratio."""
    steps, longest = links.select("id", F.col("form").alias("root")), 1
    while ratio ** (longest + 1) <= most:
        ahead = steps.select(F.col("id").alias("root"), F.col("root").alias("ahead"))
        steps = durable(steps.hint("merge").join(ahead.hint("merge"), "root", "left").select("id", F.coalesce("ahead", "root").alias("root")))
        longest *= 2
    return steps


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n)."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms would go round in circles")
    totals = only(counts, "word", "n").where("word is not null and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = durable(totals.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near", "near_id", "near_n")).alias("best")
    near = durable(near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), best))
    rows = durable(words.hint("merge").join(near.hint("merge"), "id", "left").select("*", (F.col("best.near_n") >= ratio * F.col("n")).alias("has")))
    most = rows.agg(F.max("n")).first()[0] or 0
    ends = roots(rows.where("has").select("id", F.col("best.near_id").alias("form")), most, ratio)
    named = durable(ends.select("id", F.col("root").alias("end")).hint("merge").join(words.select(F.col("id").alias("end"), F.col("word").alias("root")).hint("merge"), "end").select("id", "root"))
    form = lambda c: F.when(F.col("has"), F.col(f"best.{c}"))
    return rows.hint("merge").join(named.hint("merge"), "id", "left").select(
        "word", form("near").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form("near_n").alias("form_n")
    )


def corpus_variants(docs: DataFrame) -> DataFrame:
    return variants(word_counts(only(docs, "doc_id", "text")))
