"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item is a list of windows of `window` words (one shorter window if it has fewer words). A window is the set of its
`shingle`-word shingles with their places. Shingles are ordered by rarity over all documents. For full containment the
necessary prefix of a window is its rarest shingle alone: a document in which that one does not occur cannot hold the
window. Documents are joined with windows on prefix shingles; the shingle's place in the window fixes where the window
must start, so a candidate must lie within the document (length and positional bounds), and each one left is verified
word by word, as text.

Windows, rarities, prefixes and candidates are tables; all joins are shuffles that Spark may split. The documents are
read twice: to count the benchmark's shingles, and to list where prefix shingles occur, each with the words around it, so
that no text is shuffled. In both passes a Bloom filter of BITS bits at most (64 MB) keeps out what is no shingle of the
benchmark; a fuller filter lets more through, which the join then drops.

Defined cases: null and wordless texts have no words and are never hit, null and wordless items never occur; items that
share a window all count; rows that repeat a doc_id are judged each on its own; empty tables are fine (no items: nothing
is hit); columns beyond doc_id, text and item_id, text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, only
from .wordhash import Words, joined, words_of

WINDOW, SHINGLE = 10, 5
#: Bits of a Bloom filter: so many for each entry, and no more than so many in all.
ENTRY_BITS, BITS = 16, 1 << 29
#: What tells document rows apart, beside doc_id.
ROW = ["doc_id", "h1", "h2"]


def row_key() -> list[F.Column]:
    return [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]


def same_row(a: DataFrame, b: DataFrame) -> list[F.Column]:
    return [a[c].eqNullSafe(b[f"_{c}"]) for c in ROW]


def windows_of(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, size, text, shingles): every window of every item. A window shorter than a shingle has one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for w in words_of(batch.column(1), 50_000):
                items, sizes, texts, shingles = [], [], [], []
                for r in range(w.hi - w.lo):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    item = batch.column(0)[w.lo + r].as_py()
                    for s in range(a, max(a, b - window) + 1) if b > a else ():
                        e = min(b, s + window)
                        items.append(item)
                        sizes.append(e - s)
                        texts.append(w.text(s, e).decode("utf-8", "replace"))
                        shingles.append(joined(w.hash[s:e], min(shingle, e - s)).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()), pa.array(shingles, pa.list_(pa.int64()))], ["item", "size", "text", "shingles"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(run, "item string, size int, text string, shingles array<long>")


def bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of column `h` as 64-bit words, their number a power of two. At most BITS bits reach the driver."""
    bits = 1 << int(np.clip(np.ceil(np.log2(ENTRY_BITS * max(1, hashes.count()))), 10, np.log2(BITS)))
    place = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("p")
    words = hashes.select(place).groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["i"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64).view(np.uint64)
    return out


def let_through(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(64 * len(filter_) - 1)
    one, two = h & mask, (h >> np.uint64(32)) & mask
    out = (filter_[one >> np.uint64(6)] >> (one & np.uint64(63))) & np.uint64(1) == 1
    at = np.flatnonzero(out)
    two = two[at]
    out[at] = (filter_[two >> np.uint64(6)] >> (two & np.uint64(63))) & np.uint64(1) == 1
    return out


def found(w: Words, lengths: list[int], filter_: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of a shingle, first words, hashes) of the shingles that the filter lets through, for each length."""
    for n in lengths:
        h = joined(w.hash, n)
        at = np.flatnonzero(let_through(filter_, h) & (w.row[: len(h)] == w.row[n - 1 :])) if len(h) else np.zeros(0, np.int64)
        yield n, at, h[at]


def rarities(docs: DataFrame, lengths: list[int], filter_: np.ndarray) -> DataFrame:
    """(h, n): how often each shingle that the filter lets through occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for w in words_of(batch.column(0)):
                for _, _, h in found(w, lengths, sent.value):
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return only(docs, "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, lengths: list[int], filter_: np.ndarray, window: int, shingle: int) -> DataFrame:
    """(doc_id, h1, h2, n_words, pos, h, off, around): a row for each document row (null pos) and for each place of a shingle.

    `around` has the words from number `off` on that any window with this shingle may cover.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filter_)
    schema = "doc_id long, h1 long, h2 int, n_words long, pos long, h long, off long, around string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for w in words_of(batch.column(3)):
                n = w.hi - w.lo
                key = [batch.column(i).slice(w.lo, n) for i in range(3)]
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.diff(w.first)), *none], ["doc_id", "h1", "h2", "n_words", "pos", "h", "off", "around"])
                for size, at, h in found(w, lengths, sent.value):
                    if len(at):
                        row = w.row[at]
                        a = np.maximum(w.first[row], at - (window - size if size == shingle else 0))
                        b = np.minimum(w.first[row + 1], at + window)
                        around = [w.text(x, y).decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist())]
                        numbers = [pa.nulls(len(at), pa.int64()), pa.array(at - w.first[row]), pa.array(h.view(np.int64)), pa.array(a - w.first[row])]
                        yield pa.RecordBatch.from_arrays([*(k.take(pa.array(row)) for k in key), *numbers, pa.array(around, pa.string())], ["doc_id", "h1", "h2", "n_words", "pos", "h", "off", "around"])

    return docs.select("doc_id", *row_key(), "text").mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, members): (doc_id, h1, h2, n_words) of each row, (doc_id, h1, h2, start, size, win) of each window in one, (win, item)."""
    every = durable(windows_of(benchmark, window, shingle))
    windows = durable(every.groupBy("size", "text").agg(F.first("shingles").alias("shingles")).select(F.monotonically_increasing_id().alias("win"), "size", "text", "shingles"))
    members = every.select("size", "text", "item").distinct().hint("merge").join(windows.select("win", "size", "text").hint("merge"), ["size", "text"]).select("win", "item")
    lengths = sorted({min(r["size"], shingle) for r in windows.select("size").distinct().collect()})  # `shingle` of them at most
    shingles = durable(windows.select("win", F.posexplode("shingles").alias("place", "h")))
    rare = durable(rarities(docs, lengths, bloom(shingles.select("h").distinct())))
    held = shingles.hint("merge").join(rare.hint("merge"), "h", "left").select("win", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "h").alias("s"))
    first = durable(held.groupBy("win").agg(F.min("s").alias("s")).where("s.n > 0").select("win", "s.place", "s.h"))  # else it occurs nowhere
    prefixes = durable(first.hint("merge").join(windows.select("win", "size", F.col("text").alias("want")).hint("merge"), "win"))
    seen = durable(places(docs, lengths, bloom(first.select("h").distinct()), window, shingle))
    joined_ = seen.where("pos is not null").drop("n_words").hint("merge").join(prefixes.hint("merge"), "h")
    joined_ = joined_.withColumn("start", F.col("pos") - F.col("place")).where("start >= off")
    exact = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("off") + 1).cast("int"), F.col("size")), " ") == F.col("want")
    return seen.where("pos is null").select(*ROW, "n_words"), durable(joined_.where(exact).select(*ROW, "start", "size", "win")), members


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each document row."""
    rows, found_, members = hits(docs, benchmark, window, shingle)
    covered = found_.select(*ROW, "start", "size").distinct().select(*ROW, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("place")).distinct()
    covered = durable(covered.groupBy(*ROW).agg(F.count("*").alias("n_hit")))
    named = found_.select(*ROW, "win").distinct().hint("merge").join(durable(members).hint("merge"), "win").select(*ROW, "item").distinct()
    named = durable(named.groupBy(*ROW).agg(F.array_sort(F.collect_list("item")).alias("items")))
    own = durable(covered.hint("merge").join(named.hint("merge").withColumnsRenamed({c: f"_{c}" for c in ROW}), [covered[c].eqNullSafe(F.col(f"_{c}")) for c in ROW]).select(*[F.col(c).alias(f"_{c}") for c in ROW], "n_hit", "items"))
    out = rows.hint("merge").join(own.hint("merge"), same_row(rows, own), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows, all columns, in which no window of any item occurs. Each is judged by its own text, whatever its id."""
    bad = durable(hits(docs, benchmark, window, shingle)[1].select(*[F.col(c).alias(f"_{c}") for c in ROW]).distinct())
    same = [docs["doc_id"].eqNullSafe(bad["_doc_id"]), F.xxhash64(docs["text"]).eqNullSafe(bad["_h1"]), F.hash(docs["text"]).eqNullSafe(bad["_h2"])]
    return docs.join(bad.hint("shuffle_hash"), same, "left_anti")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents, all columns, without the ids of which a row holds a window of an item. Rows without an id all stay.

    By id: rows that share one go together. `clean_rows` judges each row by itself.
    """
    bad = durable(hits(docs, benchmark, window, shingle)[1].select(F.col("doc_id").alias("_hit")).distinct())
    return docs.hint("merge").join(bad.hint("merge"), docs["doc_id"] == bad["_hit"], "left_anti")
