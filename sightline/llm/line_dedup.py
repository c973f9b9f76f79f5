"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A `LineStore` is three tables:

* references `(k1, k2, doc_id)`: one row for each document that holds a line key (exact; 128-bit keys).
* counts `(shard, k1, k2, n, smallest)`: how many documents hold each key, and the smallest of them.
* filters `(shard, n_keys, data)`: for each shard a cuckoo filter of the keys that two or more documents hold.

`insert` adds documents, `delete` takes documents out again; counts and filters change only for the keys concerned, and
deleting what was inserted gives the state from before. `duplicates` asks the filters first and lets the exact counts
decide, so a false positive of a filter never drops a line. Keys go to the filter of their shard in a shuffle, whatever
the number and size of the filters; a store that grows is dealt to more shards.

Defined cases: a null or empty text is one empty line; keys under `min_chars` code points are never dropped; a null
doc_id holds no key and loses no line; rows that repeat a doc_id count as one document; an empty table gives an empty
result; columns beyond doc_id and text are kept as they are, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import durable, freed, groups, only, slices

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: References of a shard at most, about: its filter then has some 4 MB, 8 before the store is dealt to more shards.
SHARD_KEYS = 1_000_000
#: Below that, references go to as many shards as Spark has shuffle partitions, but for shards of fewer than these.
LEAST_KEYS = 1_000
#: Parts that the references may consist of before they are written anew as one.
PARTS = 8


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text (UTF-8) and their 16-byte keys; None for a line that is too short to count."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines, keys = raw.split(b"\n"), []
    for line in raw.lower().split(b"\n"):  # bytes.lower() folds A-Z alone
        line = line.strip(WHITE)
        n = len(line)
        if n < min_chars or n < 4 * min_chars and len(line.decode("utf-8", "surrogatepass")) < min_chars:
            keys.append(None)
        else:
            keys.append(xxhash.xxh3_128_digest(line))
    return lines, keys


class CuckooFilter:
    """Partial-key cuckoo hashing: 4 fingerprints of 16 bits a bucket, two candidate buckets for each key."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (0.85 * self.SLOTS)))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table
        self.mask = len(table) - 1

    @staticmethod
    def _print(k2: np.ndarray) -> np.ndarray:
        f = (k2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        return np.where(f == 0, np.uint16(1), f)

    def _places(self, k1: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = (k1.view(np.uint64) >> np.uint64(20)).astype(np.int64) & self.mask
        return one, one ^ self._jump(f)

    def _jump(self, f):
        return (np.asarray(f).astype(np.int64) * 0x5BD1E995 >> 7) & self.mask

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        f = self._print(k2)
        a, b = self._places(k1, f)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if the table is too full; the shard is then rebuilt at twice the size."""
        f = self._print(k2)
        rng, t = np.random.default_rng(len(k1)), self.table
        for x, a, b in zip(f.tolist(), *(p.tolist() for p in self._places(k1, f))):
            for place in (a, b):
                free = np.flatnonzero(t[place] == 0)
                if len(free):
                    t[place, free[0]] = x
                    break
            else:
                at = (a, b)[int(rng.integers(2))]
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    x, t[at, slot] = int(t[at, slot]), x
                    at ^= int(self._jump(x))
                    free = np.flatnonzero(t[at] == 0)
                    if len(free):
                        t[at, free[0]] = x
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes keys out again that were inserted before."""
        f = self._print(k2)
        for x, a, b in zip(f.tolist(), *(p.tolist() for p in self._places(k1, f))):
            for place in (a, b):
                found = np.flatnonzero(self.table[place] == x)
                if len(found):
                    self.table[place, found[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def built(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    size = len(k1)
    while not (out := CuckooFilter(size)).insert(k1, k2):
        size *= 2
    return out


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id): each key of each document row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {k for k in line_keys(text.as_py(), min_chars)[1] if k is not None}
                keys += own
                ids += [doc_id] * len(own)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])

    return only(docs.where(F.col("doc_id").isNotNull()), "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long")


def shard_of(shards: int) -> F.Column:
    return F.pmod(F.shiftrightunsigned("k1", 8), F.lit(shards)).cast("int")


def shards_for(spark: SparkSession, size: int) -> int:
    """How many shards `size` references are dealt to: enough to bound a shard, and for all tasks to have work."""
    wide = min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_KEYS)
    return max(1, wide, -(-size // SHARD_KEYS))


def counted(references: DataFrame, shards: int) -> DataFrame:
    """(shard, k1, k2, n, smallest) of each key. Partial aggregates reduce a line in a third of all documents before the shuffle."""
    return references.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("smallest")).select(shard_of(shards).alias("shard"), "k1", "k2", "n", "smallest")


def filters_of(counts: DataFrame) -> DataFrame:
    """(shard, n_keys, data): a cuckoo filter of each shard's shared keys; a shard's keys are bounded (SHARD_KEYS), at any size of the input."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(freed(batches), 1):
            k1, k2 = (np.ascontiguousarray(own.column(i).to_numpy()) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([own.column(0).slice(0, 1), pa.array([len(k1)], pa.int64()), pa.array([built(k1, k2).to_bytes()], pa.binary())], ["shard", "n_keys", "data"])

    shared = counts.where("n > 1").select("shard", "k1", "k2")
    return shared.repartition("shard").sortWithinPartitions("shard", "k1", "k2").mapInArrow(build, "shard int, n_keys long, data binary")


def screened(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """Those of `keys` (shard, k1, k2) that the filter of their shard knows. Within a shard, the filter comes first."""
    none = F.lit(None).cast("long")
    first = filters.select("shard", F.lit(0).alias("turn"), none.alias("k1"), none.alias("k2"), "data")
    both = first.unionByName(keys.select("shard", F.lit(1).alias("turn"), "k1", "k2", F.lit(None).cast("binary").alias("data")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in freed(batches):
            shard, turn = (batch.column(i).to_numpy() for i in (0, 1))
            keep = np.zeros(len(shard), bool)
            for lo, hi in zip(*runs(shard * 2 + turn)):
                if turn[lo] == 0:
                    at, own = shard[lo], CuckooFilter.from_bytes(batch.column(4)[lo].as_py())
                elif shard[lo] == at:
                    keep[lo:hi] = own.contains(*(np.ascontiguousarray(batch.column(i).slice(lo, hi - lo).to_numpy()) for i in (2, 3)))
            yield batch.select([2, 3]).filter(pa.array(keep))

    return both.repartition("shard").sortWithinPartitions("shard", "turn").mapInArrow(probe, "k1 long, k2 long")


def runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal values."""
    cuts = (np.flatnonzero(np.diff(x)) + 1).tolist()
    return [0, *cuts][: len(x)], [*cuts, len(x)][: max(1, len(cuts) + 1)]


@dataclass
class LineStore:
    """References, counts and filters of the documents inserted so far."""

    references: DataFrame  # k1, k2, doc_id
    counts: DataFrame  # shard, k1, k2, n, smallest
    filters: DataFrame  # shard, n_keys, data
    shards: int
    size: int  # references
    min_chars: int = MIN_CHARS
    parts: int = 1  # that the references consist of

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineStore:
        return cls.of(durable(occurrences(docs, min_chars).distinct()), min_chars)

    @classmethod
    def of(cls, references: DataFrame, min_chars: int) -> LineStore:
        """A store of references that are written already."""
        size = references.count()
        shards = shards_for(references.sparkSession, size)
        counts = durable(counted(references, shards))
        return cls(references, counts, durable(filters_of(counts)), shards, size, min_chars)

    def insert(self, docs: DataFrame) -> LineStore:
        found = durable(occurrences(docs, self.min_chars).distinct())
        new = durable(found.hint("merge").join(self.references.hint("merge"), ["k1", "k2", "doc_id"], "left_anti"))
        return self._changed(self.references.unionByName(new), new, self.size + new.count())

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Takes the documents with the ids in `doc_ids.doc_id` out again."""
        ids = durable(only(doc_ids, "doc_id").where("doc_id is not null").distinct())
        gone = durable(self.references.hint("merge").join(ids.hint("merge"), "doc_id", "left_semi").select("k1", "k2", "doc_id"))
        rest = self.references.hint("merge").join(ids.hint("merge"), "doc_id", "left_anti").select("k1", "k2", "doc_id")
        return self._changed(rest, gone, self.size - gone.count())

    def _changed(self, references: DataFrame, touched: DataFrame, size: int) -> LineStore:
        """Counts follow the keys that were touched, filters those of them whose count crossed two."""
        parts = self.parts + 1
        crowded = shards_for(references.sparkSession, size) > 2 * self.shards
        if parts > PARTS or crowded:
            references, parts = durable(references), 1
        if crowded:
            return LineStore.of(references, self.min_chars)
        keys = durable(touched.select("k1", "k2").distinct())
        here = lambda df, how: df.hint("merge").join(keys.hint("merge"), ["k1", "k2"], how)
        now = durable(counted(here(references, "left_semi"), self.shards))
        was = here(self.counts, "left_semi").where("n > 1").select("shard", "k1", "k2", F.lit(-1).alias("add"))
        delta = was.unionByName(now.where("n > 1").select("shard", "k1", "k2", F.lit(1).alias("add"))).groupBy("shard", "k1", "k2").agg(F.sum("add").alias("add")).where("add <> 0")
        counts = durable(here(self.counts, "left_anti").select("shard", "k1", "k2", "n", "smallest").unionByName(now))

        def apply(key, old, changes):
            import pandas as pd

            k1, k2, add = (changes[c].to_numpy() for c in ("k1", "k2", "add"))
            f = CuckooFilter.from_bytes(old["data"].iloc[0]) if len(old) else CuckooFilter(len(k1))
            n = (int(old["n_keys"].iloc[0]) if len(old) else 0) + int(add.sum())
            f.delete(k1[add < 0], k2[add < 0])
            full = not f.insert(k1[add > 0], k2[add > 0])
            return pd.DataFrame({"shard": [int(key[0])], "n_keys": [n], "data": [f.to_bytes()], "full": [full]})

        changed = durable(self.filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(apply, "shard int, n_keys long, data binary, full boolean"))
        full = changed.where("full").select("shard")
        rebuilt = filters_of(counts.hint("merge").join(full.hint("merge"), "shard", "left_semi").select(*counts.columns))
        filters = durable(changed.where("not full").drop("full").unionByName(rebuilt))
        return replace(self, references=references, counts=counts, filters=filters, size=size, parts=parts)

    def duplicates(self, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, k1, k2) of the occurrences in `docs` (or all that were inserted) to drop: a smaller doc_id holds the key too."""
        found = self.references if docs is None else durable(occurrences(docs, self.min_chars).distinct())
        keys = self.counts if docs is None else found.select("k1", "k2").distinct().withColumn("shard", shard_of(self.shards))
        known = screened(keys.select("shard", "k1", "k2"), self.filters)
        shared = durable(self.counts.where("n > 1").select("k1", "k2", "smallest").hint("merge").join(known.hint("merge"), ["k1", "k2"], "left_semi"))
        return found.hint("merge").join(shared.hint("merge"), ["k1", "k2"]).where("doc_id > smallest").select("doc_id", "k1", "k2")


def rewritten(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns of `docs` with text replaced, plus n_lines and n_dropped. `drops`: (doc_id, k1, k2)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    mark = "_" * (1 + max(map(len, docs.columns)))  # begins no column of docs
    own, gone = f"{mark}id", f"{mark}keys"
    packed = F.expr("concat(lpad(hex(k1), 16, '0'), lpad(hex(k2), 16, '0'))")
    by_doc = drops.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(packed).alias(gone))
    both = docs.join(by_doc.hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left").select(*docs.columns, gone)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text, gone = text.as_py(), gone.as_py()
                if not gone:
                    texts.append(text)
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {b"".join(int(k[i : i + 16], 16).to_bytes(8, "little") for i in (0, 16)) for k in gone}
                lines, keys = line_keys(text, min_chars)
                kept = [line for line, key in zip(lines, keys) if key not in gone]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    out = StructType([*docs.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType())
    return both.mapInArrow(run, out)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without lines that a smaller doc_id holds too; also n_lines (before) and n_dropped.

    The documents are inserted into an empty store, which is then asked for its duplicates.
    """
    return rewritten(docs, LineStore.build(docs, min_chars).duplicates(), min_chars)
