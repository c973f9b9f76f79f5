"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of BITS random-hyperplane bits and keeps the strings of all vectors in a sorted
array, so that a prefix is a range. A query descends each tree to its longest matching prefix and then ascends all trees
together, one bit at a time; a range is taken whole, so equal vectors are never cut apart. Candidates are ranked by the
exact Euclidean distance in double precision, ties by the smaller id.

Each query stops for itself: two vectors at an angle a share a prefix of d bits in a tree with probability (1 - a/pi)^d,
so once the chance that a vector at the angle of the k-th nearest so far is in none of the ranges is at most MISS,
ascending ends. Where vectors lie in clusters this is after a small part of the rows; of evenly spread directions the
ten nearest of ten thousand are hardly nearer than the rest, and about half of the rows are looked at (see README).

Rows are dealt by a hash of their id to shards of about SHARD_ROWS, each with a forest of its own; the shards are written as
a table that can be searched again. Queries are packed into blocks of QUERY_ROWS and sent to every shard of their
dimension, where they stream by the shard's forest, which is read once; the shards' nearest are merged by query.

Defined cases: rows whose id or vector is null, whose vector is zero or empty or holds null or non-finite components
take no part; vectors of other lengths than the query's are no candidates; rows that repeat an id and a vector count
once; an id with several vectors is one neighbour, as far as the nearest of them, and never a neighbour of itself; a
query id with several vectors has the nearest of all of them; a query without candidates has no row; an empty table gives an empty result; columns beyond
vec_id and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, freed, only

#: Trees of a shard, bits of a hash string, candidates at least, the chance of a miss at which a query stops.
TREES, BITS, LEAST, MISS = 64, 64, 64, 0.1
SHARD_ROWS, QUERY_ROWS = 8_192, 256
SHARD_SCHEMA = "dim int, shard int, ids binary, vectors binary, hashes binary, places binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return only(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, trees * BITS))


def hashes_of(x: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows) hash strings, the first bit highest."""
    bits = (x @ planes(x.shape[1], trees) > 0).reshape(len(x), trees, BITS)
    return np.ascontiguousarray(np.packbits(bits, axis=2).view(">u8")[:, :, 0].T.astype(np.uint64))


def index(vectors: DataFrame, trees: int = TREES) -> DataFrame:
    """The forest as a table, one row a shard: ids, vectors, and each tree's sorted hashes with their places."""
    rows = durable(usable(vectors).distinct())
    shards = rows.groupBy("dim").agg(F.ceil(F.count("*") / float(SHARD_ROWS)).cast("int").alias("shards"))
    dealt = rows.hint("merge").join(durable(shards).hint("merge"), "dim")

    def build(pdf):  # about SHARD_ROWS rows, whatever the size of the table
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        x = np.array(pdf["v"].tolist(), np.float64)
        h = hashes_of(x, trees)
        order = np.argsort(h, axis=1, kind="stable")
        return pd.DataFrame(
            {"dim": [x.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
             "hashes": [np.take_along_axis(h, order, 1).tobytes()], "places": [order.astype(np.int32).tobytes()]}
        )

    return dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).groupBy("dim", "shard").applyInPandas(build, SHARD_SCHEMA)


class Shard:
    """A forest that is searched."""

    def __init__(self, dim: int, ids: pa.Buffer, vectors: pa.Buffer, hashes: pa.Buffer, places: pa.Buffer, trees: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(len(self.ids), dim)
        self.hashes, self.places = np.frombuffer(hashes, np.uint64).reshape(trees, -1), np.frombuffer(places, np.int32).reshape(trees, -1)
        self.length = np.sqrt((self.x * self.x).sum(1))
        self.repeated = len(np.unique(self.ids)) < len(self.ids)

    def ranges(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) ends of the ranges that share `depth` bits with each query."""
        rest = BITS - depth
        low = q >> np.uint64(rest) << np.uint64(rest) if depth else np.zeros_like(q)
        high = low | np.uint64((1 << rest) - 1)
        side = lambda x, s: np.stack([np.searchsorted(h, k, s) for h, k in zip(self.hashes, x)])
        return side(low, "left"), side(high, "right")

    def nearest(self, own: list[int], v: np.ndarray, k: int, trees: int) -> Iterator[tuple[int, int, float]]:
        """(query id, id, distance) of the k nearest found for each query, and all that tie with the last."""
        q = hashes_of(v, trees)
        live = list(range(len(own)))
        reached = np.zeros(len(own), np.int64)  # how many rows the ranges held when last looked at
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(own)
        for depth in range(BITS, -1, -1):
            if not live:
                break
            lo, hi = self.ranges(q[:, live], depth)
            size = (hi - lo).sum(0)
            wait = []
            for i, (n, query) in enumerate(zip(size.tolist(), live)):
                if depth and n < max(LEAST, 2 * reached[query]):  # looked at again when it has doubled
                    wait.append(query)
                    continue
                reached[query] = n
                seen = np.zeros(len(self.ids), bool)
                for t, (a, b) in enumerate(zip(lo[:, i].tolist(), hi[:, i].tolist())):
                    seen[self.places[t, a:b]] = True
                c = np.flatnonzero(seen & (self.ids != own[query]))
                c, d = self.ranked(c, v[query])
                best[query] = c[:k], d[:k]
                if depth and (len(c) < k or self.missing(c[k - 1], v[query], depth, trees) > MISS):
                    wait.append(query)
            live = wait
        for query, (c, d) in zip(own, best):
            yield from ((query, int(self.ids[i]), float(x)) for i, x in zip(c.tolist(), d.tolist()))

    def ranked(self, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates by distance, then id; each id once."""
        d = np.sqrt(((self.x[c] - v) ** 2).sum(1))
        order = np.lexsort((self.ids[c], d))
        c, d = c[order], d[order]
        if self.repeated:
            first = np.sort(np.unique(self.ids[c], return_index=True)[1])
            c, d = c[first], d[first]
        return c, d

    def missing(self, row: int, v: np.ndarray, depth: int, trees: int) -> float:
        """The chance that a vector at the angle of this row shares `depth` bits with the query in no tree."""
        cosine = (self.x[row] @ v) / (self.length[row] * np.sqrt(v @ v))
        return float((1 - (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** depth) ** trees)


def search(forest: DataFrame, queries: DataFrame, k: int, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of `queries`, never the query's own id."""
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "v", "dim")
    number = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // QUERY_ROWS))))
    blocks = asked.groupBy("dim", number.alias("block")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))  # QUERY_ROWS or so
    sent = durable(blocks).hint("merge").join(forest.select("dim", "shard").hint("merge"), "dim").select("dim", "shard", F.lit(1).alias("turn"), "asked")
    both = forest.withColumn("turn", F.lit(0)).unionByName(sent, allowMissingColumns=True)
    both = both.select("dim", "shard", "turn", "ids", "vectors", "hashes", "places", "asked").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Shard | None = None
        for batch in freed(batches):
            for i, turn in enumerate(batch.column(2).to_pylist()):
                if turn == 0:
                    here = Shard(batch.column(0)[i].as_py(), *(batch.column(c)[i].as_buffer() for c in (3, 4, 5, 6)), trees)
                    continue
                rows = batch.column(7)[i].as_py()
                found = list(here.nearest([a["query_id"] for a in rows], np.array([a["v"] for a in rows], np.float64), k, trees))
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return search(durable(index(vectors)), queries, k)
