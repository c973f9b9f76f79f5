"""MinHash near-duplicates by DartMinHash signatures, banded joining and exact verification.

Each element of a document's weighted shingle set owns a region as high as its weight. Darts hit the region of every
element as a Poisson process in rank, placed by hashes of the element alone, so that two documents see the same darts
on what they share. Each dart belongs to one of k coordinates; a coordinate keeps its earliest dart. Only about
k ln k + 2k darts are looked at for a document of any length. Two signatures agree in a coordinate with a probability
equal to the weighted Jaccard similarity.

Steps: (1) rows with equal word sequences become one text at once; (2) texts meet in bands; in each bucket all are compared
with its first; (3) links of similarity >= threshold, checked on whole shingle sets, make components; (4) in a bucket
that still holds several components, those outside the first one's are compared with LEADERS more members, and what is
then still outside with all members of other components, in blocks of bounded size. So no component that
links between documents of a bucket would join stays apart.

Before the check on whole sets, a pair must agree in at least `threshold - SLACK` of the signature's coordinates, of
which each row keeps one byte. A pair at 0.8 does so but for a chance of 1e-8; with 25 bands of 5 rows it shares a
bucket with probability 0.99995. What reaches the check is a small part of all that meets in buckets.

Shingles are five words. The similarity is the Jaccard similarity of the shingle sets (weights="binary"), of
multisets (weights="count"), or the weighted one with weights 1 + ln(count) (weights="log").

Defined cases: a text with fewer than five words has one shingle of all its words; a text without words (null, empty,
punctuation) is like no other and is its own class; rows with a null doc_id get a null class and link nothing; rows that
share a doc_id are one document, in one class, and link it to whatever any of their texts is like; an empty
table gives an empty result; columns beyond doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, groups, only
from .wordhash import mix, shingles_of, words_of

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
#: How much less than the threshold the share of equal coordinates may be.
SLACK = 0.2
#: Further members of a bucket that those not like its first are compared with before all the others are.
LEADERS = 8
#: A block of a bucket holds about so many members on a side, and so many bytes of shingle sets.
BLOCK, BLOCK_BYTES = 512, 4_000_000


def weighted_set(h: np.ndarray, row: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions (hash, row, height) of each row's set, none higher than 1.

    A weight of 2.7 is two full regions and one of 0.7; the n-th region of a shingle has a hash of its own.
    """
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    if weights == "binary":
        return h[new], row[new], np.ones(int(new.sum()), np.float32)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    weight = count.astype(np.float64) if weights == "count" else 1 + np.log(count)
    n = np.ceil(weight).astype(np.int64)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h, row = np.repeat(h[at], n), np.repeat(row[at], n)
    return np.where(nth == 0, h, mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), row, np.minimum(1, np.repeat(weight, n) - nth).astype(np.float32)


def dart_signatures(h: np.ndarray, row: np.ndarray, rows: int, k: int, height: np.ndarray | None = None) -> np.ndarray:
    """(rows, k) signature hashes of the regions `h` of `row`; rows without a region are zero."""
    out = np.zeros((rows, k), np.uint64)
    height = np.ones(len(h), np.float32) if height is None else height
    size = np.bincount(row, weights=height, minlength=rows)
    todo = np.flatnonzero(size)
    darts = k * np.log(k) + 2 * k
    while len(todo):
        limit = np.zeros(rows)
        limit[todo] = darts / size[todo]
        live = limit[row] > 0
        element, owner, top = h[live], row[live], height[live]
        rank = np.zeros(len(element))
        turn, found = 0, []
        while len(element):
            turn += 1
            state = mix(element + np.uint64(turn * 0xD6E8FEB86659FD93 & 2**64 - 1))
            rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            stay = rank <= limit[owner]
            element, owner, top, rank, state = element[stay], owner[stay], top[stay], rank[stay], state[stay]
            dart = mix(state ^ np.uint64(0xA0761D6478BD642F))
            hit = (mix(dart) >> np.uint64(40)).astype(np.float32) < top * np.float32(2**24)  # how high the dart flies
            found.append((owner[hit], rank[hit], dart[hit]))
        owner, rank, dart = (np.concatenate(x) for x in zip(*found))
        coordinate = ((dart >> np.uint64(16)) % np.uint64(k)).astype(np.int64)
        late_first = np.argsort(-rank, kind="stable")
        got = np.zeros((rows, k), np.uint64)
        got[owner[late_first], coordinate[late_first]] = dart[late_first] | np.uint64(1)  # the earliest is written last
        full = (got[todo] != 0).all(1)
        out[todo[full]] = got[todo[full]]
        todo, darts = todo[~full], darts * 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(31) + signature[:, i : bands * rows : rows])
    return mix(out + np.arange(bands, dtype=np.uint64)).view(np.int64)


def fixed(rows: np.ndarray) -> pa.Array:
    """An Arrow binary column of the rows of a byte matrix."""
    n, width = rows.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array) -> np.ndarray:
    """The byte matrix of a binary column whose values are of equal length."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].reshape(len(column), -1)


def signed(docs: DataFrame, size: int, weights: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, h1, h2, c1, c2, n_words, sig, keys) of each row.

    h1 and h2 are hashes of the text, c1 and c2 of its word sequence; sig has a byte of each coordinate, keys the bands'
    keys (both empty without words).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for w in words_of(batch.column(3)):
                n, count = w.hi - w.lo, np.diff(w.first)
                h, row, height = weighted_set(*shingles_of(w, size), weights)
                darts = dart_signatures(h, row, n, bands * rows, height)
                keys, some = band_keys(darts, bands, rows), count > 0
                place = (np.arange(len(w.hash)) - w.first[w.row]).astype(np.uint64) + np.uint64(1)
                whole = []
                for seed in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash ^ mix(place * np.uint64(seed))), dtype=np.uint64)])
                    whole.append(pa.array(mix(total[w.first[1:]] - total[w.first[:-1]] + count.astype(np.uint64)).view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]), pa.int32()), pa.array(keys[some].ravel()))
                sig = fixed((darts >> np.uint64(8)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(w.lo, n) for i in range(3)), *whole, pa.array(count), sig, lists], ["doc_id", "h1", "h2", "c1", "c2", "n_words", "sig", "keys"])

    return docs.select("doc_id", *text_hashes(), "text").mapInArrow(run, "doc_id long, h1 long, h2 int, c1 long, c2 long, n_words long, sig binary, keys array<long>")


def text_hashes() -> list[F.Column]:
    """Tell the texts of one doc_id apart."""
    return [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]


def shingle_sets(texts: DataFrame, size: int, weights: str) -> DataFrame:
    """(node, set): the sorted shingle hashes of each text, 8 bytes each, and after them their heights if weights are "log"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for w in words_of(batch.column(1)):
                h, row, height = weighted_set(*shingles_of(w, size), weights)
                order = np.lexsort((h, row))
                h, height = h[order], height[order]
                ends = np.searchsorted(row[order], np.arange(w.hi - w.lo + 1)).tolist()
                raw = [h[a:b].tobytes() + (height[a:b].tobytes() if weights == "log" else b"") for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(raw, pa.binary())], ["node", "set"])

    return only(texts, "node", "text").mapInArrow(run, "node long, set binary")


def read_set(value: pa.BinaryScalar, weights: str) -> tuple[np.ndarray, np.ndarray | None]:
    raw = value.as_buffer()
    if weights != "log":
        return np.frombuffer(raw, np.uint64), None
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.float32, n, 8 * n)


def alike(x: tuple, y: tuple, threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two sets is the threshold or more."""
    (a, u), (b, v) = x, y
    if u is None:
        if min(len(a), len(b)) < threshold * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 0 < common >= threshold * (len(a) + len(b) - common)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.minimum(u[i], v[j]).sum(dtype=np.float64)
    return 0 < common >= threshold * (u.sum(dtype=np.float64) + v.sum(dtype=np.float64) - common) * (1 - 1e-6)


class Texts:
    """The distinct texts that take part, by node number, with what is needed to compare them."""

    def __init__(self, same: DataFrame, docs: DataFrame, repeats: bool, size: int, threshold: float, weights: str, coordinates: int):
        self.same, self.size, self.threshold, self.weights = same, size, threshold, weights
        self.agree = int(np.floor(coordinates * (threshold - SLACK)))
        text = docs.where("doc_id is not null").select("doc_id", *text_hashes(), "text")
        self.text = text.dropDuplicates(["doc_id", "h1", "h2"]) if repeats else text

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of the nodes, each once."""
        wanted = self.same.select("node", "doc_id", "h1", "h2").hint("merge").join(nodes.hint("merge"), "node", "left_semi")
        key = ["doc_id", "h1", "h2"]
        return shingle_sets(self.text.join(wanted.hint("shuffle_hash"), key).select("node", "text"), self.size, self.weights)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of `pairs` whose signatures agree in enough coordinates."""
        sig, least = self.same.select("node", "sig"), self.agree
        left = pairs.hint("merge").join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}).hint("merge"), "a")
        both = left.hint("merge").join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}).hint("merge"), "b").select("a", "b", "sig_a", "sig_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in freed(batches):
                if batch.num_rows:
                    keep = (matrix(batch.column(2)) == matrix(batch.column(3))).sum(1) >= least
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

        return both.mapInArrow(run, "a long, b long")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of `pairs` whose shingle sets are as similar as the threshold says, or more."""
        threshold, weights = self.threshold, self.weights
        pairs = durable(self.likely(pairs))
        if pairs.isEmpty():
            return pairs
        sets = durable(self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        left = pairs.hint("merge").join(sets.withColumnsRenamed({"node": "a", "set": "set_a"}).hint("merge"), "a")
        both = left.hint("merge").join(sets.withColumnsRenamed({"node": "b", "set": "set_b"}).hint("merge"), "b").select("a", "b", "set_a", "set_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in freed(batches):
                keep = [alike(read_set(x, weights), read_set(y, weights), threshold) for x, y in zip(batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return durable(both.mapInArrow(run, "a long, b long"))

    def across(self, rest: DataFrame) -> DataFrame:
        """Links (a, b) between members outside the main component of a bucket and all others of other components.

        `rest`: (key, node, component, main). Both sides are cut into blocks of about BLOCK members and BLOCK_BYTES of
        sets. Signatures go first; of a block only the members come to the second pass that may be like another there.
        """
        threshold, weights, least = self.threshold, self.weights, self.agree
        rows = rest.hint("merge").join(self.same.select("node", "sig", "n_words").hint("merge"), "node")
        rows = durable(rows.withColumn("odd", F.col("component") != F.col("main")))
        parts = lambda of: F.ceil(F.greatest(F.count(of) / float(BLOCK), F.sum(F.when(of.isNotNull(), F.col("n_words"))) * 8 / float(BLOCK_BYTES))).cast("int")
        cut = durable(rows.groupBy("key").agg(parts(F.col("node")).alias("blocks"), parts(F.when(F.col("odd"), F.col("node"))).alias("chunks")))
        rows = rows.hint("merge").join(cut.hint("merge"), "key")
        deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.select("key", deal(1, "blocks").alias("block"), every("chunks").alias("chunk"), "node", "component", F.lit(False).alias("odd"), "sig")
        right = rows.where("odd").select("key", every("blocks").alias("block"), deal(2, "chunks").alias("chunk"), "node", "component", F.lit(True).alias("odd"), "sig")
        place = ["key", "block", "chunk"]

        def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in groups(freed(batches), 3):
                node, component, odd = arrays(block)
                one, two = np.flatnonzero(~odd), np.flatnonzero(odd)
                sig, keep = matrix(block.column(6)), np.zeros(len(node), bool)
                own, whose = sig[one], component[one]
                for j in two.tolist() if len(one) else ():
                    near = ((own == sig[j]).sum(1) >= least) & (whose != component[j])
                    keep[one] |= near
                    keep[j] = near.any()
                if keep.any():
                    yield block.select(range(6)).filter(pa.array(keep))

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in groups(freed(batches), 3):
                node, component, odd = arrays(block)
                own = [read_set(x, weights) for x in block.column(6)]
                one, a, b = np.flatnonzero(~odd), [], []
                for j in np.flatnonzero(odd).tolist():
                    joined = {component[j]}
                    for i in one.tolist():  # one link to each component is enough to join it
                        if component[i] not in joined and alike(own[i], own[j], threshold):
                            joined.add(component[i])
                            a.append(max(node[i], node[j]))
                            b.append(min(node[i], node[j]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        dealt = left.unionByName(right).repartition(*place).sortWithinPartitions(*place)
        likely = durable(dealt.mapInArrow(first, "key long, block int, chunk int, node long, component long, odd boolean"))
        if likely.isEmpty():
            return likely.select(F.col("node").alias("a"), F.col("node").alias("b"))
        sets = durable(self.sets(likely.select("node").distinct()))
        both = likely.hint("merge").join(sets.hint("merge"), "node").select(*place, "node", "component", "odd", "set")
        return both.repartition(*place).sortWithinPartitions(*place).mapInArrow(second, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links lead to, for every id in a link.

    In each round an id takes the smallest label of its neighbours, and then that label's own label; rounds are few
    (logarithmic in practice). Labels are least values, reduced before each shuffle, and both sides of the join are
    tables as they were written, so that Spark can split the edges of a hub: no component gathers anywhere.
    """
    edges = durable(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v").distinct())
    label = durable(edges.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l")))
    before = None
    while (now := label.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()) != before:
        before = now
        near = edges.hint("merge").join(label.withColumnsRenamed({"u": "v"}).hint("merge"), "v").select("u", "l")
        least = near.union(label).groupBy("u").agg(F.min("l").alias("at"))
        label = durable(least.hint("merge").join(label.withColumnsRenamed({"u": "at"}).hint("merge"), "at").select("u", F.least("at", "l").alias("l")))
    return label.withColumnsRenamed({"u": "id", "l": "component"})


def unsettled(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component, main) of the buckets with several components; main is that of the first member."""
    of = labels.withColumnRenamed("id", "node")
    named = durable(held.hint("merge").join(of.hint("merge"), "node", "left").select("key", "node", "least", F.coalesce("component", "node").alias("component")))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("node") == F.col("least"), F.col("component"))).alias("main")).where("low < high")
    return durable(named.hint("merge").join(durable(mixed.select("key", "main")).hint("merge"), "key").select("key", "node", "component", "main"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, weights: str = "binary", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_words): one row a document row. class_id is the smallest doc_id of its near-duplicates."""
    docs = only(docs, "doc_id", "text")
    sig = durable(signed(docs, size, weights, bands, rows))
    worded = sig.where("doc_id is not null and n_words > 0")
    same = worded.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("row"), F.first("n_words").alias("n_words"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    same = durable(same.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "row.*", "n_words", "sig", "keys"))
    # Documents of several rows: their texts belong together.
    repeated = durable(worded.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("c1").alias("a1"), F.max("c1").alias("b1"), F.min("c2").alias("a2"), F.max("c2").alias("b2")).where("n > 1"))
    repeats = not repeated.isEmpty()
    texts = Texts(same, docs, repeats, size, threshold, weights, bands * rows)
    if repeats:
        several = durable(repeated.where("a1 < b1 or a2 < b2").select("doc_id"))
        own = durable(worded.select("doc_id", "c1", "c2").distinct().hint("merge").join(several.hint("merge"), "doc_id", "left_semi"))
        own = durable(own.hint("merge").join(same.select("c1", "c2", "node").hint("merge"), ["c1", "c2"]).select("doc_id", "node"))
        least = durable(own.groupBy("doc_id").agg(F.min("node").alias("b")))
        joined = own.hint("merge").join(least.hint("merge"), "doc_id").where("node > b").select(F.col("node").alias("a"), "b")
    member = same.select("node", F.explode("keys").alias("key"))
    leaders = [F.min_by("node", F.xxhash64(F.lit(i), "node")).alias(f"l{i}") for i in range(LEADERS)]
    bucket = durable(member.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), *leaders).where("n > 1"))
    held = durable(member.hint("merge").join(bucket.select("key", "least").hint("merge"), "key"))
    pairs = durable(held.where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    links = texts.similar(pairs)
    links = links.union(joined) if repeats else links
    labels = components(links)

    # Buckets that still hold several components: those outside the first one's meet more leaders, ...
    rest = unsettled(held, labels)
    odd = rest.where("component <> main")
    if not odd.isEmpty():
        tried = odd.select("key", "node").hint("merge").join(bucket.select("key", F.array(*[f"l{i}" for i in range(LEADERS)]).alias("l")).hint("merge"), "key")
        tried = tried.select("node", F.explode(F.array_distinct("l")).alias("other")).where("node <> other").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
        more = texts.similar(tried.distinct().hint("merge").join(pairs.hint("merge"), ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
            rest = unsettled(held, labels)
        # ... and what is still outside meets all others of its buckets, in blocks.
        if not rest.isEmpty():
            more = durable(texts.across(rest))
            if not more.isEmpty():
                labels = components(links.union(more))
    placed = durable(same.select("c1", "c2", "node", "doc_id").hint("merge").join(labels.withColumnRenamed("id", "node").hint("merge"), "node", "left").select("c1", "c2", "doc_id", F.coalesce("component", "node").alias("component")))
    smallest = durable(placed.groupBy("component").agg(F.min("doc_id").alias("class_id")))
    classes = durable(placed.hint("merge").join(smallest.hint("merge"), "component").select("c1", "c2", "class_id"))
    out = sig.select("doc_id", "c1", "c2", "n_words").hint("merge").join(classes.hint("merge"), ["c1", "c2"], "left")
    # A row without words goes by its document, which other rows may have placed.
    if repeats:
        first = out.where("n_words > 0").hint("merge").join(repeated.select("doc_id").hint("merge"), "doc_id", "left_semi")
        first = durable(first.groupBy("doc_id").agg(F.min("class_id").alias("own")))
        wordless = durable(out.where("n_words = 0"))
        return out.where("n_words > 0").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_words").unionByName(
            wordless.hint("merge").join(first.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("own", "doc_id").alias("class_id"), "n_words")
        )
    return out.select("doc_id", F.when(F.col("n_words") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).otherwise(F.col("doc_id")).alias("class_id"), "n_words")
