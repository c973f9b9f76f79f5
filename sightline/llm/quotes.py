"""Quotation linking: replies without quotes, in the order of replies, as DataFrame functions only.

A line that begins with `>` marks is quoted, as deep as it has marks (`> > x` and `>> x` are level 2). A passage is a run of
quoted lines of one level; blank quoted lines end it. Passages and messages are normalised (lower case, letters and
digits only, one space between) and hashed; a passage of MIN_WORDS words or more links to the latest earlier turn of the
same conversation whose whole body, or one of whose paragraphs or lines, has the same hash, or that holds the passage's lines
one after the other; a shorter passage links to whole bodies alone. Lines without words don't count in a run. Runs go by rolling
hashes: of a text's lines, all runs of 1, 2, 4, ... lines are hashed, each from two of half its length, and a run of any length
is the two of the largest such size that cover it; so time grows with lines and lengths, not with their text. Hashes have 128 bits. The parent of a turn is
the source of its shallowest linked passage, the first of equals; without one, it is the next smaller turn. Depth
and root follow from the parents by doubling joins.

Defined cases: a null text is empty; a message that only quotes has an empty body; messages that share a conversation
and turn share one place in it; rows that repeat in all four columns are one message; a null conv_id or turn keeps the
message without parent, root and depth; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, only

MIN_WORDS = 3
#: Turns, or blocks of them, looked at together.
SPAN = 1024
MARKS = r"^\s*((?:>\s?)+)"


def level(line: Column) -> Column:
    """How many `>` marks a line begins with; 0 if it is not quoted."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def hashed(text: Column) -> Column:
    return F.sha2(normal(text).cast("binary"), 256)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(normal(text), " "), lambda w: w != ""))


def worded(text: Column) -> Column:
    """The normalised lines of a text that have words."""
    return F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")


def parsed(messages: DataFrame) -> DataFrame:
    """The messages with `body` (text without quoted lines) and `passages` (array of level, text in order).

    Quoted messages are taken apart into rows, so that a passage of any length is put together once.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = messages.withColumn("_m", F.monotonically_increasing_id()).withColumn("body", F.trim(F.array_join(F.filter(lines, lambda x: level(x) == 0), "\n")))
    rows = durable(rows)
    quoted = rows.where(F.col("text").rlike("(?m)^\\s*>")).select("_m", F.posexplode(lines).alias("i", "line"))
    bare = F.regexp_replace("line", MARKS, "")
    quoted = quoted.select("_m", "i", bare.alias("line"), F.when(F.trim(bare) != "", level(F.col("line"))).otherwise(0).cast("int").alias("level"))
    order = W.partitionBy("_m").orderBy("i")  # the lines of one message
    begins = F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1)
    runs = quoted.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).where("level > 0")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    passages = runs.groupBy("_m", "run").agg(F.max("level").alias("level"), texts.alias("text"))
    passages = passages.groupBy("_m").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "level", "text"))), lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"))).alias("passages"))
    none = F.array().cast("array<struct<level:int,text:string>>")
    out = rows.hint("merge").join(durable(passages).hint("merge"), "_m", "left")
    return out.select(*messages.columns, "body", F.coalesce("passages", none).alias("passages"))


def earlier(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, turn, earlier): for each point, the largest smaller turn with the same keys that is a `source`.

    `points`: keys, turn, source; one row for each keys and turn. Turns are looked at in blocks of SPAN, then blocks among
    themselves in the same way, so that neither a long conversation nor a passage that all quote is ever one group.
    """
    cut = durable(points.select(*keys, "turn", "source", F.floor(F.col("turn") / SPAN).cast("long").alias("block")))
    of = lambda c: F.max(F.when(F.col("source"), F.col(c)))
    inside = cut.withColumn("earlier", of("turn").over(W.partitionBy(*keys, "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)))
    low, high = cut.agg(F.min("block"), F.max("block")).first()
    if low == high:
        return inside.select(*keys, "turn", "earlier")
    blocks = durable(cut.groupBy(*keys, "block").agg(of("turn").alias("last")))
    above = earlier(blocks.select(*keys, F.col("block").alias("turn"), F.col("last").isNotNull().alias("source")), keys)
    above = above.where("earlier is not null").select(*keys, F.col("turn").alias("block"), F.col("earlier").alias("from"))
    last = above.hint("merge").join(blocks.withColumnRenamed("block", "from").hint("merge"), [*keys, "from"]).select(*keys, "block", "last")
    both = inside.hint("merge").join(durable(last).hint("merge"), [*keys, "block"], "left")
    return both.select(*keys, "turn", F.coalesce("earlier", "last").alias("earlier"))


def doubled(hashes: Column, half: int, salt: int):
    """Of the run that begins at a place, the hash made from its own half's and the next half's."""
    return lambda x, i: F.xxhash64(F.lit(salt), x, F.try_element_at(hashes, i + half + 1))


def with_runs(rows: DataFrame, levels: int) -> DataFrame:
    """`rows` with h and g, arrays by size of arrays by place, of the column `lines`. Each size is a column made from the one before."""
    names = {"h": "_h", "g": "_g"}
    out = rows.withColumns({"_h0": F.transform("lines", lambda x: F.xxhash64(x)), "_g0": F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long"))})
    for k in range(levels):
        half, new = 1 << k, {}
        for salt, c in enumerate(names.values()):
            a = F.col(f"{c}{k}")
            new[f"{c}{k + 1}"] = F.transform(F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - half)), doubled(a, half, salt))
        out = out.withColumns(new)
    made = [f"{c}{k}" for c in names.values() for k in range(levels + 1)]
    return out.withColumns({name: F.array(*[F.col(f"{c}{k}") for k in range(levels + 1)]) for name, c in names.items()}).drop(*made)


def sized(rows: DataFrame) -> DataFrame:
    """`rows` with h and g of the largest size that two runs of cover `n` lines, and that size as `half`."""
    k = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    return rows.withColumns({"h": F.element_at("h", k + 1), "g": F.element_at("g", k + 1), "half": F.pow(F.lit(2), k).cast("int")})


def run_key(i: Column) -> Column:
    """What stands for the run of `n` lines that begins at the i-th."""
    at = [F.element_at(F.col(c), j.cast("int")) for c in ("h", "g") for j in (i, i + F.col("n") - F.col("half"))]
    return F.concat_ws(" ", F.lit("run"), F.col("n").cast("string"), *[x.cast("string") for x in at])


def linked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, pos, source): each quoted passage with the turn that it comes from."""
    quotes = rows.where("size(passages) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("passages").alias("pos", "p"))
    quotes = quotes.select("conv_id", "turn", "pos", "p.level", hashed(F.col("p.text")).alias("hash"), words(F.col("p.text")).alias("n_words"), worded(F.col("p.text")).alias("lines"))
    asked = durable(quotes.where("n_words > 0").withColumns({"whole": F.col("n_words") < MIN_WORDS, "n": F.size("lines")}))
    most = asked.where("not whole").agg(F.max("n")).first()[0] or 1
    levels = most.bit_length() - 1
    lengths = asked.where("not whole").groupBy("conv_id").agg(F.collect_set("n").alias("lengths"))
    lengths = durable(asked.select("conv_id").distinct().hint("merge").join(lengths.hint("merge"), "conv_id", "left"))
    here = rows.where("turn is not null").hint("merge").join(lengths.hint("merge"), "conv_id").select("conv_id", "turn", "body", "lengths", worded(F.col("body")).alias("lines"))
    each = with_runs(here.where("size(lengths) > 0").drop("body"), levels).select("conv_id", "turn", F.size("lines").alias("size"), "h", "g", F.explode("lengths").alias("n")).where("n <= size")
    runs = sized(each).select("conv_id", "turn", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), run_key)).alias("hash"))
    parts = here.select("conv_id", "turn", F.explode(F.concat(F.array("body"), F.split("body", r"\n\s*\n"), F.split("body", "\n"))).alias("unit"))
    sources = parts.select("conv_id", "turn", hashed(F.col("unit")).alias("hash")).unionByName(runs).withColumn("whole", F.lit(False))
    sources = sources.unionByName(here.select("conv_id", "turn", hashed(F.col("body")).alias("hash"), F.lit(True).alias("whole")))
    keys = ["conv_id", "hash", "whole"]
    # a passage asks by its text, and by its lines
    by_lines = sized(with_runs(asked.where("not whole"), levels)).select("conv_id", "turn", "level", "pos", "whole", run_key(F.lit(1)).alias("hash"))
    asked = durable(asked.select("conv_id", "turn", "level", "pos", "whole", "hash").unionByName(by_lines))
    points = sources.select(*keys, "turn", F.lit(True).alias("source")).unionByName(asked.select(*keys, "turn", F.lit(False).alias("source")))
    points = earlier(points.groupBy(*keys, "turn").agg(F.max("source").alias("source")), keys).where("earlier is not null")
    return asked.hint("merge").join(durable(points).hint("merge"), [*keys, "turn"]).groupBy("conv_id", "turn", "level", "pos").agg(F.max("earlier").alias("source"))


def previous(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, earlier): the next smaller turn of the conversation."""
    return earlier(turns.withColumn("source", F.lit(True)), ["conv_id"])


def depths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from (conv_id, turn, parent): by doubling, k joins follow 2^k ancestors."""
    known = durable(parents.select("conv_id", "turn", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "turn").alias("root_turn")))
    while not (rest := known.where("up is not null")).isEmpty():
        above = known.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root_turn").alias("root"))
        step = rest.hint("merge").join(above.hint("merge"), ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("root").alias("root_turn"))
        known = durable(known.where("up is null").unionByName(step))
    return known.select("conv_id", "turn", "root_turn", "depth")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n_quotes, n_linked, parent_turn, root_turn, depth): each message without its quotes.

    Ordered by (conv_id, root_turn, depth, turn), every reply stands after what it replies to.
    """
    rows = durable(parsed(only(messages, "conv_id", "turn", "role", "text").distinct()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "body", "passages"))
    links = durable(linked(rows))
    first = links.groupBy("conv_id", "turn").agg(F.min_by("source", F.struct("level", "pos")).alias("source"), F.count("*").alias("n_linked"))
    turns = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    nodes = previous(turns).hint("merge").join(first.hint("merge"), ["conv_id", "turn"], "left")
    nodes = durable(nodes.select("conv_id", "turn", F.coalesce("source", "earlier").alias("parent"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")))
    placed = nodes.hint("merge").join(depths(nodes).hint("merge"), ["conv_id", "turn"])
    out = rows.hint("merge").join(placed.hint("merge"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"), "root_turn", "depth")
