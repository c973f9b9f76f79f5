"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Base spans come from three patterns (an assignment to a secret-like name, an access key, a long hexadecimal run). The
method adds spans of its own: tokens of TOKEN_CHARS characters or more from `[A-Za-z0-9+/_=-]` whose log-likelihood
ratio per transition, random against ordinary, is at least LIMIT. Both models are first-order Markov chains over
characters, with add-one smoothing, counted over the whole corpus from labelled samples: the values of base spans
are the random strings, all other words of ASCII letters, digits and `_` of 4 characters or more, of any length and as
written and in capitals, are the ordinary identifiers. The ratio alone decides; a token needs no digit. A model is at most 128 x 128 transitions, so it goes into the plan as a literal.

All of it is DataFrame functions. A span is (kind, start, end) in code points, end exclusive. Positions come from
matches that take in what stands before them, so that lengths add up to places; only texts that hold a match at all are
taken apart.

Defined cases: a null text is like an empty one and has no spans; a corpus without base spans has no random sample, and
no token is then added; texts of any length are scanned whole; rows that repeat are scanned each; extra columns play
no part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, what finds a candidate, what must be in a text to look for any, least characters of the counted group).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short can be left out of the pattern: what follows their beginning is shorter still. Not so for assignments.
ACCESS, HEX = r"(AKIA[A-Z0-9]{16,})", r"([0-9a-f]{24,})"
KINDS = [("assign", ASSIGN, ASSIGN, 6), ("access", ACCESS, ACCESS, 20), ("hex", HEX, HEX, 24)]
TOKEN_CHARS, LIMIT = 20, 0.35
TOKEN = r"([A-Za-z0-9+/_=-]{20,})"
#: Matches whose places are added up together.
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, kind: int, pattern: str, enough: str, least: int) -> Column:
    """array<struct(start, kind, end, value)> of the leftmost non-overlapping matches whose group 1 is long enough."""
    whole = rf"(?s)(.*?)(?:({pattern})|\z)"  # the end of the text matches too, so that the rest is read once
    before = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    value = F.regexp_extract_all(text, F.lit(whole), F.lit(3))
    parts = F.arrays_zip(before.alias("b"), found.alias("f"), value.alias("v"))
    return F.when(text.rlike(enough), placed(parts, kind, least)).otherwise(F.array().cast(SPAN))


def placed(parts: Column, kind: int, least: int) -> Column:
    """The spans of `parts` (text before a match, match, value), whose lengths add up to places.

    Parts are added up in blocks of BLOCK and blocks among themselves, as an array that grows is copied at each step.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda k: F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)))
    length = lambda x: F.length(x["b"]) + F.length(x["f"])
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["at"] + F.aggregate(b, F.lit(0), lambda n, x: n + length(x))).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["f"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.zip_with(blocks, begins, spans))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[matches(text, i, pattern, enough, least) for i, (_, pattern, enough, least) in enumerate(KINDS)]))


def transitions(tokens: Column) -> Column:
    """All pairs of neighbouring characters of the tokens in an array."""
    return F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2))))


def counted(pairs: DataFrame) -> dict[str, int]:
    """How often each transition (column `pair`) occurs; at most 64 x 64 rows reach the driver."""
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def log_ratio(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary), at 128 * a + b."""
    import math

    used = sorted({c for p in (*random, *ordinary) for c in p})
    total = [{a: sum(m.get(a + b, 0) for b in used) + len(used) for a in used} for m in (random, ordinary)]
    out = [0.0] * (128 * 128)
    for a in used:
        for b in used:
            out[128 * ord(a) + ord(b)] = round(math.log((random.get(a + b, 0) + 1) / total[0][a]) - math.log((ordinary.get(a + b, 0) + 1) / total[1][a]), 5)
    return out


def train(docs: DataFrame) -> list[float] | None:
    """The log-ratio table of a corpus; None if it has no labelled random strings."""
    text = F.coalesce("text", F.lit(""))
    spans = docs.select(base_spans(text).alias("s")).where(F.size("s") > 0)
    values = spans.select(F.explode(transitions(F.transform("s", lambda x: x["value"]))).alias("pair"))
    random = counted(values.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")))
    if not random:
        return None
    free = text
    for _, pattern, enough, least in KINDS:  # values of base spans are no ordinary words
        free = F.when(text.rlike(enough), F.regexp_replace(free, pattern, " ")).otherwise(free)
    words = docs.select(F.explode(F.regexp_extract_all(free, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_]{3,})(?![A-Za-z0-9_])"), F.lit(1))).alias("word"))
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    words = words.select("n", F.explode(F.array_distinct(F.array("word", F.upper("word")))).alias("word"))
    pairs = words.select("n", F.explode(transitions(F.array("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    return log_ratio(random, {r["pair"]: r["n"] for r in pairs.collect()})


def score(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    code = lambda i: F.ascii(F.substring(token, i, 1))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, code(i) * 128 + code(i + 1)))
    return total / (F.length(token) - 1)


def scanned(docs: DataFrame, model: list[float] | None = None, limit: float = LIMIT) -> DataFrame:
    """(doc_id, base, added): arrays of spans by start and kind. Added tokens do not overlap a base span."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    if model is None:
        return rows.select("doc_id", "base", F.array().cast(SPAN).alias("added"))
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    tokens = matches(F.col("text"), len(KINDS), TOKEN, TOKEN, TOKEN_CHARS)
    free = F.filter(tokens, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    added = F.filter(free, lambda t: score(t["value"], table) >= limit)
    return rows.select("doc_id", "base", added.alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("random"))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secret_digests(docs: DataFrame) -> DataFrame:
    found = scanned(docs, train(docs))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"),
    )
