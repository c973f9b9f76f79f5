"""Corpus pipeline: language filter, line dedup, near-duplicate removal, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last returns the tokens of each document. A stage's result is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, language_id, line_dedup, near_dup, piece_tokenizer
from sightline.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less sure than this is rejected, as is one without letters.
LEAST_SCORE = 0.3


def with_n_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    return language_id.identified(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_n_chars(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays: that with the smallest id (no id comes last), of these the smallest hash of its text.

    Classes are made of rows, not of ids: rows that share an id or have none are told apart by a number of their own.
    Rows without words are like no others, but exact copies of one (id and text) go.
    """
    rows = durable(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256)))
    classes = near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id", "n_words")
    placed = rows.select("_row", "doc_id", "_sha").hint("merge").join(classes.hint("merge"), "_row")
    wordless = F.col("n_words") == 0
    group = [F.when(~wordless, F.col("class_id")).alias("_class"), F.when(wordless, F.col("doc_id")).alias("_id"), F.when(wordless, F.col("_sha")).alias("_text"), wordless.alias("_wordless")]
    first = placed.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_sha", "_row")).alias("first"))
    stays = first.select(F.col("first._row").alias("_stays"))
    return rows.hint("merge").join(stays.hint("merge"), F.col("_row") == F.col("_stays"), "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_tokenizer.digests(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("tokenize", tokenize),
]

#: Language identification is a trained model, so no SQL gives these rows; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
