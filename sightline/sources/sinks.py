"""Sinks and report sources: CSV and JSON exports, saved reports, the audit history (survey S9-S14)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of the CSV export, in order (fixed values).
CSV_COLUMNS = ["id", "priority", "severity", "dimension", "category", "confidence", "impact", "effort", "effort_label", "quadrant", "points_at_stake", "title", "evidence", "why", "suggested_action", "action_priority", "affected_pages"]


def write_csv(exported_findings: DataFrame, path: str) -> None:
    exported_findings.select("site", *CSV_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def report_json(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """(site, report): one JSON document for each site, its findings by priority."""
    rows = findings.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("priority", "id", "title", "severity", "dimension", "category", "confidence", "scope", "reason"))).alias("findings"))
    return scores.join(rows, "site", "left").select("site", F.to_json(F.struct("site", "value", "grade", "discoverability", "engagement", "findings")).alias("report"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    schema = "site string, value bigint, grade string, discoverability double, engagement double, findings array<struct<priority:int,id:string,title:string,severity:string,dimension:string,category:string,confidence:string,scope:string,reason:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match and whose writing came to its end: Spark's writers leave _SUCCESS last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def append_history(scores: DataFrame, path: str, audited_at: str, run: str | None = None) -> None:
    """Adds a run's scores to the history. A run that is written again, whole or after a failure, adds what it lacks alone.

    `run` names the run; by default the time of the audit does, so audits of other times stand beside each other. Rows go to
    path/audit_date=<day>/run=<run>/attempt=<own>; sites that a committed attempt of the run holds are left out by an anti join.
    """
    spark, run = scores.sparkSession, run or audited_at
    rows = scores.select(F.col("site").alias("domain"), F.lit(audited_at).cast("timestamp").alias("audited_at"), F.col("value").cast("int").alias("score"), "grade", F.lit(run).alias("run_key"))
    folder = f"{path}/audit_date={audited_at[:10]}/run={hashlib.sha256(run.encode()).hexdigest()[:16]}"
    if done := committed(spark, f"{folder}/attempt=*"):
        rows = rows.join(spark.read.parquet(*done).select("domain").hint("merge"), "domain", "left_anti")
    rows.write.parquet(f"{folder}/attempt={uuid.uuid4().hex}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(domain, audited_at, score, grade, run_key, audit_date) of all committed runs, one row for each run and site.

    Two attempts of a run that raced may both hold a site; the one whose name is smaller counts.
    """
    done = committed(spark, f"{path}/audit_date=*/run=*/attempt=*")
    if not done:
        return spark.createDataFrame([], "domain string, audited_at timestamp, score int, grade string, run_key string, audit_date date")
    rows = spark.read.option("basePath", path).parquet(*done)
    first = F.row_number().over(W.partitionBy("audit_date", "run_key", "domain").orderBy("attempt"))
    return rows.withColumn("_first", first).where("_first = 1").select("domain", "audited_at", "score", "grade", "run_key", "audit_date")


#: The sections of a brief, in order.
SECTIONS = ["Summary", "Pillars", "Quick wins", "Findings", "Action plan", "Funnel"]


def brief_text(brief_lines: DataFrame) -> DataFrame:
    """(site, text): the sections of a brief that have lines, each under its heading."""
    heads = brief_lines.select("site", "section").distinct().select("site", "section", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("\n## "), F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section"))).alias("line"))
    lines = heads.unionByName(brief_lines.select("site", "section", "ord", F.concat(F.lit("- "), "line").alias("line")))
    return lines.groupBy("site").agg(F.concat(F.lit("# "), "site", F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))), lambda x: x["line"]), "\n")).alias("text"))
