"""Audits that follow a landing folder: pages arrive as files, the sites they touch are scored again.

Three tables lie in the page folder: `batch=<n>` has the pages of a batch, html included; `_addresses/batch=<n>` has their
addresses; `_addresses/upto=<n>` is a snapshot, written every SNAPSHOT batches, of the latest batch of each address. All are dealt to
folders by site. A batch reads the last snapshot and the addresses of the batches since, for its own parts alone, takes the
sample on these, and fetches the html of the sampled pages from the batches they came in. So what a batch reads grows
neither with the number of batches before it nor with the html of the pages that are not sampled.

A batch that is run again after a failure overwrites its own folders and sees no later one, so results do not double.

Defined cases: of pages with one address the latest batch counts, in a batch the largest page_id, then the largest html; pages without an
address are left out; a batch without pages writes no scores; a snapshot that was not finished is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.audit import Audit, audit
from sightline.functions.urls import bare_host
from sightline.session import durable

PAGE_SCHEMA = "page_id bigint, url string, html string"
#: Folders that a batch's pages are dealt to by site, so that a later batch reads those of its own sites alone.
PARTS = 256
#: Batches between two snapshots of the addresses.
SNAPSHOT = 16


def _finished(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders <prefix><n> that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    own = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]
    return sorted(n for n in own if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}{n}/_SUCCESS")))


class PageFolder:
    """The pages that have arrived, and where the latest of each address is."""

    ROWS = "page_id bigint, url string, html string, site string, part int"
    ADDRESSES = "page_id bigint, url string, site string, batch bigint, part int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.index = spark, path, f"{path}/_addresses"

    def add(self, pages: DataFrame, batch_id: int) -> None:
        own = pages.where("url is not null").groupBy("url").agg(F.max(F.struct("page_id", "html")).alias("p")).select("p.page_id", "url", "p.html")
        rows = own.withColumn("site", F.expr(bare_host("url"))).withColumn("part", F.pmod(F.xxhash64("site"), F.lit(PARTS)).cast("int"))
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batch={batch_id}")
        written = self._read(f"{self.path}/batch={batch_id}", self.ROWS)
        found = written.select("page_id", "url", "site", F.lit(batch_id).cast("bigint").alias("batch"), "part").hint("rebalance", "part")
        found.write.mode("overwrite").partitionBy("part").parquet(f"{self.index}/batch={batch_id}")

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def addresses(self, batch_id: int) -> DataFrame:
        """The latest (page_id, url, site, batch, part) of each address, up to this batch."""
        start = max([n for n in _finished(self.spark, self.index, "upto=") if n < batch_id], default=-1)
        later = [n for n in _finished(self.spark, self.index, "batch=") if start < n <= batch_id]
        tables = [self._read(f"{self.index}/upto={start}", self.ADDRESSES)] if start >= 0 else []
        tables += [self._read(f"{self.index}/batch={n}", self.ADDRESSES) for n in later]
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        # a url has one site and one part, so they need no part in the grouping
        return every.groupBy("url").agg(F.max(F.struct("batch", "page_id", "site", "part")).alias("a")).select("a.page_id", "url", "a.site", "a.batch", "a.part")

    def touched(self, batch_id: int) -> DataFrame:
        """The latest addresses of the sites that have pages in this batch."""
        sites = durable(self._read(f"{self.index}/batch={batch_id}", self.ADDRESSES).where("site <> ''").select("site", "part").distinct())
        parts = [r["part"] for r in sites.select("part").distinct().collect()]  # PARTS at most
        return durable(self.addresses(batch_id).where(F.col("part").isin(parts)).join(sites.select("site"), "site", "left_semi"))

    def html(self, chosen: DataFrame) -> DataFrame:
        """The html of `chosen` (page_id, url, batch, part), from the batches that they came in."""
        batches = sorted(r["batch"] for r in chosen.select("batch").distinct().collect())  # numbers of batches alone
        out = self.spark.createDataFrame([], PAGE_SCHEMA)
        if batches:
            folders = [f"{self.path}/batch={b}" for b in batches]
            rows = self.spark.read.schema(f"{self.ROWS}, batch bigint").option("basePath", self.path).parquet(*folders)
            out = rows.join(chosen.select("page_id", "url", "batch", "part"), ["page_id", "url", "batch", "part"]).select("page_id", "url", "html")
        return out

    def snapshot(self, batch_id: int) -> None:
        self.addresses(batch_id).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.index}/upto={batch_id}")


def scored(folder: PageFolder, batch_id: int, **options) -> Audit:
    """The audit of the sites that a batch touches, as they stand after it."""
    latest = folder.touched(batch_id)
    pages = latest.select("page_id", "url")
    sample = audit(pages, html=folder.spark.createDataFrame([], PAGE_SCHEMA), **{k: v for k, v in options.items() if k not in ("skills", "extra_hits", "extra_checks")}).table("site_pages")
    chosen = durable(latest.join(sample.select("page_id", "url"), ["page_id", "url"], "left_semi"))
    return audit(pages, html=folder.html(chosen), **options)


def follow(spark: SparkSession, landing: str, pages_path: str, scores_path: str, checkpoint: str, **options):
    """A query that reads JSON page files from `landing`; use `.processAllAvailable()` or `.awaitTermination()` on it."""
    folder = PageFolder(spark, pages_path)

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        folder.add(batch.select("page_id", "url", "html"), batch_id)
        run = scored(folder, batch_id, **options)
        run.table("score_every_site").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{scores_path}/run={batch_id}")
        if batch_id % SNAPSHOT == SNAPSHOT - 1:
            folder.snapshot(batch_id)

    return spark.readStream.schema(PAGE_SCHEMA).json(landing).writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
