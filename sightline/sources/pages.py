"""The page table as a stored table, laid out for audits.

An audit takes its sample on addresses and then fetches the html of the sampled pages alone. From a table that is bucketed
by the columns of that join, html is read where it lies: only the sample (a dozen addresses a site) is shuffled, to the
buckets of the table, whatever the size of the crawl.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: What the html of a page is fetched by.
KEYS = ("page_id", "url")


def bucketed(pages: DataFrame, table: str, buckets: int | None = None) -> DataFrame:
    """`pages` (page_id, url, html) written as a catalog table with one sorted file a bucket; pass the result to `audit`.

    `buckets` is by default the number of shuffle partitions: choose it so that a bucket is some hundred megabytes. An existing
    table of this name is replaced. Rows are kept as they are, repeated ones and those without an address too.
    """
    spark = pages.sparkSession
    n = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select("page_id", "url", "html").repartition(n, *KEYS)
    rows.write.mode("overwrite").bucketBy(n, *KEYS).sortBy(*KEYS).format("parquet").saveAsTable(table)
    return spark.table(table)
