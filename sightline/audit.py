"""The library's front door: an audit of every site in a DataFrame of pages.

    from sightline.audit import audit
    run = audit(pages, link_status=statuses, profile="strict", as_of="2025-06-01")
    run.table("score_every_site"), run.table("findings"), run.table("roadmap")

`pages` has page_id, url and html; where it is a table made by `sources.pages.bucketed`, html isn't shuffled. `html`, a table of
page_id, url and html, stands in for the html of `pages`, which then needs page_id and url alone; its other rows are not read. Side tables are optional and default to empty ones of the right columns. Outside
evidence (entities, corpus_index, the status of profiles) counts for the sites in `external_runs` only, those that it was
gathered for; without it, no finding says that the outside knows nothing of a brand. A rule of
your own is a DataFrame of (site, check_id, n) passed as `extra_hits`, with its row of the catalog in `extra_checks`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sightline.queries  # noqa: F401
from sightline.plans.relations import RELATIONS, Settings, build

SIDE_TABLES = {
    "responses": "url string, status int, elapsed_ms bigint, raw_len bigint, content_type string, x_robots string, error string, final_url string, headers string",
    "robots": "site string, body string",
    "sitemaps": "site string, url string, body string",
    "link_status": "url string, status int",
    "entities": "label string, entity_id string, official_website string, hit_rank int",
    "corpus_index": "domain string, records bigint",
    "external_runs": "site string",
    "audit_history": "id bigint, domain string, audited_at date, score int, total_findings bigint",
    "targets": "site string",
    "peers": "site string, peer string",
    "scenario": "site string, id string",
    "expected": "site string, category string",
    "expected_limits": "site string, max_critical int, max_high int, absent_title string",
}
#: The rules of each check group (fixed values).
SKILLS = {"crawl-render": "C", "structured-data": "D", "content-extractability": "E", "freshness-corroboration": "FR", "engagement": "G", "consistency": "H", "regions": "I", "external": "X", "input": "O"}


@dataclass
class Audit:
    spark: SparkSession
    tables: dict[str, DataFrame]
    settings: Settings
    made: dict[str, DataFrame]

    def table(self, name: str) -> DataFrame:
        """A relation of the audit by name; see sightline.queries for the names."""
        if name not in RELATIONS:
            raise ValueError(f"unknown table {name!r}")
        return build(self.spark, name, self.tables, self.settings, self.made)

    def find_findings(self, text: str = "", dimension: list[str] | None = None, severity: list[str] | None = None, confidence: list[str] | None = None) -> DataFrame:
        """The findings whose title, id or category holds `text`, of the values given; see finding_facets for those there are."""
        out = self.table("findings")
        for column, chosen in (("dimension", dimension), ("severity", severity), ("confidence", confidence)):
            out = out.where(out[column].isin(chosen)) if chosen else out
        return out.where(F.contains(F.lower(F.concat_ws(" ", "id", "title", "category")), F.lit(text.lower()))) if text else out

    def find_pages(self, text: str = "", by: str = "score") -> DataFrame:
        """The page records whose url or title holds `text`, by score (lowest first), findings (most first) or url.

        A text of three characters or more is looked up in the stored postings of its grams; only pages that have all of them are compared.
        """
        orders = {"score": ["score", "url"], "findings": [F.desc("findings"), "url"], "url": ["url"]}
        if by not in orders:
            raise ValueError(f"unknown order {by!r}; choose from {sorted(orders)}")
        rows = self.table("page_records")
        if text:
            titles = self.table("page_signals").select("site", "url", F.col("title").alias("_title"))
            if len(text) > 2:
                grams = {text.lower()[i : i + 3] for i in range(len(text.lower()) - 2)}
                met = self.table("page_grams").where(F.col("gram").isin(sorted(grams))).groupBy("site", "url").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
                titles = titles.join(met.drop("n"), ["site", "url"], "left_semi")
            rows = rows.join(titles, ["site", "url"]).where(F.contains(F.lower(F.concat_ws(" ", "url", "_title")), F.lit(text.lower()))).drop("_title")
        return rows.orderBy(*orders[by])


def audit(
    pages: DataFrame, *, profile: str = "balanced", max_pages: int = 12, scope: str = "host", as_of: str = "2025-06-01", skills: list[str] | None = None, thresholds: dict | None = None,
    extra_hits: DataFrame | None = None, extra_checks: DataFrame | None = None, html: DataFrame | None = None, **side: DataFrame,
) -> Audit:
    spark = pages.sparkSession
    unknown = set(side) - set(SIDE_TABLES)
    if unknown:
        raise ValueError(f"unknown side tables: {sorted(unknown)}")
    tables = {"crawl": pages.select("page_id", "url", *(["html"] if html is None else [])).where("url is not null")}
    if html is not None:
        tables["page_html"] = html.select("page_id", "url", "html")
    for name, schema in SIDE_TABLES.items():
        tables[name] = side[name] if name in side else spark.createDataFrame([], schema)
    if "final_url" not in tables["responses"].columns:
        tables["responses"] = tables["responses"].withColumn("final_url", F.col("url"))
    if "headers" not in tables["responses"].columns:
        tables["responses"] = tables["responses"].withColumn("headers", F.lit(None).cast("string"))
    if "url" not in tables["sitemaps"].columns:  # each site's one map
        tables["sitemaps"] = tables["sitemaps"].selectExpr("site", "concat('https://', site, '/sitemap.xml') url", "body")
    out = Audit(spark, tables, Settings(profile, max_pages, scope, as_of, thresholds or {}), {})
    if skills or extra_hits is not None:
        hits = out.table("check_hits")
        if skills:
            letters = "".join(SKILLS[s.removesuffix("-audit")] for s in skills)
            hits = hits.where(hits["check_id"].substr(1, 1).isin(list(letters)))
        if extra_hits is not None:
            more = extra_hits.selectExpr("site", "check_id", "cast(n as bigint) n", "cast(0 as bigint) n_affected", "cast(null as string) example", "cast(null as string) affected")
            hits = hits.unionByName(more)
            if extra_checks is not None:
                tables["check_catalog"] = out.table("check_catalog").unionByName(extra_checks)
        tables["check_hits"] = hits
        out.made.clear()
    return out
