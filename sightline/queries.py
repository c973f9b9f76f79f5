"""Registered queries: each builds one relation over the tables of a folder; SQL for DuckDB comes from the same relation.

Relations marked `stored` or `kept` (sample, signals, links, nodes, totals, hits, findings, claims) are written once for each session and
folder and shared by the queries that read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import sightline.operators.checks  # noqa: F401
import sightline.operators.extract  # noqa: F401
import sightline.operators.facts  # noqa: F401
import sightline.operators.guidance  # noqa: F401
import sightline.operators.regions  # noqa: F401
import sightline.operators.scoring  # noqa: F401
import sightline.sources.corpus  # noqa: F401
import sightline.operators.region_audits  # noqa: F401  isort: skip  (after all that it registers again)
from sightline.plans.oracle import by_hand
from sightline.plans.relations import BASE, RELATIONS, build, duckdb_sql

#: Relations that are queries of their own, by area.
SOURCES = "crawl responses response_headers response_of robots sitemaps sitemap_urls link_status entities corpus_index external_runs llms_status sitemap_maps latest_audit input_targets"
PAGES = "page_urls page_sample site_pages page_tokens page_signals page_grams page_links page_headings page_images page_hreflang page_jsonld page_link_counts page_types"
RULES = "page_rule_hits page_count_hits hreflang_hits node_hits broken_links robots_lines robots_rules site_rule_hits check_hits fact_sources identity_facts social_handles fact_conflicts conflict_hits superlatives boast_hits like_names home_schema_name"
OUTSIDE = "region_variants region_places region_summary region_targets region_sample region_scores region_notes profile_urls profile_states brand_names brand_candidates entity_matches external_evidence external_hits"
SCORES = (
    "findings site_scores severity_counts score_every_site matrix quick_wins quadrant_counts projection scenario_scores distribution finding_pages hotspots roadmap fix_snippets fix_plan action_plan coverage_checks coverage coverage_summary pillar_scores funnel funnel_notes "
    "kpis narratives brief_lines page_records sections key_pages llms_text exported_findings report_violations scoring_model finding_search finding_facets page_search top_findings keyword_titles keyword_matches"
)
FACTS = (
    "consistency claims claim_summary citation_components citation_scores simulated_answers answer_summary answer_readiness readiness_scores prompts graph_nodes graph_edges graph_missing opportunities peer_gaps peer_rows history_deltas headline evaluation_rows evaluation"
)
NAMES = " ".join([SOURCES, PAGES, RULES, OUTSIDE, SCORES, FACTS]).split()

_stored: dict[tuple, dict[str, DataFrame]] = {}


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables of a folder were last written."""
    out = []
    for t in BASE:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((status.getModificationTime(), status.getLen()))
    return tuple(out)


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _stored.setdefault((spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir)), {})
        made = dict(kept)
        out = build(spark, name, base_tables(spark, sf_dir), None, made)
        kept.update({k: v for k, v in made.items() if RELATIONS[k].stored or RELATIONS[k].kept})
        return out

    return run


def forget() -> None:
    """Lets the next query compute everything anew."""
    _stored.clear()


QUERIES = {n: query(n) for n in NAMES}


def oracle() -> dict[str, str]:
    return {n: duckdb_sql(n) for n in NAMES} | by_hand()
