"""Audits of a site's regions (survey A21, L9): pages are dealt to variants by prefix, and each variant is scored from its own.

A variant on a host of its own is a site of the crawl and has that site's scores. A variant below a path of the site (`/fr/`) is a
scope: the pages at or below its address, each given to the longest prefix that it has. All relations that lead to scores are registered again over these pages
(`rg_...`), with the robots file, sitemaps and outside evidence of the host. A scope is written ~<k>.<site>, which is no host.
"""

from sightline.functions.urls import bare_host, is_deep, page_type_rank, section
from sightline.plans.relations import relation, scoped

#: Variants of a site that are scored (fixed value).
MOST = 3


def targets(places: str, kept: str = "") -> str:
    """The live variants of a site among `places`, each address once, without that of the site itself; those `kept` of them, without it all."""
    return r"""
SELECT site, variant, label, place, k, prefix, host, CASE WHEN host = site OR host = own_host THEN '~' || k || '.' || site ELSE host END AS audited, host = site OR host = own_host AS is_scope FROM (
  SELECT site, variant, label, place, prefix, host, own_host, row_number() OVER (PARTITION BY site ORDER BY place) AS k FROM (
    SELECT v.site, v.variant, v.label, v.place, regexp_replace(v.variant, r'/+$', '') AS prefix, """ + bare_host("v.variant") + r""" AS host, """ + bare_host("t.home_url") + r""" AS own_host, row_number() OVER (PARTITION BY v.site, regexp_replace(v.variant, r'/+$', '') ORDER BY v.place) AS seen
    FROM {""" + places + r"""} v JOIN {site_totals} t ON v.site = t.site WHERE NOT v.is_dead AND regexp_replace(v.variant, r'/+$', '') <> regexp_replace(t.home_url, r'/+$', '')) WHERE seen = 1)""" + kept + r"""
"""


relation("region_targets", targets("all_places"))
# The first of them, which region_sample, region_scores and region_notes are made from; in DuckDB's SQL it keeps the name that it has there.
relation("scored_targets", targets("region_places", " WHERE k <= " + str(MOST)), shown="region_targets")
relation("region_scopes", "SELECT site, audited AS scope, prefix FROM {scored_targets} WHERE is_scope", stored=True)

# in Spark, pages meet the scopes first, and the few that have one are looked at more closely
relation("region_sample", r"""
SELECT page_id, url, site, section, is_deep, row_number() OVER (PARTITION BY site ORDER BY at_root DESC, type_rank, url, page_id) AS page_ord FROM (
  SELECT u.page_id, u.url, s.scope AS site, u.section, u.is_deep, u.type_rank, CASE WHEN regexp_replace(u.url, r'/+$', '') = s.prefix THEN 1 ELSE 0 END AS at_root,
         row_number() OVER (PARTITION BY u.url ORDER BY length(s.prefix) DESC, s.scope, u.page_id) AS longest
  FROM {page_urls} u LEFT JOIN {not_html} n ON u.url = n.url JOIN {region_scopes} s ON u.$site$ = s.site AND (startswith(u.url, s.prefix || '/') OR u.url = s.prefix) WHERE NOT u.is_asset AND n.url IS NULL) WHERE longest = 1
""", replaces="page_urls", spark=r"""
SELECT page_id, url, site, """ + section("url") + r""" AS section, """ + is_deep("url") + r""" AS is_deep, row_number() OVER (PARTITION BY site ORDER BY at_root DESC, type_rank, url, page_id) AS page_ord FROM (
  SELECT u.page_id, u.url, u.site, u.at_root, """ + page_type_rank("u.url") + r""" AS type_rank FROM (
    SELECT u.page_id, u.url, s.scope AS site, CASE WHEN regexp_replace(u.url, r'/+$', '') = s.prefix THEN 1 ELSE 0 END AS at_root, row_number() OVER (PARTITION BY u.url ORDER BY length(s.prefix) DESC, s.scope, u.page_id) AS longest
    FROM {page_urls} u JOIN {region_scopes} s ON u.$site$ = s.site AND (startswith(u.url, s.prefix || '/') OR u.url = s.prefix) WHERE NOT u.is_asset) u LEFT JOIN {not_html} n ON u.url = n.url WHERE u.longest = 1 AND n.url IS NULL)
""")
relation("region_robots", "SELECT s.scope AS site, r.body FROM {region_scopes} s JOIN {robots} r ON s.site = r.site")
relation("region_sitemaps", "SELECT s.scope AS site, m.url, m.body FROM {region_scopes} s JOIN {sitemaps} m ON s.site = m.site")
relation("region_runs", "SELECT s.scope AS site FROM {region_scopes} s JOIN {external_runs} x ON s.site = x.site")
relation("region_wanted", "SELECT scope AS site FROM {region_scopes} WHERE scope = ''")  # what was not crawled is no region

scoped(["site_scores", "citation_scores", "severity_counts"], "rg_", {"page_sample": "region_sample", "robots": "region_robots", "sitemaps": "region_sitemaps", "external_runs": "region_runs", "targets": "region_wanted"})

relation("region_scores", r"""
SELECT r.site, r.url, r.region, r.is_primary, s.value AS score, s.grade, cast(bround(s.discoverability, 0) AS bigint) AS discoverability, cast(bround(s.engagement, 0) AS bigint) AS engagement, s.citation, coalesce(s.total, 0) AS findings
FROM (SELECT site, home_url AS url, 'Primary' AS region, site AS audited, true AS is_primary FROM {site_totals} WHERE site IN (SELECT site FROM {region_variants})
      UNION ALL SELECT site, variant, label, audited, false FROM {scored_targets}) r
JOIN (SELECT s.site, s.value, s.grade, s.discoverability, s.engagement, c.score AS citation, f.total FROM {site_scores} s LEFT JOIN {citation_scores} c ON s.site = c.site LEFT JOIN {severity_counts} f ON s.site = f.site
      UNION ALL SELECT s.site, s.value, s.grade, s.discoverability, s.engagement, c.score, f.total FROM {rg_site_scores} s LEFT JOIN {rg_citation_scores} c ON s.site = c.site LEFT JOIN {rg_severity_counts} f ON s.site = f.site) s ON r.audited = s.site
""")
