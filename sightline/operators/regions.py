"""Region variants and external evidence (survey I1-I4, X1e-X6e)."""

from sightline.functions.urls import bare_host, domain, domain_of, locale
from sightline.operators.checks import PROFILE_SITES, values
from sightline.plans.relations import relation

#: Country codes and names (fixed values).
COUNTRIES = [
    ("in", "India"), ("gb", "United Kingdom"), ("uk", "United Kingdom"), ("us", "United States"),
    ("ca", "Canada"), ("au", "Australia"), ("nz", "New Zealand"), ("ie", "Ireland"), ("sg", "Singapore"),
    ("ae", "UAE"), ("sa", "Saudi Arabia"), ("za", "South Africa"), ("de", "Germany"), ("fr", "France"),
    ("es", "Spain"), ("it", "Italy"), ("nl", "Netherlands"), ("se", "Sweden"), ("ch", "Switzerland"),
    ("be", "Belgium"), ("at", "Austria"), ("pt", "Portugal"), ("br", "Brazil"), ("mx", "Mexico"),
    ("ar", "Argentina"), ("jp", "Japan"), ("cn", "China"), ("hk", "Hong Kong"), ("tw", "Taiwan"),
    ("kr", "South Korea"), ("ru", "Russia"), ("pl", "Poland"), ("tr", "Turkey"), ("id", "Indonesia"),
    ("my", "Malaysia"), ("ph", "Philippines"), ("th", "Thailand"), ("vn", "Vietnam"), ("bd", "Bangladesh"),
    ("pk", "Pakistan"), ("lk", "Sri Lanka"), ("ng", "Nigeria"), ("eg", "Egypt"), ("il", "Israel"),
]
relation("countries", values(COUNTRIES, "code, name"))


def variants(kept: str = "", also: str = "") -> str:
    """The variants of a site: those `kept` of its codes, with the columns `also` says; without it all of them."""
    return r"""
SELECT v.site, v.variant, v.code, v.via, v.region,""" + also + r""" coalesce(s.status, 0) AS status, coalesce(s.status IN (404, 410) OR s.status >= 500 AND s.status < 600, false) AS is_dead,
       CASE WHEN v.code = 'x-default' THEN 'Global' WHEN c.name IS NOT NULL THEN c.name ELSE v.code END AS label, p.url IS NOT NULL AS in_sample
FROM (SELECT site, variant, code, via,""" + (also and " k,") + r""" CASE WHEN code = 'x-default' THEN '' ELSE regexp_extract(code, r'[-_]([a-z]{2})$', 1) END AS region FROM (
        SELECT site, code, via, variant, row_number() OVER (PARTITION BY site, via ORDER BY code) AS k FROM (
          SELECT site, lower(code) AS code, 'hreflang' AS via, min(target) AS variant FROM {page_hreflang} WHERE target IS NOT NULL GROUP BY site, lower(code)
          UNION ALL
          SELECT l.site, l.code, 'path', min_by(l.target, l.page_ord * 10000 + l.pos) FROM (SELECT site, page_ord, pos, target, """ + locale("target") + r""" AS code FROM {page_links} WHERE is_internal AND target IS NOT NULL) l
          LEFT JOIN (SELECT DISTINCT site FROM {page_hreflang}) h ON l.site = h.site WHERE h.site IS NULL AND l.code <> '' GROUP BY l.site, l.code))""" + kept + r""") v
LEFT JOIN {link_status} s ON v.variant = s.url LEFT JOIN {countries} c ON v.region = c.code LEFT JOIN {site_pages} p ON v.variant = p.url
"""


def places(of: str, first: str = "") -> str:
    return r"""
SELECT site, variant, code, label, is_dead, row_number() OVER (PARTITION BY site ORDER BY """ + first + r"""CASE WHEN code = 'x-default' THEN 0 ELSE 1 END, region, variant, code) AS place FROM {""" + of + r"""}
"""


relation("region_variants", variants(" WHERE via = 'hreflang' OR k <= 40"))
# the default first, then by region and address (I4)
relation("region_places", places("region_variants"))
# None is left out here. Paths that region_variants has no room for come after its own, so that the places of these are the same in both.
relation("all_variants", variants(also=" v.via = 'path' AND v.k > 40 AS is_late,"))
relation("all_places", places("all_variants", "CASE WHEN is_late THEN 1 ELSE 0 END, "))
relation("region_summary", r"""
SELECT site, count(*) AS n_variants, count_if(is_dead) AS n_dead, count_if(in_sample) AS n_sampled, count_if(via = 'hreflang') >= 2 AS is_cluster, printf('%d region variant(s), %d unreachable', count(*), count_if(is_dead)) AS note FROM {region_variants} GROUP BY site
""")

relation("profile_urls", r"""
SELECT site, profile FROM (SELECT site, profile, row_number() OVER (PARTITION BY site ORDER BY first_seen, profile) AS k FROM (
  SELECT site, profile, min(o) AS first_seen FROM (
    SELECT site, page_ord * 100000 AS o, explode(CASE WHEN startswith(s, '[') THEN from_json(s, 'array<string>') ELSE array(s) END) AS profile FROM (SELECT site, page_ord, get_json_object(node, '$.sameAs') AS s FROM {page_jsonld}) WHERE s IS NOT NULL
    UNION ALL SELECT site, page_ord * 100000 + 50000 + pos, href FROM {page_links} WHERE startswith(href, 'http') AND regexp_like(href, r'""" + PROFILE_SITES + r"""'))
  GROUP BY site, profile)) WHERE k <= 8
""", stored=True)
#: Hosts that are not public: names without a dot or of local use, and private, loopback and link-local addresses.
PRIVATE = r"(?i)^[a-z]+://(?:[^/?#]*@)?(?:[^./?#:]+|[^/?#:]*\.(?:local|internal|localhost)|127\.[0-9.]+|10\.[0-9.]+|192\.168\.[0-9.]+|169\.254\.[0-9.]+|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9.]+|0\.0\.0\.0|\[[^\]]*\])(?:[:/?#]|$)"
relation("profile_states", r"""
SELECT u.site, u.profile, CASE WHEN regexp_like(u.profile, r'""" + PRIVATE + r"""') THEN 'skipped' WHEN s.url IS NULL THEN 'unavailable' WHEN s.status BETWEEN 200 AND 399 OR s.status IN (403, 429, 999) THEN 'verified' ELSE 'unreachable' END AS state
FROM {profile_urls} u LEFT JOIN {link_status} s ON u.profile = s.url
""")
#: The first label of a host; the mark of a region (see region_audits) is none.
LABEL = r"regexp_extract({}, r'^(?:~[0-9]+\.)?([^.]*)', 1)"
relation("brand_names", r"""
SELECT t.site, coalesce(nullif(h.site_name, ''), nullif(n.name, ''), upper(left(""" + LABEL.format('t.site') + r""", 1)) || substring(""" + LABEL.format('t.site') + r""", 2)) AS brand
FROM {site_totals} t JOIN (SELECT site, trim(site_name) AS site_name FROM {page_facts} WHERE is_home) h ON t.site = h.site
LEFT JOIN (SELECT site, min_by(trim(get_json_object(node, '$.name')), page_ord * 1000 + node_ord) AS name FROM {page_jsonld} WHERE first_type IN ('organization', 'website', 'localbusiness') AND coalesce(get_json_object(node, '$.name'), '') <> '' GROUP BY site) n ON t.site = n.site
""", kept=True)
# what a brand may be looked up by: its name, the name without an ending like .org, the first label of the host
relation("brand_candidates", r"""
SELECT site, name, row_number() OVER (PARTITION BY site ORDER BY ord) AS place FROM (SELECT site, lower(name) AS name, min(ord) AS ord FROM (
  SELECT site, brand AS name, 1 AS ord FROM {brand_names} UNION ALL SELECT site, trim(regexp_replace(brand, r'\.\w{2,}$', '')), 2 FROM {brand_names} UNION ALL SELECT site, """ + LABEL.format('site') + r""", 3 FROM {brand_names})
  WHERE name <> '' GROUP BY site, lower(name))
""")
ENTITY_MATCHES = r"""
SELECT site, min_by(entity_id, CASE WHEN is_own THEN 0 ELSE 1000000 END + k) AS entity_id, bool_or(is_own) AS links_back
FROM (SELECT c.site, e.entity_id, coalesce(""" + domain("e.official_website") + " = " + domain_of("c.site") + r""", false) AS is_own, row_number() OVER (PARTITION BY c.site ORDER BY c.place, e.hit_rank, e.entity_id) AS k
      FROM {brand_candidates} c JOIN {entities} e ON c.name = lower(e.label) WHERE e.hit_rank <= 5 AND c.place <= 3) WHERE k <= 8 GROUP BY site
"""
# Of the entities of one label, a site can only come to the first eight: in Spark, the others are left out before the join, where many sites of one name would meet all of them.
relation("entity_matches", ENTITY_MATCHES, spark=ENTITY_MATCHES.replace("c.name = lower(e.label) WHERE e.hit_rank <= 5 AND", "c.name = e.name WHERE").replace(domain("e.official_website"), "e.own_domain").replace("{entities}", r"""(
        SELECT name, entity_id, hit_rank, """ + domain("official_website") + r""" AS own_domain FROM (
          SELECT lower(label) AS name, entity_id, official_website, hit_rank, row_number() OVER (PARTITION BY lower(label) ORDER BY hit_rank, entity_id) AS nth FROM {entities} WHERE hit_rank <= 5) WHERE nth <= 8)"""))
# Outside evidence counts only for the sites that it was gathered for (external_runs); what was not looked at is unavailable, not absent.
relation("external_evidence", r"""
SELECT t.site, x.site IS NOT NULL AS performed, e.entity_id, CASE WHEN x.site IS NULL THEN 'unavailable' WHEN e.entity_id IS NULL THEN 'absent' ELSE 'present' END AS entity, coalesce(e.links_back, false) AS links_back, coalesce(p.n_ok, 0) AS n_ok, coalesce(p.n_bad, 0) AS n_bad, coalesce(p.n_skipped, 0) AS n_skipped,
       CASE WHEN c.records IS NULL THEN 'unavailable' WHEN c.records > 0 THEN 'present' ELSE 'absent' END AS corpus, CASE WHEN x.site IS NOT NULL THEN coalesce(e.links_back, false) OR coalesce(p.n_ok, 0) > 0 END AS verified
FROM {site_totals} t LEFT JOIN {external_runs} x ON t.site = x.site LEFT JOIN {entity_matches} e ON t.site = e.site
LEFT JOIN (SELECT site, count_if(state = 'verified') AS n_ok, count_if(state = 'unreachable') AS n_bad, count_if(state = 'skipped') AS n_skipped FROM {profile_states} GROUP BY site) p ON t.site = p.site LEFT JOIN {corpus_index} c ON """ + domain_of("t.site") + r""" = c.domain
""", kept=True)
relation("external_hits", r"""
SELECT site, 'X1e' AS check_id, cast(1 AS bigint) AS n FROM {external_evidence} WHERE performed AND entity = 'present' AND NOT links_back
UNION ALL SELECT site, 'X2e', cast(1 AS bigint) FROM {external_evidence} WHERE performed AND entity = 'absent'
UNION ALL SELECT site, 'X3e', n_bad FROM {external_evidence} WHERE performed AND n_bad > 0
UNION ALL SELECT site, 'X4e', cast(1 AS bigint) FROM {external_evidence} WHERE performed AND corpus = 'absent'
""")
relation("region_notes", r"""
SELECT a.site, CASE WHEN w.n < 2 THEN 'Each region was audited.' WHEN w.score >= a.score THEN printf('%s scores highest; the other regions keep up.', a.region)
       ELSE printf('%s (%d of 100, %s) trails %s (%d of 100) by %d point(s), most in %s.', w.region, w.score, w.grade, a.region, a.score, a.score - w.score, CASE WHEN w.discoverability <= w.citation AND w.discoverability <= w.engagement THEN 'discoverability' WHEN w.citation <= w.engagement THEN 'citation' ELSE 'engagement' END) END AS note
FROM (SELECT site, region, score FROM {region_scores} WHERE is_primary) a
JOIN (SELECT site, region, score, grade, discoverability, engagement, citation, n FROM (SELECT site, region, score, grade, discoverability, engagement, coalesce(citation, 0) AS citation, row_number() OVER (PARTITION BY site ORDER BY score, is_primary DESC, url) AS k, count(*) OVER (PARTITION BY site) AS n FROM {region_scores}) WHERE k = 1) w ON a.site = w.site
""")
