"""Findings, scores, priorities and the analyst tables made from them (survey A1-A14, A28-A30, W1-W18, P1-P10)."""

from sightline.operators.checks import values
from sightline.plans.relations import relation

#: Points per severity, factors per confidence, impact, ranks (fixed values).
SEVERITIES = [("critical", 35, 5, 0), ("high", 18, 4, 1), ("medium", 8, 3, 2), ("low", 3, 2, 3), ("info", 1, 1, 4)]
CONFIDENCES = [("high", 1.0, 0), ("medium", 0.75, 1), ("low", 0.5, 2)]
#: category, pillar, effort, fixed by a template, coverage area, gate, default reason (fixed values but for the wording).
CATEGORIES = [
    ("crawlability", "crawl_render", 2, 1, "crawlability", "reach", "A page that crawlers may not fetch cannot be cited."),
    ("indexability", "crawl_render", 1, 1, "crawlability", "reach", "A page kept out of indexes stays out of answers."),
    ("reachability", "crawl_render", 3, 0, "crawlability", "reach", "Pages that fail to load are dropped."),
    ("js-render-gap", "crawl_render", 5, 0, "rendering", "read", "Readers without JavaScript miss what scripts add."),
    ("structured-data", "structured_data", 3, 0, "structured_data", "quote", "Without markup, facts are guessed from prose."),
    ("entity-identity", "structured_data", 2, 0, "entity_identity", "quote", "Without one identity, facts cannot be attributed."),
    ("extractability", "extractability", 2, 1, "extractability", "read", "A fact that is not text cannot be quoted."),
    ("freshness", "freshness", 2, 0, "freshness", "trust", "Content that looks old is trusted less."),
    ("corroboration", "corroboration", 4, 0, "corroboration", "trust", "A claim found in one place only is fragile."),
    ("mobile", "engagement", 3, 1, "engagement", "", "Phones show a page that cannot be read."),
    ("conversion", "engagement", 2, 0, "engagement", "", "Without a next step, visitors leave."),
    ("orientation", "engagement", 2, 1, "engagement", "", "Lost visitors leave."),
    ("performance", "engagement", 4, 0, "engagement", "", "Slow pages lose visitors."),
    ("readability", "engagement", 2, 0, "engagement", "", "Walls of text go unread."),
    ("accessibility", "", 3, 1, "engagement", "", "Some visitors cannot use the page."),
    ("i18n", "", 3, 0, "", "", "Visitors are sent to a page that is not there."),
    ("trust-signals", "", 3, 0, "", "", "Boasts that nobody confirms lower trust."),
]
PILLARS = [("crawl_render", "Crawl & Render", 1), ("structured_data", "Structured Data", 2), ("extractability", "Extractability", 3), ("freshness", "Freshness", 4), ("corroboration", "Corroboration", 5), ("engagement", "Engagement", 6)]
GATES = [("reach", "Reach", 1), ("read", "Read", 2), ("quote", "Quote", 3), ("trust", "Trust", 4)]
AREAS = [("crawlability", "Crawlability", 1), ("rendering", "Rendering", 2), ("structured_data", "Structured Data", 3), ("extractability", "Extractability", 4), ("entity_identity", "Entity Identity", 5), ("freshness", "Freshness", 6), ("corroboration", "Corroboration", 7), ("engagement", "Engagement", 8)]
#: area, named check, how it is verified, the rules that fail it (fixed values).
NAMED_CHECKS = [
    ("crawlability", "robots_ai", "static", "C1 C3"), ("crawlability", "robots_pages", "static", "C4"), ("crawlability", "reachability", "static", "C5"), ("crawlability", "sitemap", "static", "C16"), ("crawlability", "canonical", "static", "C7"),
    ("crawlability", "hreflang", "static", "C8 C9 C10"), ("crawlability", "internal_links", "static", "C12"), ("crawlability", "nofollow", "static", "C11"), ("rendering", "ssr_content", "static", "C13 C14"), ("rendering", "noscript_notice", "static", "C15"),
    ("rendering", "rendered_dom", "browser", ""), ("structured_data", "present", "static", "D1"), ("structured_data", "valid", "static", "D2"), ("structured_data", "complete", "static", "D6 D7"), ("structured_data", "product", "static", "D4"),
    ("structured_data", "article", "static", "D5"), ("extractability", "title", "static", "E1"), ("extractability", "title_quality", "static", "E4"), ("extractability", "meta_desc", "static", "E2"), ("extractability", "h1", "static", "E6 E7"),
    ("extractability", "hierarchy", "static", "E8"), ("extractability", "alt", "static", "E9 E10"), ("extractability", "lang", "static", "E11"), ("entity_identity", "homepage_identity", "static", "D3"), ("entity_identity", "name_consistency", "static", "R3 R4 D8"),
    ("freshness", "dated", "static", "F3"), ("freshness", "current", "static", "F1 F2"), ("corroboration", "sameas", "static", "R1"), ("corroboration", "external_presence", "static", "R2"), ("corroboration", "external_verification", "external", ""),
    ("engagement", "mobile", "static", "G1"), ("engagement", "cta", "static", "G2"), ("engagement", "navigation", "static", "G3 G4"), ("engagement", "performance", "static", "G5 G6 G7"), ("engagement", "readability", "static", "G8"),
    ("engagement", "orientation", "static", "G9"), ("engagement", "accessibility", "static", "G12 G13 G14"), ("engagement", "barriers", "static", "G10 G11"),
]
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D"), (0, "F")]


def grade(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {cut} THEN '{g}'" for cut, g in GRADES[:-1]) + " ELSE 'F' END"


def band(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'healthy' WHEN {x} >= 70 THEN 'warning' ELSE 'critical' END"


def clamped(x: str) -> str:
    return f"greatest(0.0, least(100.0, bround(100 - coalesce({x}, 0), 1)))"


relation("severities", values(SEVERITIES, "severity, points, impact, sev_rank"))
relation("confidences", values(CONFIDENCES, "confidence, factor, conf_rank"))
relation("categories", values(CATEGORIES, "category, pillar, effort, by_template, area, gate, reason"))
relation("pillars", values(PILLARS, "pillar, label, ord"))
relation("gates", values(GATES, "gate, label, ord"))
relation("areas", values(AREAS, "area, label, ord"))
relation("named_checks", values([(a, c, k, r) for a, c, k, rules in NAMED_CHECKS for r in (rules.split() or [""])], "area, named, kind, check_id"))

# findings of equal dimension, category and title are one: the strongest stays, the pages of all are merged (A28)
relation("raw_findings", r"""
SELECT h.site, c.check_id, c.title, c.severity, c.dimension, c.category, c.confidence, h.n, least(h.n_affected, 10) AS n_affected, h.example, h.affected, cast(s.points AS double) * cast(f.factor AS double) AS penalty, s.impact AS base_impact, s.sev_rank, f.conf_rank,
       lower(trim(c.category)) AS same_category, regexp_replace(lower(trim(c.title)), r'\s+', ' ', /*all*/ 1) AS same_title
FROM {check_hits} h JOIN {check_catalog} c ON h.check_id = c.check_id JOIN {severities} s ON c.severity = s.severity JOIN {confidences} f ON c.confidence = f.confidence
""")
relation("ranked_findings", r"""
SELECT *, row_number() OVER (PARTITION BY site, dimension, same_category, same_title ORDER BY sev_rank, conf_rank, check_id) AS same, count(*) OVER (PARTITION BY site, dimension, same_category, same_title) AS n_same FROM {raw_findings}
""")
relation("merged_pages", r"""
SELECT site, dimension, same_category, same_title, count(*) AS n_affected, listagg(page, ' | ') WITHIN GROUP (ORDER BY place) AS affected
FROM (SELECT *, row_number() OVER (PARTITION BY site, dimension, same_category, same_title ORDER BY first) AS place FROM (
  SELECT site, dimension, same_category, same_title, page, min(same * 1000 + pos) AS first
  FROM (SELECT site, dimension, same_category, same_title, same, posexplode(pages) AS (pos, page) FROM (SELECT site, dimension, same_category, same_title, same, split(affected, r' \| ') AS pages FROM {ranked_findings} WHERE n_same > 1 AND affected IS NOT NULL))
  GROUP BY site, dimension, same_category, same_title, page))
WHERE place <= 20 GROUP BY site, dimension, same_category, same_title
""", stored=True)
relation("findings", r"""
SELECT r.*, 'F-' || lpad(cast(priority AS string), 3, '0') AS id FROM (
  SELECT r.site, r.check_id, r.title, r.severity, r.dimension, r.category, r.confidence, r.n, r.n_affected, r.example, r.affected, r.penalty, r.sev_rank, CASE WHEN r.confidence = 'low' AND r.base_impact > 1 THEN r.base_impact - 1 ELSE r.base_impact END AS impact,
         row_number() OVER (PARTITION BY r.site ORDER BY r.penalty DESC, r.dimension, lower(r.title), r.check_id) AS priority, coalesce(k.reason, CASE r.dimension WHEN 'engagement' THEN 'Visitors who are put off leave.' ELSE 'What cannot be found and read cannot be cited.' END) AS reason,
         CASE WHEN t.n_pages IS NOT NULL THEN printf('%d of %d page(s) (%d%%)', r.n_affected, t.n_pages, cast(bround(100.0 * r.n_affected / t.n_pages, 0) AS bigint)) END AS scope
  FROM (SELECT f.site, f.check_id, f.title, f.severity, f.dimension, f.category, f.confidence, f.n, coalesce(m.n_affected, f.n_affected) AS n_affected, f.example, coalesce(m.affected, f.affected) AS affected, f.penalty, f.base_impact, f.sev_rank
        FROM {ranked_findings} f LEFT JOIN {merged_pages} m ON f.site = m.site AND f.dimension = m.dimension AND f.same_category = m.same_category AND f.same_title = m.same_title WHERE f.same = 1) r
  LEFT JOIN {categories} k ON r.category = k.category LEFT JOIN {site_totals} t ON r.site = t.site) r
""", stored=True)

relation("dimension_penalties", r"""SELECT site, coalesce(sum(CASE WHEN dimension = 'discoverability' THEN penalty END), 0.0) AS disc, coalesce(sum(CASE WHEN dimension = 'engagement' THEN penalty END), 0.0) AS eng FROM {findings} GROUP BY site""")
SCORE = lambda d, e: f"cast(bround({clamped(d)} * 0.6 + {clamped(e)} * 0.4, 0) AS bigint)"
relation("site_scores", f"""
SELECT site, discoverability, engagement, value, {grade('value')} AS grade, n_pages, n_pages <= 2 AS provisional FROM (
  SELECT t.site, {clamped('p.disc')} AS discoverability, {clamped('p.eng')} AS engagement, {SCORE('p.disc', 'p.eng')} AS value, t.n_pages FROM {{site_totals}} t LEFT JOIN {{dimension_penalties}} p ON t.site = p.site)
""", kept=True)
relation("severity_counts", r"""
SELECT site, count(*) AS total, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, count_if(dimension = 'discoverability') AS discoverability, count_if(dimension = 'engagement') AS engagement FROM {findings} GROUP BY site
""")
relation("score_every_site", r"""SELECT s.*, coalesce(c.total, 0) AS total, coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high, coalesce(c.medium, 0) AS medium, coalesce(c.low, 0) AS low FROM {site_scores} s LEFT JOIN {severity_counts} c ON s.site = c.site""")

relation("matrix", f"""
SELECT site, id, check_id, title, severity, dimension, category, confidence, priority, impact, effort, CASE WHEN effort <= 2 THEN 'Low' WHEN effort = 3 THEN 'Medium' ELSE 'High' END AS effort_label, n_affected, affected, penalty,
       CASE WHEN impact >= 3 AND effort <= 2 THEN 'quick_win' WHEN impact >= 3 THEN 'major_project' WHEN effort <= 2 THEN 'fill_in' ELSE 'low_priority' END AS quadrant, greatest(0, without - value) AS points_at_stake
FROM (SELECT f.*, s.value, CASE WHEN c.by_template = 0 AND f.n_affected >= 5 THEN least(5, c.effort + 1) ELSE c.effort END AS effort,
             {SCORE("d.disc - CASE WHEN f.dimension = 'discoverability' THEN f.penalty ELSE 0 END", "d.eng - CASE WHEN f.dimension = 'engagement' THEN f.penalty ELSE 0 END")} AS without
      FROM {{findings}} f JOIN {{categories}} c ON f.category = c.category JOIN {{dimension_penalties}} d ON f.site = d.site JOIN {{site_scores}} s ON f.site = s.site)
""", kept=True)
relation("quick_wins", r"""SELECT site, id, title, points_at_stake, impact, effort, row_number() OVER (PARTITION BY site ORDER BY points_at_stake DESC, impact DESC, effort, priority) AS place FROM {matrix} WHERE quadrant = 'quick_win'""")
relation("quadrant_counts", r"""SELECT site, count_if(quadrant = 'quick_win') AS quick_win, count_if(quadrant = 'major_project') AS major_project, count_if(quadrant = 'fill_in') AS fill_in, count_if(quadrant = 'low_priority') AS low_priority FROM {matrix} GROUP BY site""")
relation("projection", f"""
SELECT site, current, current_grade, after_quick_wins, {grade('after_quick_wins')} AS after_quick_wins_grade, greatest(0, after_quick_wins - current) AS quick_win_gain, cast(100 AS bigint) AS after_all_fixed, 100 - current AS headroom, at_least, at_least - current AS points_to_next, coalesce(after_quick_wins >= at_least, false) AS quick_wins_reach_next_grade
FROM (SELECT s.site, s.value AS current, s.grade AS current_grade, CASE WHEN s.value >= 90 THEN NULL WHEN s.value >= 80 THEN 90 WHEN s.value >= 70 THEN 80 WHEN s.value >= 60 THEN 70 ELSE 60 END AS at_least, {SCORE('q.disc', 'q.eng')} AS after_quick_wins
  FROM {{site_scores}} s LEFT JOIN (SELECT site, sum(CASE WHEN dimension = 'discoverability' THEN penalty END) AS disc, sum(CASE WHEN dimension = 'engagement' THEN penalty END) AS eng FROM {{matrix}} WHERE quadrant <> 'quick_win' GROUP BY site) q ON s.site = q.site)
""", kept=True)
relation("scenario_scores", f"""
SELECT s.site, s.value AS current, {SCORE('q.disc', 'q.eng')} AS if_fixed FROM {{site_scores}} s LEFT JOIN (
  SELECT f.site, sum(CASE WHEN f.dimension = 'discoverability' THEN f.penalty END) AS disc, sum(CASE WHEN f.dimension = 'engagement' THEN f.penalty END) AS eng
  FROM {{findings}} f LEFT JOIN {{scenario}} x ON f.site = x.site AND f.id = x.id WHERE x.id IS NULL GROUP BY f.site) q ON s.site = q.site
""")
relation("scenario", "SELECT site, id FROM {findings} WHERE priority % 2 = 1")  # stands in for a user's choice
relation("distribution", r"""
SELECT site, field, key, n, cast(bround(100.0 * n / sum(n) OVER (PARTITION BY site, field), 0) AS bigint) AS pct FROM (
  SELECT site, CASE WHEN severity IS NOT NULL THEN 'severity' WHEN confidence IS NOT NULL THEN 'confidence' WHEN dimension IS NOT NULL THEN 'dimension' ELSE 'category' END AS field, coalesce(severity, confidence, dimension, category) AS key, n
  FROM (SELECT site, severity, confidence, dimension, category, count(*) AS n FROM {findings} GROUP BY GROUPING SETS ((site, severity), (site, confidence), (site, dimension), (site, category))))
""")
relation("finding_pages", r"""
SELECT site, id, severity, sev_rank, dimension, confidence, penalty, impact, explode(CASE WHEN affected IS NULL THEN array(home_url) ELSE split(affected, r' \| ') END) AS url, affected IS NULL AS site_wide
FROM (SELECT f.*, t.home_url FROM {findings} f JOIN {site_totals} t ON f.site = t.site)
""", stored=True)
relation("hotspots", r"""
SELECT site, url, findings, impact, top_severity FROM (SELECT h.*, row_number() OVER (PARTITION BY site ORDER BY impact DESC, findings DESC, url) AS k FROM (
  SELECT site, url, count(*) AS findings, sum(impact) AS impact, min_by(severity, sev_rank) AS top_severity FROM {finding_pages} WHERE NOT site_wide GROUP BY site, url) h) WHERE k <= 8
""")
relation("roadmap", r"""
SELECT site, id, title, bucket, row_number() OVER (PARTITION BY site, bucket ORDER BY priority) AS place, row_number() OVER (PARTITION BY site ORDER BY bucket_ord, priority) AS step
FROM (SELECT *, CASE bucket WHEN 'now' THEN 1 WHEN 'next' THEN 2 ELSE 3 END AS bucket_ord FROM (SELECT *, CASE WHEN severity IN ('critical', 'high') OR quadrant = 'quick_win' THEN 'now' WHEN severity = 'medium' THEN 'next' ELSE 'later' END AS bucket FROM {matrix}))
""")
relation("coverage_checks", r"""
SELECT t.site, n.area, n.named, CASE WHEN n.area = 'freshness' AND t.n_dated = 0 AND coalesce(a.n, 0) = 0 THEN 'not_verified' WHEN n.hit THEN 'fail' WHEN n.kind = 'browser' THEN 'not_verified' WHEN n.kind = 'external' THEN CASE WHEN e.verified THEN 'pass' WHEN NOT e.verified THEN 'fail' ELSE 'partial' END ELSE 'pass' END AS state
FROM (SELECT s.site, n.area, n.named, n.kind, bool_or(f.check_id IS NOT NULL) AS hit FROM (SELECT site, area, named, kind, check_id FROM {site_named_checks}) n JOIN {site_totals} s ON n.site = s.site LEFT JOIN {findings} f ON n.site = f.site AND n.check_id = f.check_id GROUP BY s.site, n.area, n.named, n.kind) n
JOIN {site_totals} t ON n.site = t.site JOIN {external_evidence} e ON t.site = e.site LEFT JOIN {area_findings} a ON n.site = a.site AND n.area = a.area
""")
ALL_CHECKS = ", ".join(f"'{a}|{c}|{k}|{r}'" for a, c, k, rules in NAMED_CHECKS for r in (rules.split() or [""]))
relation("site_named_checks", r"""SELECT site, try_element_at(p, 1) AS area, try_element_at(p, 2) AS named, try_element_at(p, 3) AS kind, try_element_at(p, 4) AS check_id FROM (SELECT site, split(x, r'\|') AS p FROM (SELECT site, explode(array(""" + ALL_CHECKS + r""")) AS x FROM {site_totals}))""", stored=True)
relation("area_findings", r"""SELECT f.site, c.area, count(*) AS n, max(CASE f.confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS weakest FROM {findings} f JOIN {categories} c ON f.category = c.category WHERE c.area <> '' GROUP BY f.site, c.area""")
relation("area_coverage", r"""
SELECT c.site, c.area, a.label, CASE WHEN c.not_assessed THEN 'not_assessed' WHEN n > 0 THEN 'issues' WHEN n_open + n_partial > 0 THEN 'partial' ELSE 'healthy' END AS status, checks_total, passed, failed, n_open, n_partial, n AS findings,
       CASE WHEN n > 0 THEN CASE weakest WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END WHEN n_open + n_partial > 0 THEN 'medium' ELSE 'high' END AS confidence
FROM (SELECT k.site, k.area, count(*) AS checks_total, count_if(k.state = 'pass') AS passed, count_if(k.state = 'fail') AS failed, count_if(k.state = 'not_verified') AS n_open, count_if(k.state = 'partial') AS n_partial, max(coalesce(f.n, 0)) AS n, max(f.weakest) AS weakest, k.area = 'freshness' AND bool_and(k.state = 'not_verified') AS not_assessed
      FROM {coverage_checks} k LEFT JOIN {area_findings} f ON k.site = f.site AND k.area = f.area GROUP BY k.site, k.area) c JOIN {areas} a ON c.area = a.area
""", kept=True)
# the areas, and a row for what could be done beyond mending (A13)
relation("coverage", r"""
SELECT * FROM {area_coverage}
UNION ALL SELECT t.site, 'proactive', 'Proactive Opportunities', CASE WHEN o.n IS NULL THEN 'healthy' ELSE 'opportunities' END, cast(0 AS bigint), cast(0 AS bigint), cast(0 AS bigint), cast(0 AS bigint), cast(0 AS bigint), coalesce(o.n, 0), 'medium'
FROM {site_totals} t LEFT JOIN (SELECT site, count(*) AS n FROM {opportunities} GROUP BY site) o ON t.site = o.site
""")
relation("coverage_summary", r"""
SELECT c.site, count(*) AS areas_total, count_if(status IN ('healthy', 'issues')) AS areas_fully_assessed, count_if(status = 'partial') AS areas_partial, count_if(status = 'not_assessed') AS areas_not_assessed, count_if(status <> 'not_assessed') AS areas_assessed, max(t.n_pages) AS pages_crawled
FROM {area_coverage} c JOIN {site_totals} t ON c.site = t.site GROUP BY c.site
""")
PILLAR_AREAS = "crawl_render:crawlability crawl_render:rendering structured_data:structured_data structured_data:entity_identity extractability:extractability freshness:freshness corroboration:corroboration engagement:engagement"
relation("pillar_areas", values([tuple(x.split(":")) for x in PILLAR_AREAS.split()], "pillar, area"))
relation("pillar_scores", f"""
SELECT a.site, a.pillar, p.label, p.ord, coalesce(f.n, 0) AS findings, {clamped('f.penalty')} AS score, CASE WHEN f.n > 0 THEN {band(clamped('f.penalty'))} WHEN a.none THEN 'not_assessed' WHEN a.some THEN 'partial' ELSE 'healthy' END AS status
FROM (SELECT c.site, m.pillar, bool_and(c.status = 'not_assessed') AS none, bool_or(c.status IN ('not_assessed', 'partial')) AS some FROM {{area_coverage}} c JOIN {{pillar_areas}} m ON c.area = m.area GROUP BY c.site, m.pillar) a
JOIN {{pillars}} p ON a.pillar = p.pillar LEFT JOIN (SELECT f.site, c.pillar, count(*) AS n, sum(f.penalty) AS penalty FROM {{findings}} f JOIN {{categories}} c ON f.category = c.category GROUP BY f.site, c.pillar) f ON a.site = f.site AND a.pillar = f.pillar
""", kept=True)
relation("funnel", f"""
SELECT site, gate, label, ord, n AS findings, score, {band('score')} AS status, rank_ = 1 AS is_weakest FROM (
  SELECT g.*, row_number() OVER (PARTITION BY site ORDER BY score, ord) AS rank_ FROM (
    SELECT t.site, t.gate, g.label, g.ord, coalesce(f.n, 0) AS n, {clamped('f.penalty')} AS score
    FROM (SELECT site, explode(array('reach', 'read', 'quote', 'trust')) AS gate FROM {{site_totals}}) t JOIN {{gates}} g ON t.gate = g.gate
    LEFT JOIN (SELECT f.site, c.gate, count(*) AS n, sum(f.penalty) AS penalty FROM {{findings}} f JOIN {{categories}} c ON f.category = c.category WHERE f.dimension = 'discoverability' GROUP BY f.site, c.gate) f ON t.site = f.site AND t.gate = f.gate) g)
""", kept=True)
relation("funnel_notes", r"""
SELECT w.site, w.label AS weakest, w.score, coalesce(d.labels, '') AS downstream FROM {funnel} w LEFT JOIN (SELECT a.site, listagg(b.label, ', ') WITHIN GROUP (ORDER BY b.ord) AS labels FROM {funnel} a JOIN {funnel} b ON a.site = b.site AND b.ord > a.ord WHERE a.is_weakest GROUP BY a.site) d ON w.site = d.site WHERE w.is_weakest
""")
relation("kpis", r"""
SELECT s.site, s.value, s.grade, coalesce(c.total, 0) AS total, coalesce(c.critical + c.high, 0) AS critical_high, coalesce(q.quick_win, 0) AS quick_wins, p.after_quick_wins, p.quick_win_gain, m.effort, CASE WHEN coalesce(m.effort, 0) <= 4 THEN 'Small' WHEN m.effort <= 12 THEN 'Moderate' ELSE 'Substantial' END AS effort_band, w.weakest, w.strongest, v.assessed
FROM {site_scores} s LEFT JOIN {severity_counts} c ON s.site = c.site LEFT JOIN {quadrant_counts} q ON s.site = q.site JOIN {projection} p ON s.site = p.site LEFT JOIN (SELECT site, sum(effort) AS effort FROM {matrix} GROUP BY site) m ON s.site = m.site
LEFT JOIN (SELECT site, min_by(label, score * 10 + ord) AS weakest, max_by(label, score * 10 - ord) AS strongest FROM {pillar_scores} WHERE status <> 'not_assessed' GROUP BY site) w ON s.site = w.site
LEFT JOIN (SELECT site, count_if(status <> 'not_assessed') AS assessed FROM {area_coverage} GROUP BY site) v ON s.site = v.site
""", kept=True)
relation("page_records", r"""
SELECT p.site, p.url, p.page_ord, p.is_home, p.section, coalesce(f.n, 0) AS findings, cast(greatest(0.0, least(100.0, bround(100 - coalesce(f.penalty, 0), 0))) AS bigint) AS score, f.top_severity, coalesce(f.confidence, 'high') AS confidence, f.ids, length(trim(p.title)) AS title_len, p.n_h1, p.n_h2, p.n_internal, p.n_external, p.n_pdf,
       p.cta_text OR p.cta_href AS cta, p.n_images_no_alt, NOT (contains(lower(p.meta_robots), 'noindex') OR contains(lower(p.x_robots), 'noindex')) AS indexable, p.word_count, CASE WHEN p.word_count < 60 THEN 'high' WHEN p.word_count < 120 THEN 'medium' ELSE 'low' END AS render_risk,
       left(p.visible_text, 400) || CASE WHEN length(p.visible_text) > 400 THEN '…' ELSE '' END AS preview, row_number() OVER (PARTITION BY p.site ORDER BY p.page_ord <> 1, 100 - coalesce(f.penalty, 0), p.page_ord) AS place
FROM {page_facts} p LEFT JOIN (SELECT site, url, count(*) AS n, sum(penalty) AS penalty, min_by(severity, sev_rank) AS top_severity, CASE max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, listagg(id, ',') WITHIN GROUP (ORDER BY id) AS ids FROM {finding_pages} GROUP BY site, url) f ON p.site = f.site AND p.url = f.url
""")
relation("sections", r"""
SELECT site, section, pages, score, findings, top_severity FROM (
  SELECT p.site, p.section, p.pages, p.score, coalesce(f.n, 0) AS findings, f.top_severity, count(*) OVER (PARTITION BY p.site) AS n_sections
  FROM (SELECT site, section, count(*) AS pages, cast(bround(avg(score), 0) AS bigint) AS score FROM {page_records} GROUP BY site, section) p
  LEFT JOIN (SELECT g.site, p.section, count(DISTINCT g.id) AS n, min_by(g.severity, g.sev_rank) AS top_severity FROM {finding_pages} g JOIN {site_pages} p ON g.site = p.site AND g.url = p.url GROUP BY g.site, p.section) f ON p.site = f.site AND p.section = f.section)
WHERE n_sections >= 2
""")
#: note, pattern of a path (fixed values).
SECTION_NOTES = [
    ("About the organization", r"(?i)/(?:about|company|who-we-are)(?:/|$)"), ("Products", r"(?i)/(?:product|products|shop|store)(?:/|$)"), ("Services", r"(?i)/(?:service|services|solutions)(?:/|$)"),
    ("Pricing", r"(?i)/(?:pricing|plans)(?:/|$)"), ("Contact", r"(?i)/contact(?:/|$)"), ("Articles / blog", r"(?i)/(?:blog|articles|news)(?:/|$)"), ("Documentation / help", r"(?i)/(?:docs|documentation|help|support)(?:/|$)"), ("FAQ", r"(?i)/faq(?:/|$)"),
]
NOTE = "CASE WHEN is_home THEN 'Home' " + " ".join(f"WHEN regexp_like(url, r'{p}') THEN '{n}'" for n, p in SECTION_NOTES) + " END"
relation("key_pages", f"""
SELECT site, note, url, place FROM (SELECT site, note, url, row_number() OVER (PARTITION BY site ORDER BY page_ord) AS place FROM (SELECT site, note, min_by(url, page_ord) AS url, min(page_ord) AS page_ord FROM (SELECT site, url, page_ord, {NOTE} AS note FROM {{site_pages}}) WHERE note IS NOT NULL GROUP BY site, note)) WHERE place <= 8
""")
relation("llms_status", r"""
SELECT t.site, coalesce(r.status = 200 AND coalesce(r.raw_len, 0) > 0 AND (r.content_type = '' OR contains(lower(r.content_type), 'text') OR contains(lower(r.content_type), 'markdown')), false) AS present, r.status
FROM {site_totals} t LEFT JOIN {response_of} r ON r.url = 'https://' || t.site || '/llms.txt'
""")
relation("llms_text", r"""
SELECT site, listagg(line, chr(10)) WITHIN GROUP (ORDER BY ord) AS text FROM (
  SELECT site, 0 AS ord, '# ' || brand AS line FROM {brand_names}
  UNION ALL SELECT site, 1, chr(10) || '> ' || trim(description) FROM {page_facts} WHERE is_home AND trim(description) <> ''
  UNION ALL SELECT site, 2, chr(10) || '## Key pages' FROM {brand_names}
  UNION ALL SELECT site, 2 + place, '- [' || note || '](' || url || ')' FROM {key_pages}
  UNION ALL SELECT site, 20, chr(10) || '## Optional' FROM {brand_names}
  UNION ALL SELECT site, 21, '- [Sitemap](https://' || site || '/sitemap.xml)' FROM {brand_names}) GROUP BY site
""")
relation("report_violations", r"""
SELECT site, id, CASE WHEN title IS NULL OR title = '' THEN 'title missing' WHEN severity NOT IN ('critical', 'high', 'medium', 'low', 'info') THEN 'unknown severity' WHEN n IS NULL THEN 'no evidence' ELSE 'reason missing' END AS problem FROM {findings}
WHERE title IS NULL OR title = '' OR severity NOT IN ('critical', 'high', 'medium', 'low', 'info') OR n IS NULL OR reason IS NULL
""")
relation("scoring_model", r"""
SELECT 'severity' AS part, severity AS key, cast(points AS double) AS value FROM {severities} UNION ALL SELECT 'confidence', confidence, cast(factor AS double) FROM {confidences} UNION ALL SELECT 'weight', dimension, CASE dimension WHEN 'discoverability' THEN 0.6 ELSE 0.4 END FROM (SELECT DISTINCT dimension FROM {findings})
""")
relation("finding_search", r"""SELECT site, id, title, severity, priority, n_affected FROM {findings} WHERE dimension = 'discoverability' AND severity IN ('high', 'medium') AND confidence <> 'low' AND contains(lower(title), 'page')""")
relation("finding_facets", r"""
SELECT site, facet, value, count(*) AS n FROM (SELECT site, 'dimension' AS facet, dimension AS value FROM {findings} UNION ALL SELECT site, 'severity', severity FROM {findings} UNION ALL SELECT site, 'confidence', confidence FROM {findings} UNION ALL SELECT site, 'category', category FROM {findings}) GROUP BY site, facet, value
""")
relation("page_search", r"""SELECT r.site, r.url, r.score, r.findings FROM {page_records} r JOIN {page_signals} s ON r.site = s.site AND r.url = s.url WHERE contains(lower(r.url), 'product') OR contains(lower(s.title), 'story')""")
relation("top_findings", r"""SELECT site, id, title, points_at_stake FROM (SELECT site, id, title, points_at_stake, row_number() OVER (PARTITION BY site ORDER BY points_at_stake DESC, priority) AS k FROM {matrix}) WHERE k <= 6""")
# words are looked for in the catalog's titles, of which there are as many as rules; findings then join by title
relation("keyword_titles", r"""
SELECT t.title, t.category, w.area, w.named FROM {check_catalog} t JOIN {categories} c ON t.category = c.category JOIN {keywords} w ON c.area = w.area AND contains(lower(t.title), w.word)
""")
relation("keyword_matches", r"""SELECT f.site, f.check_id, w.area, w.named FROM {findings} f JOIN {keyword_titles} w ON f.title = w.title AND f.category = w.category""")
#: area, named check, words of a title that fail it (fixed values).
KEYWORDS = [
    ("crawlability", "robots_ai", "retrieval crawlers are blocked"), ("crawlability", "robots_ai", "disallows all crawlers"), ("crawlability", "robots_pages", "disallowed by robots"),
    ("crawlability", "reachability", "server errors"), ("crawlability", "sitemap", "no xml sitemap"), ("crawlability", "canonical", "canonical tags point"), ("crawlability", "hreflang", "hreflang"),
    ("crawlability", "internal_links", "broken internal links"), ("crawlability", "nofollow", "marked rel=nofollow"),
    ("rendering", "ssr_content", "require client-side javascript"), ("rendering", "ssr_content", "thin server-rendered"), ("rendering", "noscript_notice", "tell users to enable javascript"),
    ("structured_data", "present", "no structured data anywhere"), ("structured_data", "valid", "invalid json-ld"), ("structured_data", "complete", "missing recommended properties"),
    ("structured_data", "complete", "properties present but empty"), ("structured_data", "product", "product-like pages missing"), ("structured_data", "article", "article/blog pages missing"),
    ("extractability", "title", "missing a <title>"), ("extractability", "title_quality", "title tags outside"), ("extractability", "meta_desc", "missing a meta description"), ("extractability", "h1", "missing an h1"),
    ("extractability", "h1", "multiple h1"), ("extractability", "hierarchy", "hierarchy skips"), ("extractability", "alt", "images lack alt"), ("extractability", "alt", "embedded in images"), ("extractability", "lang", "language is not declared"),
    ("entity_identity", "homepage_identity", "lacks organization"), ("entity_identity", "name_consistency", "inconsistent brand name"), ("entity_identity", "name_consistency", "identity signals disagree"), ("entity_identity", "name_consistency", "conflicting organization"),
    ("freshness", "dated", "without a visible date"), ("freshness", "current", "stale copyright"), ("freshness", "current", "more than two years old"),
    ("corroboration", "sameas", "no sameas"), ("corroboration", "external_presence", "no links to external"),
    ("engagement", "mobile", "viewport"), ("engagement", "cta", "call-to-action"), ("engagement", "navigation", "navigation region"), ("engagement", "navigation", "dead-end"), ("engagement", "performance", "heavy pages"),
    ("engagement", "performance", "slow server"), ("engagement", "performance", "render-blocking"), ("engagement", "readability", "subheadings"), ("engagement", "readability", "wall"), ("engagement", "orientation", "breadcrumbs"),
    ("engagement", "accessibility", "label"), ("engagement", "accessibility", "iframe"), ("engagement", "accessibility", "non-descriptive"), ("engagement", "barriers", "login or registration"), ("engagement", "barriers", "interstitial"),
]
relation("keywords", values(KEYWORDS, "area, named, word"))
