"""SQL for DuckDB written by hand, from what the tables mean and not from the relations' own SELECTs.

Each entry names the relations that it starts from; these come first, as `duckdb_sql` renders them. So an error in the
rendered chain and an error here would have to agree to stay unseen. Scores are worked out from severities and
confidences again, stakes by scoring the site anew without the finding, rules one by one.
"""

from __future__ import annotations

from sightline.plans.relations import Settings, chain

POINTS = "CASE severity WHEN 'critical' THEN 35.0 WHEN 'high' THEN 18.0 WHEN 'medium' THEN 8.0 WHEN 'low' THEN 3.0 ELSE 1.0 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.5 END"
SIDE = "round_even(CASE WHEN {0} > 100 THEN 0.0 ELSE 100.0 - {0} END, 1)"


def total(disc: str, eng: str) -> str:
    return f"CAST(round_even(0.6 * {SIDE.format(disc)} + 0.4 * {SIDE.format(eng)}, 0) AS BIGINT)"


GRADE = "(['F', 'D', 'C', 'B', 'A'])[1 + (CASE WHEN {0} < 60 THEN 0 WHEN {0} >= 90 THEN 4 ELSE ({0} // 10) - 5 END)]"
LOSSES = f"""losses AS (
  SELECT p.site, any_value(p.n) AS n_pages, CAST(coalesce(sum(f.loss) FILTER (f.dimension = 'discoverability'), 0) AS DOUBLE) AS disc, CAST(coalesce(sum(f.loss) FILTER (f.dimension = 'engagement'), 0) AS DOUBLE) AS eng
  FROM (SELECT site, count(*) AS n FROM r_site_pages GROUP BY site) p LEFT JOIN (SELECT site, dimension, {POINTS} AS loss FROM r_findings) f USING (site) GROUP BY p.site)"""
SCORES = f"""{LOSSES},
scores AS (SELECT site, {SIDE.format('disc')} AS discoverability, {SIDE.format('eng')} AS engagement, {total('disc', 'eng')} AS value, n_pages FROM losses)"""

COUNTS = "SELECT site, {} FROM r_findings GROUP BY site"
TALLY = "count(*) AS total, sum((severity = 'critical')::BIGINT)::BIGINT AS critical, sum((severity = 'high')::BIGINT)::BIGINT AS high, sum((severity = 'medium')::BIGINT)::BIGINT AS medium, sum((severity = 'low')::BIGINT)::BIGINT AS low"

#: rule, where it holds, in DuckDB's words. `$name$` is a setting.
RULES = [
    ("C4", "error = 'blocked_by_robots'"), ("C5", "status >= 500"), ("C6", "concat_ws(' ', meta_robots, x_robots) ILIKE '%noindex%'"), ("C7", "NOT canonical_domain IN ('', own_domain)"),
    ("C13", "shell AND (word_count < $render_spa_hard_max_words$ OR spa_marker IS NOT NULL)"), ("C14", "html_len > $render_thin_html$ AND word_count < $render_thin_words$ AND NOT shell"), ("C15", "asks_for_js"),
    ("D2", "n_nodes = 0 AND declares_jsonld"),
    ("D4", "NOT t_product AND (len(list_intersect(string_split(lower(path), '/')[2:], ['product', 'products', 'shop', 'store', 'item', 'items', 'dp', 'p'])) > 0 OR (has_cart AND (regexp_matches(visible_text, '[$€£₹][\\s]?[0-9]') OR regexp_matches(visible_text, '(?i)\\b(?:usd|inr)\\b') OR visible_text ILIKE '%priceCurrency%')))"),
    ("D5", "NOT t_article AND (len(list_intersect(string_split(lower(path), '/')[2:], ['blog', 'article', 'articles', 'news', 'post', 'posts'])) > 0 OR regexp_matches(lower(substr(visible_text, 1, 400)), '\\bmin read\\b|\\bposted on\\b|\\bpublished (on|in)\\b'))"),
    ("E1", "len(trim(title)) = 0"), ("E2", "len(trim(description)) = 0"), ("E4", "len(trim(title)) > 0 AND (len(trim(title)) < 15 OR len(trim(title)) > 65)"), ("E5", "len(trim(description)) > 160"),
    ("E6", "NOT n_h1 > 0"), ("E7", "n_h1 >= 2"), ("E8", "jumps"), ("E10", "html_len > $text_in_image_min_html$ AND word_count < $text_in_image_max_words$ AND n_images >= $text_in_image_min_images$"),
    ("F1", "copyright_year + 1 < year($as_of$) AND NOT recent"), ("F2", "$as_of$ - newest_date > $stale_days$ AND NOT recent"),
    ("F3", "newest_date IS NULL AND NOT dated AND (url LIKE '%/blog/%' OR url LIKE '%/news/%' OR url LIKE '%/article/%' OR substr(visible_text, 1, 300) ILIKE '%min read%')"),
    ("G1", "len(trim(viewport)) = 0"), ("G4", "n_internal < $deadend_min_links$"), ("G5", "n_scripts > $page_weight_scripts$ OR ifnull(raw_len, html_bytes) > $page_weight_bytes$"), ("G6", "elapsed_ms > $slow_ms$"),
    ("G7", "head_js + head_css > $render_blocking_head_max$"), ("G8", "n_headings <= $wall_max_headings$ AND word_count > $wall_words$"), ("G10", "has_popup"),
    ("G11", "regexp_matches(lower(substr(visible_text, 1, 800)), '(sign ?in|log ?in|register|create an account|subscribe)\\s+(to|and)\\s+(continue|read|view|access|see|unlock)|(members|subscribers) only')"),
]

#: name: (relations that it starts from, SQL).
BY_HAND: dict[str, tuple[list[str], str]] = {
    "page_rule_hits": (
        ["page_facts"],
        "WITH facts AS (SELECT *, word_count < $render_spa_max_words$ AND (spa_marker IS NOT NULL OR 200 * n_scripts + inline_script_len > $render_script_ratio$ * CASE WHEN text_len > 1 THEN text_len ELSE 1 END) AS shell, "
        "visible_text LIKE '%' || year($as_of$) || '%' OR visible_text LIKE '%' || (year($as_of$) - 1) || '%' OR ifnull($as_of$ - newest_date < $recent_signal_days$, false) AS recent FROM r_page_facts) "
        + " UNION ALL ".join(f"SELECT site, page_ord, url, '{k}' AS check_id, 1::BIGINT AS n FROM facts WHERE {rule}" for k, rule in RULES),
    ),
    "site_scores": (["findings", "site_pages"], f"WITH {SCORES} SELECT site, discoverability, engagement, value, {GRADE.format('value')} AS grade, n_pages, n_pages < 3 AS provisional FROM scores"),
    "severity_counts": (["findings"], COUNTS.format(TALLY + ", sum((dimension = 'discoverability')::BIGINT)::BIGINT AS discoverability, sum((dimension = 'engagement')::BIGINT)::BIGINT AS engagement")),
    "score_every_site": (
        ["findings", "site_pages"],
        f"WITH {SCORES}, n AS ({COUNTS.format(TALLY)}) SELECT s.site, discoverability, engagement, value, {GRADE.format('value')} AS grade, n_pages, n_pages < 3 AS provisional, "
        + ", ".join(f"ifnull(n.{c}, 0) AS {c}" for c in ("total", "critical", "high", "medium", "low"))
        + " FROM scores s LEFT JOIN n USING (site)",
    ),
    # the stake of a finding: the site scored anew from all its other findings
    "matrix": (
        ["findings", "site_pages", "categories"],
        f"""WITH {SCORES},
rest AS (SELECT a.site, a.id, CAST(coalesce(sum(b.loss) FILTER (b.dimension = 'discoverability'), 0) AS DOUBLE) AS disc, CAST(coalesce(sum(b.loss) FILTER (b.dimension = 'engagement'), 0) AS DOUBLE) AS eng
         FROM r_findings a LEFT JOIN (SELECT site, id, dimension, {POINTS} AS loss FROM r_findings) b ON a.site = b.site AND a.id <> b.id GROUP BY ALL),
rated AS (SELECT f.*, CASE WHEN c.by_template = 1 OR f.n_affected < 5 THEN c.effort WHEN c.effort = 5 THEN 5 ELSE c.effort + 1 END AS effort, {total('r.disc', 'r.eng')} - s.value AS gain
          FROM r_findings f JOIN r_categories c USING (category) JOIN rest r ON f.site = r.site AND f.id = r.id JOIN scores s ON f.site = s.site)
SELECT site, id, check_id, title, severity, dimension, category, confidence, priority, impact, effort, (['Low', 'Low', 'Medium', 'High', 'High'])[effort] AS effort_label, n_affected, affected, penalty,
       CASE (impact >= 3)::INT * 2 + (effort <= 2)::INT WHEN 3 THEN 'quick_win' WHEN 2 THEN 'major_project' WHEN 1 THEN 'fill_in' ELSE 'low_priority' END AS quadrant, CASE WHEN gain > 0 THEN gain ELSE 0 END AS points_at_stake
FROM rated""",
    ),
    "quadrant_counts": (["matrix"], "SELECT site, " + ", ".join(f"len(list_filter(list(quadrant), lambda q: q = '{q}')) AS {q}" for q in ("quick_win", "major_project", "fill_in", "low_priority")) + " FROM r_matrix GROUP BY site"),
    "projection": (
        ["matrix", "findings", "site_pages"],
        f"""WITH {SCORES},
kept AS (SELECT f.site, f.dimension, {POINTS} AS loss FROM r_findings f SEMI JOIN (SELECT site, id FROM r_matrix WHERE quadrant <> 'quick_win') m ON f.site = m.site AND f.id = m.id),
later AS (SELECT s.site, {total("CAST(coalesce(sum(loss) FILTER (dimension = 'discoverability'), 0) AS DOUBLE)", "CAST(coalesce(sum(loss) FILTER (dimension = 'engagement'), 0) AS DOUBLE)")} AS after FROM scores s LEFT JOIN kept USING (site) GROUP BY s.site),
aims AS (SELECT s.site, s.value, l.after, list_min(list_filter([60, 70, 80, 90], lambda x: x > s.value)) AS aim FROM scores s JOIN later l USING (site))
SELECT site, value AS current, {GRADE.format('value')} AS current_grade, after AS after_quick_wins, {GRADE.format('after')} AS after_quick_wins_grade, CASE WHEN after > value THEN after - value ELSE 0 END AS quick_win_gain, 100::BIGINT AS after_all_fixed, 100 - value AS headroom,
       aim AS at_least, aim - value AS points_to_next, ifnull(after >= aim, false) AS quick_wins_reach_next_grade FROM aims""",
    ),
    "distribution": (
        ["findings"],
        "WITH long AS (UNPIVOT (SELECT site, severity, confidence, dimension, category FROM r_findings) ON severity, confidence, dimension, category INTO NAME field VALUE key), n AS (SELECT site, field, key, count(*) AS n FROM long GROUP BY ALL) "
        "SELECT a.site, a.field, a.key, a.n, CAST(round_even(100.0 * a.n / (SELECT count(*) FROM r_findings f WHERE f.site = a.site), 0) AS BIGINT) AS pct FROM n a",
    ),
    "hotspots": (
        ["findings", "severities"],
        "WITH pages AS (SELECT site, unnest(string_split(affected, ' | ')) AS url, impact, severity FROM r_findings WHERE affected IS NOT NULL), n AS (SELECT site, url, count(*) AS findings, CAST(sum(pages.impact) AS BIGINT) AS impact, list_extract(list_sort(list(s.sev_rank || ' ' || s.severity)), 1)[3:] AS top_severity FROM pages JOIN r_severities s USING (severity) GROUP BY site, url) "
        "SELECT site, url, findings, impact, top_severity FROM n a WHERE (SELECT count(*) FROM n b WHERE b.site = a.site AND (b.impact > a.impact OR b.impact = a.impact AND (b.findings > a.findings OR b.findings = a.findings AND b.url < a.url))) < 8",
    ),
    "external_hits": (
        ["site_pages", "external_runs", "entity_matches", "profile_states", "corpus_index"],
        """WITH ran AS (SELECT DISTINCT site FROM r_site_pages WHERE site IN (SELECT site FROM r_external_runs)), domains AS (SELECT site, array_to_string(string_split(site, '.')[-CASE WHEN array_to_string(string_split(site, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'co.in', 'net.in', 'org.in', 'gov.in', 'co.jp', 'com.au', 'com.br', 'co.nz', 'com.sg', 'co.za') THEN 3 ELSE 2 END:], '.') AS domain FROM ran)
SELECT r.site, CASE WHEN m.site IS NULL THEN 'X2e' ELSE 'X1e' END AS check_id, 1::BIGINT AS n FROM ran r LEFT JOIN r_entity_matches m USING (site) WHERE m.site IS NULL OR NOT m.links_back
UNION ALL SELECT site, 'X3e', count(*) FROM r_profile_states WHERE state = 'unreachable' AND site IN (FROM ran) GROUP BY site
UNION ALL SELECT d.site, 'X4e', 1 FROM domains d JOIN r_corpus_index c USING (domain) WHERE c.records = 0""",
    ),
    "claim_summary": (
        ["claims"],
        "SELECT site, count(*) AS total, " + ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in ("quotable", "structured_only", "text_only", "contradicted"))
        + ", count(CASE WHEN in_text THEN 1 END) AS in_text, count(CASE WHEN off_site THEN 1 END) AS off_site, count(CASE WHEN type IN ('social_profile', 'identity_link') THEN 1 END) > 0 AS has_links, "
        "CAST(round_even(avg(CASE WHEN status = 'quotable' THEN 100.0 ELSE 0.0 END), 0) AS BIGINT) AS quotable_pct, CAST(round_even(avg(CASE WHEN in_sd THEN 100.0 ELSE 0.0 END), 0) AS BIGINT) AS machine_pct FROM r_claims GROUP BY site",
    ),
    "citation_scores": (
        ["claims", "consistency", "external_evidence"],
        f"""WITH c AS (SELECT site, round_even(100.0 * count(*) FILTER (in_sd) / count(*), 0) AS m, round_even(100.0 * count(*) FILTER (in_text) / count(*), 0) AS x, count(*) FILTER (off_site) AS off, bool_or(type = 'identity_link' OR type = 'social_profile') AS linked FROM r_claims GROUP BY site),
parts AS (SELECT s.site, c.m, c.x, CASE WHEN c.site IS NULL THEN NULL WHEN e.verified THEN 100 WHEN c.off = 0 THEN 30 WHEN c.off = 1 THEN 50 ELSE 65 END AS k, CASE WHEN s.conflicts >= 4 THEN 0 ELSE 100 - 30 * s.conflicts END AS s, CASE WHEN c.site IS NULL THEN NULL WHEN c.linked THEN 100 ELSE 60 END AS a
          FROM r_consistency s LEFT JOIN c USING (site) LEFT JOIN r_external_evidence e USING (site))
SELECT site, score, {GRADE.format('score')} AS grade, weakest FROM (SELECT site, CAST(round_even((30 * ifnull(m, 0) + 20 * ifnull(x, 0) + 25 * ifnull(k, 0) + 15 * s + 10 * ifnull(a, 0)) / 100.0, 0) AS BIGINT) AS score,
  list_extract(list_sort(list_filter([{{'v': m, 'o': 1, 'n': 'machine_quotability'}}, {{'v': x, 'o': 2, 'n': 'extractability'}}, {{'v': k, 'o': 3, 'n': 'corroboration'}}, {{'v': s, 'o': 4, 'n': 'stability'}}, {{'v': a, 'o': 5, 'n': 'attribution'}}], lambda p: p.v IS NOT NULL)), 1).n AS weakest FROM parts)""",
    ),
}


def by_hand(settings: Settings | None = None) -> dict[str, str]:
    return {name: chain(inputs, sql, settings) for name, (inputs, sql) in BY_HAND.items()}
