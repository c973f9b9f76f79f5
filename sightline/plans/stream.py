"""The page stream and what is picked from it, in DuckDB's own words: tokens are rows and elements are found by windows.

Spark's relations (`operators/extract.py`) work on arrays within a row; these are written apart from them.
"""




def attr(x: str, name: str) -> str:
    """The first value of an attribute, without its quotes."""
    return rf"regexp_replace(regexp_extract({x}, '(?is)[\s\x22\x27]{name}\s*=\s*(\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s\x22\x27>]+)', 1), '^[\x22\x27]|[\x22\x27]$', '', 'g')"


STREAM = """
SELECT page_id, url, site, section, is_deep, page_ord, is_home, html, [{'i': i - 1, 'name': lower(regexp_extract(x[i], '^</?([A-Za-z][A-Za-z0-9]*)', 1)), 'x': x[i]} for i in range(1, len(x) + 1)] AS stream
FROM (SELECT s.*, ifnull(c.html, '') AS html, regexp_extract_all(ifnull(c.html, ''), '<TOKEN>', 0) AS x FROM {site_pages} s JOIN {page_html} c USING (page_id, url) WHERE s.page_ord <= $max_pages$)
"""

TAGS = (
    r"""
WITH tokens AS (SELECT site, page_ord, t.i AS i, t.name AS name, t.x AS x, t.x[:2] = '</' AS ends FROM (SELECT site, page_ord, unnest(stream) AS t FROM {page_stream})),
marks AS (SELECT *, lead(i) OVER w AS next_i, lead(ends) OVER w AS next_ends FROM (
            SELECT *, CASE WHEN name ~ 'h[1-6]' THEN 'h' ELSE name END AS kind FROM tokens WHERE name IN ('title', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') OR name = 'a' AND (ends OR len("""
    + attr("x", "href")
    + r""") > 0))
          WINDOW w AS (PARTITION BY site, page_ord, kind ORDER BY i)),
spans AS (SELECT m.site, m.page_ord, m.kind, m.i, m.x AS tag, ifnull(string_agg(t.x, '' ORDER BY t.i) FILTER (m.kind <> 'title' OR t.name = '' AND t.x NOT LIKE '<!%'), '') AS body
          FROM marks m LEFT JOIN tokens t ON m.site = t.site AND m.page_ord = t.page_ord AND t.i > m.i AND t.i < m.next_i WHERE NOT m.ends AND m.next_ends GROUP BY ALL),
found AS (SELECT site, page_ord, list({'tag': tag, 'body': body} ORDER BY i) FILTER (kind = 'title') AS titles, list({'tag': tag, 'body': body} ORDER BY i) FILTER (kind = 'a') AS anchors, list({'tag': tag, 'body': body} ORDER BY i) FILTER (kind = 'h') AS headings FROM spans GROUP BY site, page_ord),
metas AS (SELECT site, page_ord, list(key || ' ' || content ORDER BY i) AS metas FROM (
            SELECT site, page_ord, i, lower(coalesce("""
    + ", ".join(f"nullif({attr('x', a)}, '')" for a in ("name", "property", "http-equiv"))
    + r""")) AS key, """
    + attr("x", "content")
    + r""" AS content FROM tokens WHERE name = 'meta' AND NOT ends) WHERE key IN ('description', 'viewport', 'robots', 'og:site_name') GROUP BY site, page_ord),
lists AS (SELECT site, page_ord, arg_max("""
    + attr("x", "lang")
    + r""", i) FILTER (name = 'html' AND len("""
    + attr("x", "lang")
    + r""") > 0) AS lang, """
    + ", ".join(f"list(x ORDER BY i) FILTER (name IN ({n})) AS {c}" for c, n in (("link_tags", "'link'"), ("image_tags", "'img'"), ("script_tags", "'script'"), ("controls", "'input', 'select', 'textarea'"), ("labels", "'label'"), ("iframes", "'iframe'")))
    + r""",
            bool_or(regexp_matches(x, '(?i)^<[^>]*[\s\x22\x27](?:itemscope|itemtype|itemprop)\b')) AS has_microdata, bool_or(name <> 'meta' AND regexp_matches(x, '(?i)^<[^>]*[\s\x22\x27](?:vocab|typeof|property)\s*=')) AS has_rdfa
          FROM tokens WHERE name <> '' AND NOT ends GROUP BY site, page_ord)
SELECT page_id, url, site, section, is_deep, page_ord, is_home, html, length(html) AS html_len, strlen(html) AS html_bytes, ifnull(titles, []) AS titles, ifnull(lang, '') AS lang, ifnull(metas, []) AS metas, ifnull(link_tags, []) AS link_tags, ifnull(anchors, []) AS anchors,
       ifnull(image_tags, []) AS image_tags, ifnull(headings, []) AS headings, ifnull(script_tags, []) AS script_tags, ifnull(controls, []) AS controls, ifnull(labels, []) AS labels, ifnull(iframes, []) AS iframes, ifnull(has_microdata, false) AS has_microdata, ifnull(has_rdfa, false) AS has_rdfa,
       CASE WHEN html ILIKE '%<head%' AND regexp_matches(html, '(?is)<head[^>]*>.*?</head>') THEN regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) ELSE html[:4000] END AS head
FROM {page_stream} LEFT JOIN found USING (site, page_ord) LEFT JOIN metas USING (site, page_ord) LEFT JOIN lists USING (site, page_ord)
"""
)

BLOCKS = (
    r"""
WITH scripts AS (SELECT site, page_ord, url, is_home, generate_subscripts(script_tags, 1) - 1 AS pos, unnest(script_tags) AS x FROM {page_tags}),
blocks AS (SELECT site, page_ord, url, is_home, pos, trim(regexp_extract(x, '(?is)^<script\b[^>]*>(.*)</script\s*>$', 1)) AS b FROM scripts WHERE lower("""
    + attr("regexp_extract(x, '^<[^>]*>')", "type")
    + r""") = 'application/ld+json' AND regexp_matches(x, '(?i)</script\s*>$')),
parts AS (SELECT site, page_ord, url, is_home, pos, 0 AS k, b FROM blocks WHERE json_valid(b)
          UNION ALL
          SELECT site, page_ord, url, is_home, pos, generate_subscripts(parts, 1) - 1, unnest(parts) FROM (
            SELECT site, page_ord, url, is_home, pos, [trim(regexp_extract(p, '(?s)(\{.*)$', 1)) for p in string_split(array_to_string([CASE WHEN regexp_matches(t, '^\}\s*[\{\[]$') THEN '}' || chr(1) || t[-1:] ELSE t END for t in regexp_extract_all(b, '(?s)"(?:[^"\\]|\\.)*"|\}\s*[\{\[]|[^"}]+|.', 0)], ''), chr(1))] AS parts
            FROM blocks WHERE NOT json_valid(b)))
SELECT site, page_ord, url, is_home, pos, k, b FROM parts WHERE json_valid(b) AND b[1] IN ('{', '[')
"""
)
