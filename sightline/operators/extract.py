"""Sampling and extraction: pages -> signals and child tables (survey L1, X1-X20, U1-U12).

The sample is taken on URLs, before any html is read. Then one pass over the sampled html makes `page_signals`; links, headings, images,
structured-data nodes and language links are child tables of it.
"""

from sightline.functions import urls
from sightline.plans import stream
from sightline.plans.relations import relation
from sightline.sources.corpus import SAMPLE_HTML

#: Named and numeric references that pages use, in the order in which they are decoded (`&amp;` last; fixed values).
ENTITIES = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("middot", "·"), ("copy", "©"), ("euro", "€"), ("pound", "£"), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("amp", "&")]


def decoded(x: str) -> str:
    """`x` with its references decoded, with or without their semicolon. Plain replacements: no regular expression runs."""
    out = x
    for name, char in ENTITIES[:-1]:
        out = f"replace(replace({out}, '&{name};', '{char}'), '&{name}', '{char}')"
    return f"CASE WHEN contains({x}, '&') THEN replace(replace(replace({out}, '&amp;', chr(2)), '&amp', '&'), chr(2), '&') ELSE {x} END"


def decoded_in_parts(x: str) -> str:
    """As `decoded`, for Spark and long texts: each `&` is looked at once, with what follows it. No replacement makes a new reference, so order doesn't count."""
    cases = "".join(f" WHEN startswith(s, '{name};') THEN '{char}' || substring(s, {len(name) + 2}) WHEN startswith(s, '{name}') THEN '{char}' || substring(s, {len(name) + 1})" for name, char in ENTITIES)
    parts = f"array_join(transform(split({x}, '&'), (s, i) -> CASE WHEN i = 0 THEN s{cases} ELSE '&' || s END), '')"
    return f"CASE WHEN contains({x}, '&') THEN replace({parts}, chr(2), '&') ELSE {x} END"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, r'[\s\x{{00a0}}]+', ' ', /*all*/ 1))"


def squeezed_where_needed(x: str) -> str:
    """As `squeezed`, for Spark and long texts: a single blank is left where it stands."""
    return rf"trim(regexp_replace({x}, r'[\t\n\x0B\f\r\u00a0][\s\u00a0]*| [\s\u00a0]+', ' ', /*all*/ 1))"


#: A page as a stream: comments, scripts and styles whole, tags, stretches of text. What is never closed reaches to the end.
TOKEN = r"(?is)<!--.*?(?:-->|\z)|" + "".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)|" for t in ("script", "style")) + r"</?[a-z][^>]*>|<![^>]*>|[^<]+|<"
#: All that is not visible text: tags, and elements whose text isn't copy.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|" + "".join(rf"<{t}\b(?:[^>]*[^/>])?>.*?(?:</{t}\s*>|\z)|" for t in ("head", "script", "style", "noscript", "template", "svg")) + r"</?[a-z][^>]*>|<![^>]*>"
#: The same with the `<` of all alternatives taken out in front: Java's engine then passes over text by one comparison a character.
UNSEEN_FAST = "(?is)<(?:" + UNSEEN.removeprefix("(?is)<").replace("|<", "|") + ")"


def unmarked(html: str) -> str:
    """What is left of html when all that isn't visible is a blank."""
    return f"regexp_replace({html}, r'{UNSEEN}', ' ', /*all*/ 1)"


def attribute(tag: str, name: str) -> str:
    """The value of an attribute in a tag, quoted either way or bare; '' if it has none."""
    return rf"coalesce(nullif(regexp_extract({tag}, r'(?is)[\s\x22\x27]{name}\s*=\s*\x22([^\x22]*)\x22', 1), ''), nullif(regexp_extract({tag}, r'(?is)[\s\x22\x27]{name}\s*=\s*\x27([^\x27]*)\x27', 1), ''), regexp_extract({tag}, r'(?is)[\s\x22\x27]{name}\s*=\s*([^\s\x22\x27>]+)', 1))"


def has_attribute(tag: str, name: str) -> str:
    return rf"regexp_like({tag}, r'(?is)[\s\x22\x27]{name}\s*=')"


def has_value(tag: str, name: str) -> str:
    return rf"regexp_like({tag}, r'(?is)[\s\x22\x27]{name}\s*=\s*(?:\x22[^\x22]|\x27[^\x27]|[^\s\x22\x27>])')"


def meta(key: str) -> str:
    """The content of the last <meta> with this name, property or http-equiv."""
    return f"coalesce(try_element_at(filter(transform(metas, x -> CASE WHEN startswith(x, '{key} ') THEN substring(x, {len(key) + 2}) END), x -> x IS NOT NULL), -1), '')"


def spared(sql: str, *texts: tuple[str, str]) -> str:
    """`sql` with each expression of `texts` behind its plain condition, without which it leaves its own column as it is. For Spark: no regular expression runs in vain."""
    for text, condition in texts:
        if text not in sql:
            raise ValueError(f"not in the relation: {text[:60]}")
        sql = sql.replace(text, condition.format(text))
    return sql


#: Every alternative of UNSEEN begins with `<`; dots to fold follow a slash.
PLAIN_BODY = (unmarked("a.body"), "CASE WHEN contains(a.body, '<') THEN {} ELSE a.body END")
PLAIN_HEADING = (unmarked("h.body"), "CASE WHEN contains(h.body, '<') THEN {} ELSE h.body END")
NO_DOTS = ("WHEN regexp_like(h, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') THEN whole", "WHEN NOT contains(whole, '/.') THEN whole {}")

#: Whether the script tag x holds structured data.
IS_JSONLD = "lower(" + attribute(r"regexp_extract(x, r'^(<[^>]*>)', 1)", "type") + r") = 'application/ld+json' AND regexp_like(x, r'(?i)</script\s*>$')"


def meta_pair(x: str) -> str:
    """`key content` of a <meta> tag, its key in lower case; keys hold no blank."""
    key = "coalesce(" + ", ".join(f"nullif({attribute(x, a)}, '')" for a in ("name", "property", "http-equiv")) + ", '')"
    return f"lower({key}) || ' ' || {attribute(x, 'content')}"


# host and path are taken from an address once; the rest is made from them
relation("page_urls", rf"""
SELECT page_id, url, regexp_replace(n, r'^www\.', '') AS host, bare_host, {urls.domain_of('bare_host')} AS domain, path, '/' || regexp_extract(path, r'^/*([^/]*)', 1) AS section,
       {urls.page_type_rank('url')} AS type_rank, {urls.is_deep('url')} AS is_deep, locale, CASE WHEN locale = '' THEN url ELSE regexp_extract(url, r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^/?#]*)', 1) || '/' END AS locale_root, regexp_like(lower(path), r'{urls.ASSET}') AS is_asset
FROM (SELECT page_id, url, n, path, regexp_replace(regexp_replace(n, r':.*$', ''), r'^www\.', '') AS bare_host, lower(regexp_extract(path, r'^/([A-Za-z][A-Za-z](?:[-_][A-Za-z][A-Za-z])?)(?:/|$)', 1)) AS locale
      FROM (SELECT page_id, url, {urls.netloc('url')} AS n, {urls.path('url')} AS path FROM {{crawl}}))
""")

# pages whose response says that they are something else (L3)
relation("not_html", "SELECT url FROM {response_of} WHERE coalesce(content_type, '') <> '' AND NOT contains(lower(content_type), 'html')")

# In Spark, addresses are dealt out before anything is made of them: a file of addresses may be one block, which one task reads. Those that are no html stand
# among them, so that one grouping by address finds copies and those; a page_id that is NULL goes first, as it does in the order by page_id.
# What sorts out images and the like is one comparison with the grouping's result, as Spark would else move it into the task that reads.
relation("page_sample", """
SELECT page_id, url, site, section, is_deep, row_number() OVER (PARTITION BY site ORDER BY at_root DESC, type_rank, url, page_id) AS page_ord
FROM (SELECT u.*, u.$site$ AS site, CASE WHEN path IN ('', '/') THEN 1 ELSE 0 END AS at_root, row_number() OVER (PARTITION BY u.url ORDER BY page_id) AS copy FROM {page_urls} u LEFT JOIN {not_html} n ON u.url = n.url WHERE NOT is_asset AND n.url IS NULL)
WHERE copy = 1
""", replaces="page_urls", spark=rf"""
SELECT page_id, url, site, '/' || regexp_extract(path, r'^/*([^/]*)', 1) AS section, {urls.is_deep('url')} AS is_deep, row_number() OVER (PARTITION BY site ORDER BY at_root DESC, type_rank, url, page_id) AS page_ord
FROM (SELECT page_id, url, path, $site$ AS site, CASE WHEN path IN ('', '/') THEN 1 ELSE 0 END AS at_root, {urls.plain_page_type_rank('url')} AS type_rank FROM (
  SELECT page_id, url, path, bare_host, {urls.domain_of('bare_host')} AS domain FROM (
    SELECT page_id, url, path, CASE WHEN startswith(h, 'www.') THEN substring(h, 5) ELSE h END AS bare_host FROM (
      SELECT page_id, url, path, CASE WHEN contains(n, ':') THEN regexp_replace(n, r':.*$', '') ELSE n END AS h FROM (
        SELECT page_id, url, lower(n) AS n, {urls.plain_path('url', 'rest', 'n')} AS path FROM (
          SELECT page_id, url, rest, {urls.plain_netloc('url', 'rest')} AS n FROM (
            SELECT page_id, url, {urls.after_scheme('url')} AS rest FROM (
              SELECT CASE WHEN bool_or(page_id IS NULL AND is_page) THEN NULL ELSE min(page_id) END AS page_id, url, min(cast(is_page AS int)) AS is_page
              FROM (SELECT * FROM (SELECT page_id, url, true AS is_page FROM {{crawl}} UNION ALL SELECT NULL, url, false FROM {{not_html}}) DISTRIBUTE BY url) GROUP BY url)
            WHERE is_page > CASE WHEN {urls.is_asset('url')} THEN 1 ELSE 0 END)))))))
""")

# in Spark, what follows from the address and doesn't decide the sample is taken from sampled addresses alone
relation("site_pages", "SELECT page_id, url, site, section, is_deep, page_ord, page_ord = 1 AS is_home FROM {page_sample} WHERE page_ord <= $max_pages$", stored=True, replaces="page_sample",
         spark=f"SELECT page_id, url, site, {urls.section('url')} AS section, {urls.is_deep('url')} AS is_deep, page_ord, page_ord = 1 AS is_home FROM {{page_sample}} WHERE page_ord <= $max_pages$")

# where html is fetched from, for the sample alone
relation("page_html", "SELECT page_id, url, html FROM {crawl}", spark=SAMPLE_HTML, replaces="crawl", tasks_by="site_pages")

# One pass over the html of the sample: every tag and stretch of text with its place. All that follows but the visible text is picked from it.
relation("page_stream", r"""
SELECT page_id, url, site, section, is_deep, page_ord, is_home, html, transform(regexp_extract_all(html, r'""" + TOKEN + r"""', 0), (x, i) -> named_struct('i', i, 'name', lower(regexp_extract(x, r'^</?([A-Za-z][A-Za-z0-9]*)', 1)), 'x', x)) AS stream
FROM (SELECT s.page_id, s.url, s.site, s.section, s.is_deep, s.page_ord, s.is_home, coalesce(c.html, '') AS html FROM {site_pages} s JOIN {page_html} c ON s.page_id = c.page_id AND s.url = c.url WHERE s.page_ord <= $max_pages$)
""", duck=stream.STREAM.replace("<TOKEN>", TOKEN))

relation("page_tokens", "SELECT site, page_ord, url, t.i AS pos, t.name, startswith(t.x, '</') AS ends, t.x AS token FROM (SELECT site, page_ord, url, explode(stream) AS t FROM {page_stream})")


def between(marks: str, picked: str) -> str:
    """Elements of a kind: an opening tag of `marks` whose next one there closes, as (tag, the `picked` of the tokens between)."""
    after = f"try_element_at({marks}, k + 2)"
    spans = f"filter(transform({marks}, (t, k) -> named_struct('tag', t.x, 'a', t.i, 'b', CASE WHEN NOT startswith(t.x, '</') AND startswith({after}.x, '</') THEN {after}.i END)), p -> p.b IS NOT NULL)"
    return f"transform({spans}, p -> named_struct('tag', p.tag, 'body', array_join(transform(filter(slice(stream, p.a + 2, p.b - p.a - 1), s -> {picked}), s -> s.x), '')))"


def tags(*names: str) -> str:
    return f"transform(filter(opens, t -> t.name IN ({', '.join(repr(n) for n in names)})), t -> t.x)"


relation("page_tags", r"""
SELECT page_id, url, site, section, is_deep, page_ord, is_home, html, length(html) AS html_len, octet_length(html) AS html_bytes, """ + between("titles", "s.name = '' AND NOT startswith(s.x, '<!')") + r""" AS titles,
       coalesce(""" + attribute("try_element_at(filter(opens, t -> t.name = 'html' AND " + has_value("t.x", "lang") + "), -1).x", "lang") + r""", '') AS lang,
       filter(transform(""" + tags("meta") + ", x -> " + meta_pair("x") + r"""), x -> regexp_like(x, r'^(?:description|viewport|robots|og:site_name) ')) AS metas, """ + tags("link") + r""" AS link_tags,
       """ + between("links", "true") + r""" AS anchors, """ + tags("img") + r""" AS image_tags, """ + between("heads", "true") + r""" AS headings, """ + tags("script") + r""" AS script_tags, """ + tags("input", "select", "textarea") + r""" AS controls,
       """ + tags("label") + r""" AS labels, """ + tags("iframe") + r""" AS iframes,
       exists(opens, t -> regexp_like(t.x, r'(?i)^<[^>]*[\s\x22\x27]item(?:scope|type|prop)\b')) AS has_microdata, exists(opens, t -> t.name <> 'meta' AND regexp_like(t.x, r'(?i)^<[^>]*[\s\x22\x27](?:typeof|property|vocab)\s*=')) AS has_rdfa,
       CASE WHEN regexp_like(html, r'(?is)<head[^>]*>.*?</head>') THEN regexp_extract(html, r'(?is)<head[^>]*>(.*?)</head>', 1) ELSE substring(html, 1, 4000) END AS head
FROM (SELECT *, filter(stream, t -> t.name <> '' AND NOT startswith(t.x, '</')) AS opens, filter(stream, t -> t.name = 'a' AND (startswith(t.x, '</') OR """ + has_value("t.x", "href") + r""")) AS links,
             filter(stream, t -> t.name IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')) AS heads, filter(stream, t -> t.name = 'title') AS titles FROM {page_stream})
""", stored=True, duck=stream.TAGS)

NO_LABEL = ["hidden", "submit", "button", "reset", "image"]
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{0e00}-\x{0e7f}]"


def holds(*words: str) -> str:
    """Whether the page's source holds one of the words: a plain search that spares most pages a regular expression."""
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


# Texts are squeezed, so words are counted by blanks; where letters stand for words, each of them is one.
PAGE_SIGNALS = r"""
SELECT page_id, url, site, section, is_deep, page_ord, is_home, html_len, html_bytes, visible_text, length(visible_text) AS text_len, """ + squeezed("title") + r""" AS title, lang,
       CASE WHEN visible_text = '' THEN 0 WHEN regexp_like(visible_text, r'""" + CJK + r"""') THEN size(filter(split(regexp_replace(visible_text, r'""" + CJK + r"""', ' ', /*all*/ 1), r'\s+'), x -> x <> '')) + size(regexp_extract_all(visible_text, r'""" + CJK + r"""', 0))
            ELSE length(visible_text) - length(replace(visible_text, ' ', '')) + 1 END AS word_count,
       CASE WHEN html_len = 0 THEN 0.0 ELSE bround(cast(length(visible_text) AS double) / html_len, 4) END AS text_ratio,
       """ + decoded(meta("description")) + r""" AS description, """ + meta("viewport") + r""" AS viewport, """ + meta("robots") + r""" AS meta_robots, """ + decoded(meta("og:site_name")) + r""" AS site_name,
       coalesce(""" + attribute(r"try_element_at(filter(link_tags, x -> contains(lower(" + attribute("x", "rel") + r"), 'canonical') AND " + has_value("x", "href") + r"), -1)", "href") + r""", '') AS canonical,
       size(anchors) AS n_links, size(image_tags) AS n_images, size(filter(image_tags, x -> NOT """ + has_attribute("x", "alt") + r""")) AS n_images_no_alt,
       size(filter(headings, x -> startswith(lower(x.tag), '<h1'))) AS n_h1, size(filter(headings, x -> startswith(lower(x.tag), '<h2'))) AS n_h2, size(headings) AS n_headings,
       size(filter(script_tags, x -> regexp_like(x, r'(?is)^<script\b[^>]*\bsrc\s*='))) AS n_scripts,
       length(array_join(transform(filter(script_tags, x -> NOT regexp_like(x, r'(?is)^<script\b[^>]*\bsrc\s*=')), x -> regexp_extract(x, r'(?is)^<script\b[^>]*>(.*?)</script\s*>$', 1)), '')) AS inline_script_len,
       size(filter(script_tags, x -> """ + IS_JSONLD + r""")) AS n_jsonld_blocks, has_microdata, has_rdfa,
       regexp_extract_all(html, r'\b(20\d\d-\d\d-\d\d)\b', 1) AS date_texts, regexp_extract_all(right(visible_text, 800), r'(?i)(?:©|copyright)[^\n<]{0,40}', 0) AS copyright_spans,
       size(regexp_extract_all(head, r'(?i)<link[^>]+rel=[\x22\x27]stylesheet[\x22\x27]', 0)) AS head_css,
       size(filter(regexp_extract_all(head, r'(?i)<script\b[^>]*>', 0), x -> contains(lower(x), 'src=') AND NOT contains(lower(x), 'async') AND NOT contains(lower(x), 'defer'))) AS head_js,
       size(filter(controls, x -> NOT (regexp_like(x, r'(?i)^<input') AND lower(coalesce(nullif(regexp_extract(x, r'(?i)\btype=[\x22\x27]?([a-z]+)', 1), ''), 'text')) IN (""" + ", ".join(f"'{t}'" for t in NO_LABEL) + r"""))
         AND NOT regexp_like(lower(x), r'aria-label|title=|placeholder=') AND NOT coalesce(array_contains(label_ids, nullif(regexp_extract(x, r'\bid=[\x22\x27]([^\x22\x27]+)', 1), '')), false))) AS n_unlabeled,
       size(filter(iframes, x -> NOT regexp_like(lower(x), r'title=|aria-hidden'))) AS n_untitled_iframes,
       CASE WHEN """ + holds("<button") + r""" THEN left(array_join(regexp_extract_all(html, r'(?is)<button[^>]*>(.*?)</button>', 1), ' '), 2000) ELSE '' END AS button_text,
       CASE WHEN regexp_like(html, r'(?i)<div[^>]+id=[\x22\x27](?:root|app|__next|__nuxt)[\x22\x27][^>]*>\s*</div>') THEN 'empty app-root div' WHEN contains(low, 'window.__nuxt__') THEN 'Nuxt hydration payload' WHEN contains(low, '__next_data__') THEN 'Next.js data island'
            WHEN contains(low, 'ng-version=') THEN 'Angular app shell' WHEN contains(low, 'data-reactroot') THEN 'React root without server markup' END AS spa_marker,
       """ + holds("<noscript") + r""" AND regexp_like(html, r'(?i)<noscript[^>]*>\s*(?:you|enable|requires)?\s*javascript') AS asks_for_js, """ + holds("<nav", "navigation") + r""" AND regexp_like(html, r'(?i)<nav[\s>]|role=[\x22\x27]navigation[\x22\x27]') AS has_nav, contains(low, 'breadcrumb') AS has_breadcrumb,
       """ + holds("modal", "popup", "overlay", "interstitial") + r""" AND regexp_like(html, r'(?i)(?:newsletter|subscribe|cookie).{0,40}(?:modal|popup|overlay|interstitial)|(?:modal|popup|overlay|interstitial).{0,40}(?:newsletter|subscribe)') AS has_popup,
       """ + holds("cta", "btn", "button", "add-to-cart", "buy-now") + r""" AND regexp_like(html, r'(?i)\bclass\s*=\s*[\x22\x27][^\x22\x27]*\b(?:cta|btn|button|add-to-cart|buy-now)\b') AS has_cta_class, """ + holds("add to cart", "add to bag", "add to basket", "addtocart", "data-add-to-cart") + r""" AS has_cart,
       """ + holds("search") + r""" AND regexp_like(html, r'(?i)type=[\x22\x27]search[\x22\x27]|role=[\x22\x27]search[\x22\x27]|action=[\x22\x27][^\x22\x27]*search') AS has_search, """ + holds("application/ld+json") + r""" AND regexp_like(html, r'(?i)type=[\x22\x27]application/ld\+json[\x22\x27]') AS declares_jsonld
FROM (SELECT *, """ + squeezed("seen") + r""" AS visible_text, """ + decoded("raw_title") + r""" AS title, transform(labels, x -> regexp_extract(x, r'(?is)\bfor=[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1)) AS label_ids FROM (
  SELECT *, """ + decoded("bare") + r""" AS seen FROM (SELECT *, lower(html) AS low, array_join(transform(titles, t -> t.body), '') AS raw_title, """ + unmarked("html") + r""" AS bare FROM {page_tags})))
"""
#: Long texts are gone over as few times as can be, and regular expressions begin with a plain character or stand behind a search for a word.
SIGNALS_IN_SPARK = [
    (unmarked("html"), unmarked("html").replace(UNSEEN, UNSEEN_FAST)), (decoded("bare"), decoded_in_parts("bare")), (squeezed("seen"), squeezed_where_needed("seen")),
    (r"regexp_extract_all(html, r'\b(20\d\d-\d\d-\d\d)\b', 1)", r"regexp_extract_all(html, r'2(?<=\b2)0\d\d-\d\d-\d\d\b', 0)"),
    (f"regexp_like(visible_text, r'{CJK}')", "octet_length(visible_text) > length(visible_text) + 1 AND {}"),  # such a letter has three bytes
    (r"(?i)(?:©|copyright)[^\n<]{0,40}", r"(?i)[©c](?:(?<=©)|(?<=c)opyright)[^\n<]{{0,40}}"), (r"regexp_like(html, r'(?i)<nav[\s>]|role=[\x22\x27]navigation[\x22\x27]')", "(contains(low, '<nav>') OR {})"),
    (r"regexp_like(html, r'(?i)<div[^>]+id=", holds("<div") + " AND {}"),
    (r"size(regexp_extract_all(head, r'(?i)<link[^>]+rel=[\x22\x27]stylesheet[\x22\x27]', 0))", "CASE WHEN " + holds("stylesheet") + " THEN {} ELSE 0 END"),
    (r"regexp_extract_all(head, r'(?i)<script\b[^>]*>', 0)", "CASE WHEN " + holds("<script") + " THEN {} ELSE array() END"),
]
relation("page_signals", PAGE_SIGNALS, stored=True, spark=spared(PAGE_SIGNALS, *SIGNALS_IN_SPARK))

# where three characters in a row of a page's address and title stand, for searches (P6)
relation("page_grams", """
SELECT DISTINCT site, url, gram FROM (SELECT site, url, explode(transform(sequence(1, n), i -> substring(t, i, 3))) AS gram FROM (SELECT site, url, t, greatest(1, length(t) - 2) AS n FROM (SELECT site, url, lower(url || ' ' || title) AS t FROM {page_signals})))
DISTRIBUTE BY gram SORT BY gram
""", stored=True)

PAGE_LINKS = r"""
SELECT site, page_ord, url, is_home, pos, href, rel, """ + squeezed("said") + r""" AS text, """ + urls.folded("whole", "h") + r""" AS target, startswith(href, '/') OR startswith(href, '#') OR """ + urls.domain_of("there") + " = " + urls.domain_of("here") + r""" AS is_internal
FROM (SELECT site, page_ord, url, is_home, pos, href, rel, """ + decoded("bare") + r""" AS said, h, """ + urls.joined("h", "url") + r""" AS whole, """ + urls.bare_host("href") + r""" AS there, """ + urls.bare_host("url") + r""" AS here
      FROM (SELECT site, page_ord, url, is_home, pos, href, rel, bare, """ + urls.clean_href("href") + r""" AS h
            FROM (SELECT site, page_ord, url, is_home, pos, """ + decoded("address") + r""" AS href, rel, bare
                  FROM (SELECT site, page_ord, url, is_home, pos, """ + attribute("a.tag", "href") + r""" AS address, """ + attribute("a.tag", "rel") + r""" AS rel, """ + unmarked("a.body") + r""" AS bare FROM (SELECT site, page_ord, url, is_home, posexplode(anchors) AS (pos, a) FROM {page_tags})))))
"""
relation("page_links", PAGE_LINKS, stored=True, spark=spared(PAGE_LINKS, PLAIN_BODY, NO_DOTS))

PAGE_HEADINGS = r"""
SELECT site, page_ord, url, pos, level, """ + squeezed("said") + r""" AS text
FROM (SELECT site, page_ord, url, pos, level, """ + decoded("bare") + r""" AS said FROM (SELECT site, page_ord, url, pos, cast(regexp_extract(h.tag, r'(?i)^<h([1-6])', 1) AS int) AS level, """ + unmarked("h.body") + r""" AS bare FROM (SELECT site, page_ord, url, posexplode(headings) AS (pos, h) FROM {page_tags})))
"""
relation("page_headings", PAGE_HEADINGS, spark=spared(PAGE_HEADINGS, PLAIN_HEADING))

relation("page_images", r"""
SELECT site, page_ord, url, pos, """ + attribute("i", "src") + r""" AS src, CASE WHEN """ + has_attribute("i", "alt") + r""" THEN """ + attribute("i", "alt") + r""" END AS alt
FROM (SELECT site, page_ord, url, posexplode(image_tags) AS (pos, i) FROM {page_tags})
""")

PAGE_HREFLANG = r"""
SELECT site, page_ord, url, pos, code, href, """ + urls.folded("whole", "h") + r""" AS target
FROM (SELECT site, page_ord, url, pos, code, href, h, """ + urls.joined("h", "url") + r""" AS whole
      FROM (SELECT site, page_ord, url, pos, code, href, """ + urls.clean_href("href") + r""" AS h
            FROM (SELECT site, page_ord, url, pos, trim(regexp_extract(t, r'(?i)hreflang=[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1)) AS code, trim(regexp_extract(t, r'(?i)\shref=[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1)) AS href
                  FROM (SELECT site, page_ord, url, posexplode(link_tags) AS (pos, t) FROM {page_tags})
                  WHERE regexp_like(t, r'(?i)\brel=[\x22\x27]?alternate[\x22\x27]?') AND regexp_like(t, r'(?i)hreflang=[\x22\x27][^\x22\x27]+[\x22\x27]') AND regexp_like(t, r'(?i)\shref=[\x22\x27][^\x22\x27]+[\x22\x27]'))))
"""
relation("page_hreflang", PAGE_HREFLANG, stored=True, spark=spared(PAGE_HREFLANG, NO_DOTS))

#: Whether the whole of b is one JSON document: Spark's parser itself stops behind the first one.
ONE_DOCUMENT = "coalesce(json_array_length('[' || b || ']') = 1, false)"

# A block that parses is one document. Of one that doesn't, what stands between `}` and `{` or `[` outside of strings is taken apart, and the parts that parse are objects.
relation("jsonld_blocks", r"""
SELECT site, page_ord, url, is_home, pos, k, b FROM (
  SELECT site, page_ord, url, is_home, pos, posexplode(parts) AS (k, b) FROM (
    SELECT site, page_ord, url, is_home, pos, CASE WHEN """ + ONE_DOCUMENT + r""" THEN array(b)
             ELSE transform(split(replace(replace(array_join(transform(split(replace(replace(b, r'\\', chr(2)), r'\"', chr(3)), '"'), (p, i) -> CASE WHEN i % 2 = 0 THEN regexp_replace(p, r'\}\s*([{\[])', '}' || chr(1) || '$back1$', /*all*/ 1) ELSE p END), '"'), chr(3), r'\"'), chr(2), r'\\'), chr(1)), x -> trim(regexp_extract(x, r'(?s)(\{.*)$', 1))) END AS parts
    FROM (SELECT site, page_ord, url, is_home, pos, trim(regexp_extract(x, r'(?is)^<script\b[^>]*>(.*?)</script\s*>$', 1)) AS b FROM (SELECT site, page_ord, url, is_home, posexplode(script_tags) AS (pos, x) FROM {page_tags}) WHERE """ + IS_JSONLD + r""")))
WHERE """ + ONE_DOCUMENT + r""" AND (startswith(b, '{') AND endswith(b, '}') OR startswith(b, '[') AND endswith(b, ']'))
""", duck=stream.BLOCKS)

relation("jsonld_parts", r"""
SELECT site, page_ord, url, is_home, pos, k, CASE WHEN startswith(trim(b), '[') THEN from_json(b, 'array<string>') WHEN g IS NOT NULL THEN from_json(g, 'array<string>') ELSE array(b) END AS items
FROM (SELECT site, page_ord, url, is_home, pos, k, b, CASE WHEN startswith(trim(b), '{') THEN get_json_object(b, '$.@graph') END AS g FROM {jsonld_blocks})
""")

relation("page_jsonld", r"""
SELECT site, page_ord, url, is_home, row_number() OVER (PARTITION BY site, page_ord ORDER BY pos, k, i) AS node_ord, n AS node, json_object_keys(n) AS keys, lower(coalesce(CASE WHEN startswith(t, '[') THEN get_json_object(n, '$.@type[0]') ELSE t END, '')) AS first_type,
       CASE WHEN t IS NULL THEN array() WHEN startswith(t, '[') THEN from_json(lowered, 'array<string>') ELSE array(lowered) END AS types
FROM (SELECT site, page_ord, url, is_home, pos, k, i, n, get_json_object(n, '$.@type') AS t, lower(get_json_object(n, '$.@type')) AS lowered
      FROM (SELECT site, page_ord, url, is_home, pos, k, posexplode(items) AS (i, n) FROM {jsonld_parts}) WHERE startswith(trim(n), '{'))
""", stored=True)
