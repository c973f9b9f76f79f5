"""The rules (survey 2.5): page facts -> hits by page or site -> findings.

All page-level rules are evaluated in one pass over `page_facts`; each page yields the ids of the rules that it breaks.
Hits are then summed per site and held against the rules' thresholds. Rules that need links, nodes or side tables make hits of
the same shape.
"""

import re

from sightline.functions.urls import bare_host, domain, path
from sightline.operators.extract import spared
from sightline.plans.relations import relation

#: id, severity, confidence, dimension, category, title. Titles decide the order of equal penalties.
CATALOG = [
    ("C1", "critical", "high", "discoverability", "crawlability", "AI answer-engine retrieval crawlers are blocked in robots.txt"),
    ("C2", "low", "high", "discoverability", "crawlability", "AI training crawlers are blocked in robots.txt"),
    ("C3", "critical", "high", "discoverability", "crawlability", "robots.txt disallows all crawlers at the site root"),
    ("C4", "high", "high", "discoverability", "crawlability", "Key pages are disallowed by robots.txt"),
    ("C5", "high", "high", "discoverability", "reachability", "Server errors on sampled pages"),
    ("C6", "high", "high", "discoverability", "indexability", "Pages carry noindex directives"),
    ("C7", "medium", "high", "discoverability", "indexability", "Canonical tags point to a different domain"),
    ("C8", "low", "high", "discoverability", "indexability", "hreflang set without an x-default"),
    ("C9", "low", "high", "discoverability", "indexability", "Invalid hreflang language codes"),
    ("C10", "medium", "medium", "discoverability", "indexability", "hreflang links are not reciprocal"),
    ("C11", "low", "medium", "discoverability", "crawlability", "Internal links are marked rel=nofollow"),
    ("C12", "medium", "high", "discoverability", "reachability", "Broken internal links"),
    ("C13", "high", "medium", "discoverability", "js-render-gap", "Primary content appears to require client-side JavaScript"),
    ("C14", "medium", "medium", "discoverability", "js-render-gap", "Thin server-rendered text relative to page size"),
    ("C15", "medium", "medium", "discoverability", "js-render-gap", "Pages tell users to enable JavaScript"),
    ("C16", "low", "high", "discoverability", "crawlability", "No XML sitemap found"),
    ("D1", "high", "high", "discoverability", "structured-data", "No structured data anywhere in the sampled pages"),
    ("D2", "high", "high", "discoverability", "structured-data", "Invalid JSON-LD (present but unparseable)"),
    ("D3", "medium", "high", "discoverability", "entity-identity", "Homepage lacks Organization/WebSite structured data"),
    ("D4", "high", "high", "discoverability", "structured-data", "Product-like pages missing Product/Offer schema"),
    ("D5", "medium", "high", "discoverability", "structured-data", "Article/blog pages missing Article schema"),
    ("D6", "medium", "high", "discoverability", "structured-data", "Structured-data nodes missing recommended properties"),
    ("D7", "low", "medium", "discoverability", "structured-data", "Structured-data properties present but empty"),
    ("D8", "medium", "high", "discoverability", "entity-identity", "Conflicting Organization identities in structured data"),
    ("E1", "high", "high", "discoverability", "extractability", "Pages missing a <title>"),
    ("E2", "medium", "high", "discoverability", "extractability", "Pages missing a meta description"),
    ("E3", "low", "high", "discoverability", "extractability", "Duplicate <title> tags across pages"),
    ("E4", "low", "medium", "discoverability", "extractability", "Title tags outside the useful length range"),
    ("E5", "low", "medium", "discoverability", "extractability", "Meta descriptions likely to be truncated"),
    ("E6", "medium", "high", "discoverability", "extractability", "Pages missing an H1 heading"),
    ("E7", "low", "medium", "discoverability", "extractability", "Multiple H1 headings on a page"),
    ("E8", "low", "medium", "discoverability", "extractability", "Heading hierarchy skips levels"),
    ("E9", "medium", "high", "discoverability", "extractability", "Many images lack alt text"),
    ("E10", "medium", "medium", "discoverability", "extractability", "Key content may be embedded in images rather than text"),
    ("E11", "low", "high", "discoverability", "extractability", "Page language is not declared"),
    ("E12", "low", "medium", "discoverability", "extractability", "Substantial content offloaded to PDF files"),
    ("F1", "medium", "high", "discoverability", "freshness", "Stale copyright year in footer"),
    ("F2", "low", "medium", "discoverability", "freshness", "Content dates are more than two years old"),
    ("F3", "low", "high", "discoverability", "freshness", "Articles published without a visible date"),
    ("R1", "medium", "high", "discoverability", "corroboration", "Organization schema has no sameAs corroboration links"),
    ("R2", "low", "high", "discoverability", "corroboration", "No links to external brand profiles or authority sources"),
    ("R3", "low", "high", "discoverability", "entity-identity", "Inconsistent brand name across pages"),
    ("R4", "medium", "medium", "discoverability", "entity-identity", "Brand identity signals disagree on the homepage"),
    ("G1", "high", "high", "engagement", "mobile", "No responsive viewport meta tag"),
    ("G2", "medium", "medium", "engagement", "conversion", "Homepage has no clear call-to-action"),
    ("G3", "medium", "high", "engagement", "orientation", "No semantic navigation region"),
    ("G4", "low", "high", "engagement", "orientation", "Dead-end pages with few onward links"),
    ("G5", "medium", "medium", "engagement", "performance", "Heavy pages likely to slow first render"),
    ("G6", "medium", "low", "engagement", "performance", "Slow server response on sampled pages"),
    ("G7", "low", "medium", "engagement", "performance", "Render-blocking resources in the page head"),
    ("G8", "low", "high", "engagement", "readability", "Long content with almost no subheadings"),
    ("G9", "low", "high", "engagement", "orientation", "Deep pages lack breadcrumbs / positional context"),
    ("G10", "low", "low", "engagement", "conversion", "Possible intrusive interstitial / pop-up on load"),
    ("G11", "medium", "low", "engagement", "conversion", "Content appears gated behind a login or registration wall"),
    ("G12", "low", "medium", "engagement", "accessibility", "Links with non-descriptive text"),
    ("G13", "low", "medium", "engagement", "accessibility", "Form controls without an associated label"),
    ("G14", "low", "medium", "engagement", "accessibility", "Iframes without a title attribute"),
    ("H1", "medium", "medium", "discoverability", "entity-identity", "Conflicting founding year across the site"),
    *[(f"H2_{p}", "low", "medium", "discoverability", "entity-identity", f"Conflicting {p} handle across the site") for p in ("twitter", "instagram", "facebook", "linkedin", "youtube", "tiktok", "github")],
    ("H3", "low", "low", "discoverability", "trust-signals", "Unverifiable superlative claims that an AI may repeat as fact"),
    ("I1", "high", "high", "discoverability", "i18n", "Declared region variants are unreachable"),
    ("X1e", "low", "medium", "discoverability", "corroboration", "Knowledge-base entity does not link back to this site"),
    ("X2e", "medium", "medium", "discoverability", "corroboration", "No independent source corroborates the brand"),
    ("X3e", "low", "high", "discoverability", "corroboration", "Declared external profiles are unreachable"),
    ("X4e", "low", "low", "discoverability", "corroboration", "Domain is absent from the open web corpus"),
    ("O1", "critical", "high", "discoverability", "reachability", "The site could not be audited"),
]
#: Crawlers of answer engines, and those that gather training data (fixed values).
RETRIEVAL_BOTS = ["OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "Perplexity-User"]
OTHER_BOTS = ["GPTBot", "ClaudeBot", "Claude-Web", "anthropic-ai", "Google-Extended", "Applebot-Extended", "CCBot", "Bytespider", "cohere-ai", "Meta-ExternalAgent", "Amazonbot"]
#: Properties that a node of a type should have (fixed values).
RECOMMENDED = {
    "organization": ["name", "url"],
    "localbusiness": ["name", "address"],
    "product": ["name", "offers"],
    "offer": ["price", "priceCurrency"],
    "article": ["headline", "datePublished"],
    "blogposting": ["headline", "datePublished"],
    "newsarticle": ["headline", "datePublished"],
    "faqpage": ["mainEntity"],
    "breadcrumblist": ["itemListElement"],
    "person": ["name"],
    "course": ["name", "provider"],
}
#: First path parts of social links that are no handles (fixed values).
NO_HANDLE = [
    "share", "sharer", "shareoffsite", "sharearticle", "sharing", "intent", "home", "hashtag", "search", "explore", "watch", "channel", "user", "c", "p", "reel", "pin", "login", "privacy", "in", "pub", "feed", "posts", "jobs",
    "showcase", "school", "groups", "learning", "pulse", "dialog", "plugins", "embed", "i", "messages", "settings", "notifications", "help", "legal", "about", "tos", "policies", "profile", "results",
]
#: Words of a call to action (fixed values).
CTA_WORDS = ["buy", "shop", "get started", "sign up", "sign-up", "subscribe", "contact", "book", "request", "demo", "start free", "add to cart", "learn more", "download", "try"]
#: Path parts of a call to action, `[-_]?` where a mark may stand, and address schemes of one (fixed values).
CTA_PATHS = [
    "cart", "checkout", "contact", "sign[-_]?up", "signup", "log[-_]?in", "register", "buy", "order", "subscribe", "book", "booking", "demo", "pricing", "price", "get[-_]?started", "quote", "apply", "appointment", "donate", "shop", "store",
    "enquir", "inquir", "reserve", "join",
]
CTA_SCHEMES = ["tel:", "mailto:", r"https?://wa\.me/"]
#: Names in the hosts of brand profiles and authorities (fixed values).
PROFILE_NAMES = ["facebook", "twitter", r"x\.com", "linkedin", "instagram", "youtube", "tiktok", "github", "wikipedia", "wikidata", "crunchbase", r"g\.page", r"maps\.google", "yelp"]
#: Platforms of social handles (fixed values).
PLATFORMS = ["twitter", "x", "instagram", "facebook", "linkedin", "youtube", "tiktok", "github"]

CTA = rf"(?i)\b(?:{'|'.join(CTA_WORDS)})\b"
CTA_HREF = rf"(?i)(?:^|/)(?:{'|'.join(CTA_PATHS)})(?:/|$|\?)|^(?:{'|'.join(CTA_SCHEMES)})"
PROFILE_SITES = rf"(?i)(?:{'|'.join(PROFILE_NAMES)})\."
HANDLE = rf"(?i)(?:^|[/.])({'|'.join(PLATFORMS)})\.com/(?:company/|@)?([A-Za-z0-9_.-]{{2,40}})"
IDENTITY_URL = r"(?i)/(?:about|company|who-we-are)"
FOUNDED = r"(?i)\b(?:founded|established|est\.?|incorporated)\b[^.\d]{0,15}((?:19|20)\d\d)"
#: What a boast looks like (fixed value).
SUPERLATIVE = r"(?i)\b(?:world\x27?s?\s+)?(?:#\s?1|no\.?\s?1|number\s+one)\b|\bworld\x27?s?\s+(?:best|leading|largest|first|foremost|top|biggest)\b|\b(?:the\s+)?(?:best|leading|largest|top|biggest)\s+(?:\w+\s+){0,2}(?:company|brand|provider|platform|solution|manufacturer|retailer|marketplace|agency)\b|\b(?:market|industry|global)\s+leader\b|\bmost\s+trusted\b|\bfastest[-\s]growing\b"


def values(rows, columns: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: 30 characters on either side of a boast.
SQUEEZED_CONTEXT = r"trim(regexp_replace(substring(visible_text, greatest(1, place - 30), place - greatest(1, place - 30) + length(claim) + 30), r'\s+', ' ', /*all*/ 1))"

relation("check_catalog", values(CATALOG, "check_id, severity, confidence, dimension, category, title"))
relation("bots", values([(b.lower(), "C1") for b in RETRIEVAL_BOTS] + [(b.lower(), "C2") for b in OTHER_BOTS] + [("*", "C3")], "agent, check_id"))
relation("recommended", values([(t, p) for t, ps in RECOMMENDED.items() for p in ps], "type, property"))

relation("page_types", r"""
SELECT site, page_ord, count(*) AS n_nodes, bool_or(array_contains(types, 'product')) AS t_product, bool_or(arrays_overlap(types, array('article', 'blogposting', 'newsarticle'))) AS t_article,
       bool_or(arrays_overlap(types, array('organization', 'localbusiness'))) AS t_org, bool_or(arrays_overlap(types, array('organization', 'website', 'localbusiness'))) AS t_identity,
       bool_or(array_contains(types, 'person')) AS t_person, bool_or(array_contains(types, 'faqpage')) AS t_faq, bool_or(array_contains(types, 'breadcrumblist')) AS t_breadcrumb,
       bool_or(contains(lower(node), 'datepublished')) AS dated, bool_or(contains(lower(node), 'searchaction')) AS t_search, bool_or(array_contains(keys, 'author')) AS has_author,
       bool_or(array_contains(keys, 'aggregateRating') OR array_contains(keys, 'review')) AS has_rating, bool_or(array_contains(keys, 'sameAs')) AS has_sameas
FROM {page_jsonld} GROUP BY site, page_ord
""")

relation("page_link_counts", r"""
SELECT site, page_ord, count_if(is_internal) AS n_internal, count_if(NOT is_internal AND startswith(href, 'http')) AS n_external, count_if(endswith(lower(href), '.pdf')) AS n_pdf,
       count_if(regexp_like(text, r'(?i)^\s*(?:click here|read more|learn more|more|here|link|this|details)\s*$')) AS n_generic, count_if(is_internal AND contains(lower(rel), 'nofollow')) AS n_nofollow,
       bool_or(regexp_like(text, r'""" + CTA + r"""')) AS cta_text, bool_or(regexp_like(href, r'""" + CTA_HREF + r"""')) AS cta_href, bool_or(regexp_like(href, r'""" + PROFILE_SITES + r"""')) AS profile_link
FROM {page_links} GROUP BY site, page_ord
""")

relation("page_jumps", r"""
SELECT site, page_ord FROM (SELECT site, page_ord, level - lag(level) OVER (PARTITION BY site, page_ord ORDER BY pos) AS jump, count(*) OVER (PARTITION BY site, page_ord) AS n FROM {page_headings})
WHERE jump >= 2 AND n >= 3 GROUP BY site, page_ord
""")

FACTS = r"""
SELECT p.*, coalesce(t.n_nodes, 0) AS n_nodes, coalesce(t.t_product, false) AS t_product, coalesce(t.t_article, false) AS t_article, coalesce(t.t_org, false) AS t_org, coalesce(t.t_identity, false) AS t_identity,
       coalesce(t.t_person, false) AS t_person, coalesce(t.t_faq, false) AS t_faq, coalesce(t.t_breadcrumb, false) AS t_breadcrumb, coalesce(t.dated, false) AS dated, coalesce(t.t_search, false) AS t_search,
       coalesce(t.has_author, false) AS has_author, coalesce(t.has_rating, false) AS has_rating, coalesce(t.has_sameas, false) AS has_sameas, coalesce(l.n_internal, 0) AS n_internal, coalesce(l.n_external, 0) AS n_external,
       coalesce(l.n_pdf, 0) AS n_pdf, coalesce(l.n_generic, 0) AS n_generic, coalesce(l.n_nofollow, 0) AS n_nofollow, coalesce(l.cta_text, false) AS cta_text, coalesce(l.cta_href, false) AS cta_href, coalesce(l.profile_link, false) AS profile_link,
       j.site IS NOT NULL AS jumps, r.status, r.elapsed_ms, r.raw_len, coalesce(r.x_robots, '') AS x_robots, coalesce(r.error, '') AS error,
       array_max(filter(transform(date_texts, x -> try_cast(x AS date)), x -> x IS NOT NULL)) AS newest_date,
       array_max(transform(regexp_extract_all(array_join(copyright_spans, ' '), r'\b((?:19|20)\d\d)\b', 1), x -> cast(x AS int))) AS copyright_year, """ + path("p.url") + r""" AS path, """ + domain("p.canonical") + r""" AS canonical_domain, """ + domain("p.url") + r""" AS own_domain
FROM {page_signals} p LEFT JOIN {page_types} t ON p.site = t.site AND p.page_ord = t.page_ord LEFT JOIN {page_link_counts} l ON p.site = l.site AND p.page_ord = l.page_ord
LEFT JOIN {page_jumps} j ON p.site = j.site AND p.page_ord = j.page_ord LEFT JOIN {response_of} r ON p.url = r.url
"""
# In Spark, the narrow tables meet by page and address first, so that pages with their texts are moved once.
NARROW = r"""(SELECT s.site, s.page_ord, t.* EXCEPT (site, page_ord), l.* EXCEPT (site, page_ord), j.site AS jump, r.* EXCEPT (url) FROM {site_pages} s LEFT JOIN {page_types} t ON s.site = t.site AND s.page_ord = t.page_ord
LEFT JOIN {page_link_counts} l ON s.site = l.site AND s.page_ord = l.page_ord LEFT JOIN {page_jumps} j ON s.site = j.site AND s.page_ord = j.page_ord LEFT JOIN {response_of} r ON s.url = r.url)"""
relation("page_facts", FACTS, stored=True, spark=re.sub(r"(?<![\w.])[tlr]\.", "n.", FACTS.split("FROM {page_signals} p")[0].replace("j.site", "n.jump")) + "FROM {page_signals} p LEFT JOIN " + NARROW + " n ON p.site = n.site AND p.page_ord = n.page_ord")

RECENT = "(contains(visible_text, cast(year($as_of$) AS string)) OR contains(visible_text, cast(year($as_of$) - 1 AS string)) OR coalesce(datediff($as_of$, newest_date) < $recent_signal_days$, false))"
HEAVY_SCRIPT = "(inline_script_len + 200 * n_scripts > $render_script_ratio$ * greatest(text_len, 1))"
SHELL = f"(word_count < $render_spa_max_words$ AND (spa_marker IS NOT NULL OR {HEAVY_SCRIPT}))"
#: Rules that hold of one page, or how many of its parts break them.
PAGE_RULES = {
    "C4": "error = 'blocked_by_robots'",
    "C5": "coalesce(status >= 500, false)",
    "C6": "contains(lower(meta_robots), 'noindex') OR contains(lower(x_robots), 'noindex')",
    "C7": "canonical_domain <> '' AND canonical_domain <> own_domain",
    "C13": f"{SHELL} AND (spa_marker IS NOT NULL OR word_count < $render_spa_hard_max_words$)",
    "C14": f"NOT {SHELL} AND word_count < $render_thin_words$ AND html_len > $render_thin_html$",
    "C15": "asks_for_js",
    "D2": "declares_jsonld AND n_nodes = 0",
    "D4": r"NOT t_product AND (regexp_like(path, r'(?i)/(?:product|products|shop|store|item|items|dp|p)(?:/|$)') OR has_cart AND regexp_like(visible_text, r'(?i)[$€£₹]\s?\d|\bUSD\b|\bINR\b|priceCurrency'))",
    "D5": r"NOT t_article AND (regexp_like(path, r'(?i)/(?:blog|article|articles|news|post|posts)(?:/|$)') OR regexp_like(left(visible_text, 400), r'(?i)\bmin read\b|\bposted on\b|\bpublished (?:on|in)\b'))",
    "E1": "trim(title) = ''",
    "E2": "trim(description) = ''",
    "E4": "trim(title) <> '' AND NOT (length(trim(title)) BETWEEN 15 AND 65)",
    "E5": "length(trim(description)) > 160",
    "E6": "n_h1 = 0",
    "E7": "n_h1 > 1",
    "E8": "jumps",
    "E10": "n_images >= $text_in_image_min_images$ AND word_count < $text_in_image_max_words$ AND html_len > $text_in_image_min_html$",
    "F1": f"coalesce(copyright_year < year($as_of$) - 1, false) AND NOT {RECENT}",
    "F2": f"coalesce(datediff($as_of$, newest_date) > $stale_days$, false) AND NOT {RECENT}",
    "F3": r"(regexp_like(url, r'/blog/|/news/|/article/') OR regexp_like(left(visible_text, 300), r'(?i)min read')) AND newest_date IS NULL AND NOT dated",
    "G1": "trim(viewport) = ''",
    "G4": "n_internal < $deadend_min_links$",
    "G5": "coalesce(raw_len, html_bytes) > $page_weight_bytes$ OR n_scripts > $page_weight_scripts$",
    "G6": "coalesce(elapsed_ms > $slow_ms$, false)",
    "G7": "head_css + head_js > $render_blocking_head_max$",
    "G8": "word_count > $wall_words$ AND n_headings <= $wall_max_headings$",
    "G10": "has_popup",
    "G11": r"regexp_like(left(visible_text, 800), r'(?i)(?:sign ?in|log ?in|register|create an account|subscribe)\s+(?:to|and)\s+(?:continue|read|view|access|see|unlock)|members only|subscribers only')",
}


def one_of(rules: dict[str, tuple[str, str]]) -> str:
    """The hits (check_id, n) of one row or group: `rules` has what is counted, and when it is a hit."""
    return "filter(array(" + ", ".join(f"CASE WHEN {rule} THEN named_struct('check_id', '{k}', 'n', {n}) END" for k, (n, rule) in rules.items()) + "), x -> x IS NOT NULL)"


COUNTED = {"E9": "n_images_no_alt", "G12": "n_generic", "G13": "n_unlabeled", "G14": "n_untitled_iframes"}

RULE_HITS = ("SELECT site, page_ord, url, check_id, cast(1 AS bigint) AS n FROM (SELECT site, page_ord, url, explode(filter(array("
             + ", ".join(f"CASE WHEN {rule} THEN '{k}' END" for k, rule in PAGE_RULES.items()) + "), x -> x IS NOT NULL)) AS check_id FROM {page_facts})")


def begins(*words: str) -> str:
    """A condition for `spared`: one of the words stands among the first 800 characters of the page's text."""
    return "(" + " OR ".join(f"contains(start, '{w}')" for w in words) + ") AND {}"


#: In Spark, patterns of what a text begins with stand behind a plain search for one of their words.
RULES_IN_SPARK = [
    (r"regexp_like(left(visible_text, 400), r'(?i)\bmin read\b|\bposted on\b|\bpublished (?:on|in)\b')", begins("min read", "posted on", "published ")), (r"regexp_like(left(visible_text, 300), r'(?i)min read')", begins("min read")),
    (PAGE_RULES["G11"], begins("signin", "sign in", "login", "log in", "register", "create an account", "subscribe", "members only")), ("FROM {page_facts}", "FROM (SELECT *, lower(left(visible_text, 800)) AS start {})"),
]
relation("page_rule_hits", RULE_HITS, spark=spared(RULE_HITS, *RULES_IN_SPARK))

# in Spark, pages are read once for all that is counted, and once for all rules of a site or a home page (below)
relation("page_count_hits", " UNION ALL ".join(f"SELECT site, page_ord, url, '{k}' AS check_id, cast({n} AS bigint) AS n FROM {{page_facts}} WHERE {n} > 0" for k, n in COUNTED.items()),
         spark="SELECT site, page_ord, url, h.check_id, h.n FROM (SELECT site, page_ord, url, explode(" + one_of({k: (f"cast({n} AS bigint)", f"{n} > 0") for k, n in COUNTED.items()}) + ") AS h FROM {page_facts})")

relation("hreflang_hits", r"""
SELECT site, page_ord, url, 'C8' AS check_id, cast(1 AS bigint) AS n FROM {page_hreflang} GROUP BY site, page_ord, url HAVING NOT bool_or(lower(code) = 'x-default')
UNION ALL
SELECT site, page_ord, url, 'C9', count(*) FROM {page_hreflang} WHERE lower(code) <> 'x-default' AND NOT regexp_like(code, r'(?i)^[a-z]{2,3}(?:-[a-z]{4})?(?:-[a-z]{2}|-\d{3})?$') GROUP BY site, page_ord, url
UNION ALL
SELECT a.site, a.page_ord, a.url, 'C10', count(*) FROM (SELECT * FROM {page_hreflang} WHERE lower(code) <> 'x-default') a
JOIN (SELECT DISTINCT site, url FROM {page_hreflang}) b ON a.site = b.site AND a.target = b.url
LEFT JOIN (SELECT DISTINCT site, url, target FROM {page_hreflang}) c ON a.site = c.site AND a.target = c.url AND a.url = c.target
WHERE c.site IS NULL GROUP BY a.site, a.page_ord, a.url
""")

relation("node_hits", r"""
SELECT site, page_ord, url, 'D6' AS check_id, count(DISTINCT node_ord) AS n FROM {page_jsonld} d JOIN {recommended} r ON d.first_type = r.type WHERE NOT array_contains(d.keys, r.property) GROUP BY site, page_ord, url
UNION ALL
SELECT site, page_ord, url, 'D7', count(*) FROM (
  SELECT d.site, d.page_ord, d.url, CASE r.property WHEN 'name' THEN get_json_object(node, '$.name') WHEN 'url' THEN get_json_object(node, '$.url') WHEN 'address' THEN get_json_object(node, '$.address') WHEN 'offers' THEN get_json_object(node, '$.offers')
    WHEN 'price' THEN get_json_object(node, '$.price') WHEN 'priceCurrency' THEN get_json_object(node, '$.priceCurrency') WHEN 'headline' THEN get_json_object(node, '$.headline') WHEN 'datePublished' THEN get_json_object(node, '$.datePublished')
    WHEN 'mainEntity' THEN get_json_object(node, '$.mainEntity') WHEN 'itemListElement' THEN get_json_object(node, '$.itemListElement') WHEN 'provider' THEN get_json_object(node, '$.provider') END AS v
  FROM {page_jsonld} d JOIN {recommended} r ON d.first_type = r.type WHERE array_contains(d.keys, r.property))
WHERE v IS NULL OR lower(trim(v)) IN ('', 'n/a', 'tbd', 'todo', '-', '[]', '{}') GROUP BY site, page_ord, url
""")

relation("broken_links", r"""
SELECT c.site, c.target, s.status FROM (
  SELECT l.site, l.target, row_number() OVER (PARTITION BY l.site ORDER BY l.target) AS k FROM (SELECT DISTINCT site, target FROM (SELECT site, target, is_home, """ + bare_host("url") + r""" AS own_host FROM {page_links}) WHERE is_home AND target IS NOT NULL AND NOT regexp_like(lower(target), r'\.(?:png|jpe?g|gif|svg|webp|ico|css|js|json|xml|pdf|zip|gz|mp4|mp3|woff2?|ttf|eot)$')
    AND """ + "regexp_replace(regexp_replace(lower(regexp_extract(target, r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), r':.*$', ''), r'^www\\.', '')" + r""" = own_host) l
  LEFT JOIN (SELECT DISTINCT url FROM {site_pages}) p ON l.target = p.url WHERE p.url IS NULL) c
JOIN {link_status} s ON c.target = s.url WHERE c.k <= 6 AND (s.status IN (404, 410) OR s.status >= 500) AND s.status < 600
""")

relation("robots_rules", r"""
SELECT site, agent, field, value FROM (
  SELECT a.site, a.value AS agent, r.field, r.value FROM (SELECT site, grp, lower(value) AS value FROM {robots_lines} WHERE field = 'user-agent') a JOIN (SELECT site, grp, field, value FROM {robots_lines} WHERE field <> 'user-agent') r ON a.site = r.site AND a.grp = r.grp)
""")
relation("robots_lines", r"""
SELECT site, pos, field, value, sum(CASE WHEN field = 'user-agent' AND coalesce(before, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY pos) AS grp
FROM (SELECT site, pos, field, value, lag(field) OVER (PARTITION BY site ORDER BY pos) AS before
      FROM (SELECT site, pos, lower(trim(regexp_extract(line, r'^([^:]*):', 1))) AS field, trim(regexp_extract(line, r'^[^:]*:(.*)$', 1)) AS value
            FROM (SELECT site, pos, trim(regexp_replace(line, r'#.*$', '')) AS line FROM (SELECT site, posexplode(lines) AS (pos, line) FROM (SELECT site, split(body, '\n') AS lines FROM {robots}))) WHERE contains(line, ':'))
      WHERE field IN ('user-agent', 'allow', 'disallow'))
""", stored=True)

relation("site_totals", r"""
SELECT site, count(*) AS n_pages, min_by(url, page_ord) AS home_url, sum(n_images) AS n_images, count_if(newest_date IS NOT NULL OR copyright_year IS NOT NULL OR dated OR regexp_like(visible_text, r'(?i)(?:last\s+updated|updated on|last\s+modified)[:\s]+[A-Za-z0-9 ,/-]{6,20}')) AS n_dated
FROM {page_facts} GROUP BY site
""", kept=True)

# where each value of a fact about the brand stands: in texts of identity pages first, then in structured data
relation("fact_sources", r"""
SELECT site, kind, value, page_ord, url, row_number() OVER (PARTITION BY site, kind, value ORDER BY part, page_ord, pos) AS k FROM (
  SELECT site, kind, value, 0 AS part, page_ord, pos, url FROM (SELECT site, page_ord, url, 'year' AS kind, posexplode(years) AS (pos, value) FROM (SELECT site, page_ord, url, regexp_extract_all(visible_text, r'""" + FOUNDED + r"""', 1) AS years FROM {page_facts} WHERE is_home OR regexp_like(url, r'""" + IDENTITY_URL + r"""')))
  UNION ALL SELECT site, 'year', regexp_extract(get_json_object(node, '$.foundingDate'), r'^((?:19|20)\d\d)', 1), 1, page_ord, node_ord, url FROM {page_jsonld} WHERE regexp_like(coalesce(get_json_object(node, '$.foundingDate'), ''), r'^(?:19|20)\d\d')
  UNION ALL SELECT site, platform, handle, 0, page_ord, pos, url FROM {social_handles})
""", stored=True)
relation("identity_facts", "SELECT site, kind, value, min_by(url, page_ord) AS example, count(*) AS n FROM {fact_sources} GROUP BY site, kind, value")
relation("social_handles", r"""
SELECT site, page_ord, url, pos, CASE WHEN p = 'x' THEN 'twitter' ELSE p END AS platform, handle
FROM (SELECT site, page_ord, url, pos, lower(regexp_extract(href, r'""" + HANDLE + r"""', 1)) AS p, lower(regexp_extract(href, r'""" + HANDLE + r"""', 2)) AS handle FROM {page_links})
WHERE p <> '' AND length(handle) >= 2 AND handle NOT IN (""" + quoted(NO_HANDLE) + r""")
""")
relation("fact_conflicts", r"""
SELECT site, CASE WHEN kind = 'year' THEN 'founding_year' ELSE 'social_' || kind END AS fact, CASE WHEN kind = 'year' THEN 'medium' ELSE 'low' END AS severity, count(*) AS n_values, min(value) AS first_value, max(value) AS last_value
FROM {identity_facts} GROUP BY site, kind HAVING count(*) > 1
""")
# a finding for each fact that has several values; its pages are the first three of each value, in the order of values (H1, H2)
relation("conflict_hits", r"""
SELECT f.site, CASE WHEN f.kind = 'year' THEN 'H1' ELSE 'H2_' || f.kind END AS check_id, max(c.n_values) AS n, count(*) AS n_affected, min_by(f.url, f.place) AS example, listagg(url, ' | ') WITHIN GROUP (ORDER BY place) AS affected
FROM (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY value, k) AS place FROM {fact_sources} WHERE k <= 3) f
JOIN (SELECT site, CASE WHEN fact = 'founding_year' THEN 'year' ELSE substring(fact, 8) END AS kind, n_values FROM {fact_conflicts}) c ON f.site = c.site AND f.kind = c.kind WHERE f.place <= 10 GROUP BY f.site, f.kind
""")
relation("superlatives", r"""
SELECT site, page_ord, url, k, claim, """ + SQUEEZED_CONTEXT + r""" AS context FROM (
  SELECT site, page_ord, url, claim, visible_text, instr(visible_text, claim) AS place, row_number() OVER (PARTITION BY site ORDER BY page_ord, pos) AS k FROM (
    SELECT site, page_ord, url, pos, claim, visible_text, row_number() OVER (PARTITION BY site, lower(claim) ORDER BY page_ord, pos) AS seen FROM (
      SELECT site, page_ord, url, visible_text, posexplode(claims) AS (pos, claim) FROM (SELECT site, page_ord, url, visible_text, regexp_extract_all(visible_text, r'""" + SUPERLATIVE + r"""', 0) AS claims FROM {page_facts} WHERE is_home OR regexp_like(url, r'(?i)/(?:about|company|who-we-are|our-story)'))))
  WHERE seen = 1)
WHERE k <= 6
""")
relation("boast_hits", r"""SELECT site, 'H3' AS check_id, count(*) AS n, count(*) AS n_affected, min_by(url, k) AS example, listagg(url, ' | ') WITHIN GROUP (ORDER BY k) AS affected FROM {superlatives} GROUP BY site""")

relation("site_names", r"""
SELECT site, page_ord, is_home, lower(trim(site_name)) AS name, lang FROM {page_facts} WHERE trim(site_name) <> ''
""")
relation("name_tokens", r"""
SELECT DISTINCT n.site, n.name, t FROM (SELECT site, name, explode(filter(split(name, r'[^\p{L}\p{N}_]+'), x -> length(x) >= 3)) AS t FROM {like_names}) n
""", stored=True)
relation("like_names", r"""
SELECT DISTINCT n.site, n.name FROM {site_names} n JOIN (SELECT site, lower(regexp_replace(lang, r'-.*$', '')) AS base FROM {page_facts} WHERE is_home) h ON n.site = h.site
WHERE (h.base = '' OR n.lang = '' OR lower(regexp_replace(n.lang, r'-.*$', '')) = h.base) AND regexp_like(n.name, r'^[\x00-\x7F]*$')
""")
relation("home_schema_name", r"""
SELECT site, min_by(lower(trim(get_json_object(node, '$.name'))), node_ord) AS name FROM {page_jsonld}
WHERE is_home AND arrays_overlap(types, array('organization', 'website', 'localbusiness')) AND coalesce(get_json_object(node, '$.name'), '') <> '' GROUP BY site
""")

#: Rules of all pages of a site together, and of home pages: what is counted, and when it is a hit.
SITE_RULES = {
    "D1": ("count(*)", "NOT bool_or(n_nodes > 0 OR has_microdata OR has_rdfa)"),
    "E11": ("count(*)", "bool_and(trim(lang) = '')"),
    "R1": ("cast(1 AS bigint)", "bool_or(t_org) AND NOT bool_or(has_sameas)"),
    "R2": ("cast(1 AS bigint)", "NOT bool_or(profile_link)"),
    "G3": ("count(*)", "NOT bool_or(has_nav)"),
}
HOME_RULES = {
    "C11": ("cast(n_nofollow AS bigint)", "n_internal >= 5 AND n_nofollow >= greatest(3, floor(0.3 * n_internal))"),
    "D3": ("cast(1 AS bigint)", "NOT t_identity"),
    "G2": ("cast(n_links AS bigint)", f"NOT (cta_text OR cta_href OR has_cta_class OR regexp_like(button_text, r'{CTA}'))"),
}


def of_site(k: str) -> str:
    return f"UNION ALL SELECT site, '{k}', {SITE_RULES[k][0]} FROM {{page_facts}} GROUP BY site HAVING {SITE_RULES[k][1]}\n"


def of_home(k: str) -> str:
    return f"UNION ALL SELECT site, '{k}', {HOME_RULES[k][0]} FROM {{page_facts}} WHERE is_home AND {HOME_RULES[k][1]}\n"


SITE_RULE_HITS = r"""
SELECT r.site, b.check_id, count(*) AS n FROM (
  SELECT site, agent FROM {robots_rules} GROUP BY site, agent HAVING bool_or(field = 'disallow' AND value = '/') AND NOT bool_or(field = 'allow' AND value = '/')) r
JOIN {bots} b ON r.agent = b.agent JOIN {site_totals} t ON r.site = t.site GROUP BY r.site, b.check_id
""" + of_home("C11") + r"""UNION ALL SELECT site, 'C12', count(*) FROM {broken_links} GROUP BY site
UNION ALL SELECT t.site, 'C16', cast(1 AS bigint) FROM {site_totals} t LEFT JOIN {sitemaps} m ON t.site = m.site LEFT JOIN {robots} r ON t.site = r.site WHERE m.site IS NULL AND NOT contains(lower(coalesce(r.body, '')), 'sitemap:')
""" + of_site("D1") + of_home("D3") + r"""UNION ALL SELECT site, 'D8', count(*) FROM {page_jsonld} WHERE is_home AND first_type IN ('organization', 'localbusiness') AND coalesce(trim(get_json_object(node, '$.name')), '') <> '' GROUP BY site HAVING count(*) > 1 AND count(DISTINCT lower(trim(get_json_object(node, '$.name')))) > 1
UNION ALL SELECT site, 'E3', count(*) FROM (SELECT site, trim(title) AS t FROM {page_facts} WHERE trim(title) <> '' GROUP BY site, trim(title) HAVING count(*) > 1) GROUP BY site
""" + of_site("E11") + r"""UNION ALL SELECT site, 'E12', count(DISTINCT href) FROM {page_links} WHERE endswith(lower(href), '.pdf') GROUP BY site HAVING count(DISTINCT href) >= $pdf_link_min$
""" + of_site("R1") + of_site("R2") + r"""UNION ALL SELECT n.site, 'R3', max(n.k) FROM (SELECT site, count(*) AS k FROM {like_names} GROUP BY site HAVING count(*) > 1) n LEFT JOIN (SELECT site, t, count(*) AS k FROM {name_tokens} GROUP BY site, t) s ON n.site = s.site AND n.k = s.k GROUP BY n.site HAVING max(s.t) IS NULL
UNION ALL SELECT a.site, 'R4', cast(1 AS bigint) FROM {site_names} a JOIN {home_schema_name} b ON a.site = b.site
  WHERE a.is_home AND NOT arrays_overlap(filter(split(a.name, r'[^\p{L}\p{N}_]+'), x -> length(x) >= 3), filter(split(b.name, r'[^\p{L}\p{N}_]+'), x -> length(x) >= 3))
""" + of_home("G2") + of_site("G3") + r"""UNION ALL SELECT site, 'G9', count(*) FROM {page_facts} WHERE is_deep GROUP BY site HAVING count(*) >= $deep_min_pages$ AND NOT bool_or(has_breadcrumb)
UNION ALL SELECT site, 'I1', count(*) FROM {region_variants} WHERE is_dead GROUP BY site
UNION ALL SELECT site, check_id, n FROM {external_hits}
UNION ALL SELECT t.site, 'O1', cast(1 AS bigint) FROM {targets} t LEFT JOIN {site_totals} p ON t.site = p.site WHERE p.site IS NULL
"""
TOGETHER = f"""UNION ALL SELECT site, h.check_id, h.n FROM (SELECT site, explode(hits) AS h FROM (SELECT site, {one_of(SITE_RULES)} AS hits FROM {{page_facts}} GROUP BY site))
UNION ALL SELECT site, h.check_id, h.n FROM (SELECT site, explode({one_of(HOME_RULES)}) AS h FROM {{page_facts}} WHERE is_home)
"""
APART = [(of_site(k), "") for k in SITE_RULES] + [(of_home(k), "") for k in HOME_RULES if k != "C11"]
relation("site_rule_hits", SITE_RULE_HITS, spark=spared(SITE_RULE_HITS, *APART, (of_home("C11"), TOGETHER.replace("{", "{{").replace("}", "}}"))))

relation("targets", r"""SELECT DISTINCT 'brand' || s_suppkey || '.example.org' AS site FROM {supplier} UNION SELECT 'unseen.example.org' AS site FROM {region}""")

relation("check_hits", r"""
SELECT h.site, h.check_id, h.n, h.n_affected, h.example, h.affected FROM (
  SELECT site, check_id, sum(n) AS n, count(*) AS n_affected, min_by(url, page_ord) AS example, listagg(first_url, ' | ') WITHIN GROUP (ORDER BY page_ord) AS affected
  FROM (SELECT site, check_id, page_ord, url, n, CASE WHEN row_number() OVER (PARTITION BY site, check_id ORDER BY page_ord) <= 10 THEN url END AS first_url
        FROM (SELECT * FROM {page_rule_hits} UNION ALL SELECT * FROM {page_count_hits} UNION ALL SELECT * FROM {hreflang_hits} UNION ALL SELECT * FROM {node_hits}))
  GROUP BY site, check_id) h JOIN {site_totals} t ON h.site = t.site
WHERE CASE h.check_id WHEN 'G1' THEN h.n >= greatest(1, floor(t.n_pages * $viewport_min_fraction$)) WHEN 'G11' THEN h.n >= $login_wall_min_pages$ WHEN 'G12' THEN h.n >= $generic_link_min$ WHEN 'G13' THEN h.n >= $unlabeled_controls_min$
      WHEN 'E9' THEN h.n >= $alt_missing_min$ AND cast(h.n AS double) / t.n_images > $alt_missing_ratio$ ELSE true END
UNION ALL SELECT site, check_id, n, cast(0 AS bigint), cast(NULL AS string), cast(NULL AS string) FROM {site_rule_hits}
UNION ALL SELECT * FROM {conflict_hits} UNION ALL SELECT * FROM {boast_hits}
""", stored=True)
