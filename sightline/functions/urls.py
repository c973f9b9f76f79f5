"""URL scalars as SQL expressions over a column (survey U1-U12)."""

from __future__ import annotations

#: Public suffixes of two labels (fixed values).
TWO_LABEL_SUFFIXES = "co.uk org.uk ac.uk gov.uk co.in net.in org.in gov.in co.jp com.au com.br co.nz com.sg co.za".split()
#: Page types that carry brand facts, in the order in which they are sampled (fixed values).
PAGE_TYPES = [
    "(about|about-us|company|who-we-are|our-story|team)", "(contact|contact-us|support|help)", "(product|products|shop|store|collections?|catalog(ue)?)",
    "(pricing|plans|price)", "(service|services|solutions?|offerings?)", "(faq|faqs|questions)",
]
ASSET = r"\.(png|jpe?g|gif|svg|webp|ico|css|js|json|xml|pdf|zip|gz|mp4|mp3|woff2?|ttf|eot)$"


def netloc(url: str) -> str:
    return rf"lower(regexp_extract({url}, r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def host(url: str) -> str:
    """Without a leading www., port kept."""
    return rf"regexp_replace({netloc(url)}, r'^www\.', '')"


def bare_host(url: str) -> str:
    """Without www. and port."""
    return rf"regexp_replace(regexp_replace({netloc(url)}, r':.*$', ''), r'^www\.', '')"


def domain_of(h: str) -> str:
    """The registrable domain of a bare host: the last two labels, or three below a suffix of two."""
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    last = lambda n: rf"regexp_extract({h}, r'([^.]+{r'\.[^.]+' * (n - 1)})$', 1)"
    return f"CASE WHEN {last(2)} = '' THEN {h} WHEN {last(2)} IN ({two}) AND {last(3)} <> '' THEN {last(3)} ELSE {last(2)} END"


def domain(url: str) -> str:
    return domain_of(bare_host(url))


def path(url: str) -> str:
    return rf"regexp_extract({url}, r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def after_scheme(url: str) -> str:
    """What follows http:// or https://, else NULL. With the next three, for Spark: host and path by plain searches, a regular expression for other schemes alone."""
    return f"CASE WHEN startswith({url}, 'https://') THEN substring({url}, 9) WHEN startswith({url}, 'http://') THEN substring({url}, 8) END"


def plain_netloc(url: str, rest: str) -> str:
    """As `netloc`, but not yet in lower case; `rest` is `after_scheme` of the address."""
    return f"CASE WHEN {rest} IS NULL THEN {netloc(url).removeprefix('lower(').removesuffix(')')} ELSE substring_index(substring_index(substring_index({rest}, '/', 1), '?', 1), '#', 1) END"


def plain_path(url: str, rest: str, n: str) -> str:
    return f"CASE WHEN {rest} IS NULL THEN {path(url)} ELSE substring_index(substring_index(substring({rest}, length({n}) + 1), '?', 1), '#', 1) END"


def is_asset(url: str) -> str:
    """Whether the path ends as `ASSET` says; it is taken from those addresses alone that hold such an ending."""
    return rf"(regexp_like(lower({url}), r'{ASSET.removesuffix('$')}(?:\W|$)') AND regexp_like(lower({path(url)}), r'{ASSET}'))"


def plain_page_type_rank(url: str) -> str:
    """As `page_type_rank`: most addresses have none of the types and are looked through once."""
    return f"CASE WHEN NOT regexp_like({url}, r'(?i)/(?:{'|'.join(PAGE_TYPES)})(/|$|\\?)') THEN {len(PAGE_TYPES)} ELSE {page_type_rank(url)} END"


def page_type_rank(url: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_like({url}, r'(?i)/{p}(/|$|\\?)') THEN {i}" for i, p in enumerate(PAGE_TYPES)) + f" ELSE {len(PAGE_TYPES)} END"


def is_deep(url: str) -> str:
    bare = f"regexp_replace({url}, r'/+$', '')"
    return f"length({bare}) - length(replace({bare}, '/', '')) > $deep_path_segments$"


def section(url: str) -> str:
    return rf"'/' || regexp_extract({path(url)}, r'^/*([^/]*)', 1)"


def locale(url: str) -> str:
    return rf"lower(regexp_extract({path(url)}, r'^/([A-Za-z][A-Za-z](?:[-_][A-Za-z][A-Za-z])?)(?:/|$)', 1))"


def locale_root(url: str) -> str:
    return rf"CASE WHEN {locale(url)} = '' THEN {url} ELSE regexp_extract({url}, r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^/?#]*)', 1) || '/' END"


def cleaned_input(raw: str) -> str:
    """A typed-in target: Markdown link and quotes unwrapped, https:// put before a bare domain."""
    link = rf"regexp_extract(trim({raw}), r'^\[[^\]]*\]\(\s*([^)\s]+)\s*\)$', 1)"
    bare = rf"trim(regexp_replace(CASE WHEN {link} <> '' THEN {link} ELSE trim({raw}) END, r'^[`<>\x22\x27 ]+|[`<>\x22\x27 ]+$', '', /*all*/ 1))"
    return rf"CASE WHEN {bare} = '' THEN '' WHEN regexp_like({bare}, r'^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN {bare} ELSE 'https://' || regexp_replace({bare}, r'^/+', '') END"


def clean_href(href: str) -> str:
    """First step of resolving a link: without control characters and fragment."""
    return rf"regexp_replace(regexp_replace(trim({href}), r'[\x00-\x1F\x7F]', '', /*all*/ 1), r'#.*$', '')"


def joined(h: str, base: str) -> str:
    """Second step: a clean link put behind the part of `base` that it leaves out."""
    origin = rf"regexp_extract({base}, r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    scheme = rf"regexp_extract({base}, r'^([A-Za-z][A-Za-z0-9+.-]*:)', 1)"
    folder = rf"regexp_extract({base}, r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)', 1)"
    return rf"""replace(CASE WHEN regexp_like({h}, r'^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} WHEN startswith({h}, '//') THEN {scheme} || {h} WHEN startswith({h}, '/') THEN {origin} || {h}
      WHEN {h} = '' THEN regexp_replace({base}, r'#.*$', '') WHEN startswith({h}, '?') THEN regexp_replace({base}, r'[?#].*$', '') || {h}
      WHEN {folder} = {origin} THEN {origin} || '/' || {h} ELSE {folder} || {h} END, ' ', '%20')"""


def folded(whole: str, h: str) -> str:
    """Last step: dot segments of relative links folded (RFC 3986; two dots up to four levels deep), path at least `/`; NULL if not http(s)."""
    dots = rf"regexp_replace(replace({whole}, '/./', '/'), r'/\.$', '/')"
    for _ in range(4):
        dots = rf"regexp_replace({dots}, r'(://[^/]+(?:/[^/?]+)*?)/[^/?.][^/?]*/\.\.(?:/|$)', r'$back1$/')"
    dots = rf"regexp_replace({dots}, r'^([a-z]+://[^/]+)(?:/\.\.)+(?:/|$)', r'$back1$/')"  # none stand above the root
    dots = rf"CASE WHEN regexp_like({h}, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') THEN {whole} ELSE {dots} END"
    return rf"CASE WHEN regexp_like({whole}, r'^https?://') THEN regexp_replace({dots}, r'^(https?://[^/?]+)(\?|$)', r'$back1$/$back2$') END"
