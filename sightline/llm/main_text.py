"""Main text of web pages by consensus host paths.

Three steps. (1) Each page is read into blocks, and each of its containers (elements that may hold an article) gets a score from
the length of its own text blocks, how little of that is link text, and its sentences. (2) Containers vote in Spark:
their generalised tag-class paths (class names with digits folded, no ids, no positions) are summed per host, and the
path with the most score wins, so that a host's odd page follows the layout of the others. (3) The page is read again
and the blocks under the winning path are its text, from the outermost article around it on, or the outermost main
where no article is; elsewhere from the outermost container that has sentences of its own beside it. A page without the path uses its own best container.

A page's containers are a tree with one node for each path; a path goes by a 64-bit hash made of its parent's and its
own step, so time and votes grow with the page alone, however deep it nests. Votes are (host, path) sums, shuffled after
partial sums in each task. Pages meet the winner of their host in a shuffle whose large partitions Spark splits, as one host may have most pages.

What is not the article: elements such as nav and aside, hidden ones, and those whose class, id or role says so. A class says so of a whole layout
too (`has-sidebar`, `post-comments-open`), so an element so named counts as part of the page where it holds the main element,
or more than half of the page's text, and unless its name speaks of comments, notices and the like, which a page may have more of than
of its article; of these, those with an article of another name in them.

A block ends where a block element begins or ends. White space in a block becomes one space; empty blocks are dropped;
blocks are joined by a line feed in page order. What is in a form is dropped, unless forms hold most of the page's text, with
sentences: those frame the page, and go by their parts.

Defined cases: null or empty html gives an empty text; markup without any container uses the body; broken markup
(unclosed tags, stray `<` and quotes) is read leniently; a null or odd url votes under the empty host; rows that repeat are
extracted each; columns beyond page_id, url and html play no part.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, only, slices

#: Element names: without end tag; whose text is never shown; that are not the article; that bound a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video".split())
ASIDE = frozenset("nav header footer aside button menu dialog head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div body td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS, LISTS = frozenset("li td th tr dt dd option".split()), frozenset("ul ol table dl select".split())
#: Elements that an inline end tag doesn't reach beyond.
KEEPS = frozenset("article main body td".split())
CLOSES_P = BLOCK - {"html", "body", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
#: Words of class, id or role names that mark what is not the article.
NOISE = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)?|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-?bar|footer|header|masthead|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend(?:ed|ations?)?|comments?|disqus|replies|respond|"
    r"pagination|pager|widget|toolbar|skip|hidden|copyright|legal|search)(?:$|[\s_-])"
)
#: Words that mark a part which may be longer than the article.
OTHERS = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|disqus|replies|respond|related|recommend(?:ed|ations?)?|cookies?|consent|gdpr|notice|newsletter|popup|modal|hidden)(?:$|[\s_-])")
UNSEEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<({'|'.join(sorted(RAW))})\b(?:[^>]*+(?<=/)>|[^>]*+(?:>.*?(?:</\1\b[^>]*+(?:>|\Z)|\Z)|\Z))", re.S | re.I)
#: A tag ends at the first `>` outside a quoted value; a quote opens a value only after `=`. Possessive, so that time is linear.
TAG = re.compile(r"<(/?[a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]++)))?")
READ = frozenset("class id role hidden aria-hidden style".split())
SENTENCE = re.compile(r"[.!?。！？…](?:\s|$)")
DIGITS = re.compile(r"\d+")


@dataclass
class Block:
    text: str
    link_chars: int
    node: int  # the container around it
    heading: bool
    form: bool


@dataclass
class Page:
    """The text blocks of a page that are not in menus and the like, and the tree of its containers; node 0 is the page."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    step: list[str] = field(default_factory=lambda: [""])
    key: list[int] = field(default_factory=lambda: [0])  # 64-bit hash of the generalised path
    child: dict[tuple[int, str], int] = field(default_factory=dict)

    def below(self, node: int, step: str) -> int:
        at = self.child.get((node, step))
        if at is None:
            at = self.child[node, step] = len(self.step)
            self.parent.append(node)
            self.step.append(step)
            self.key.append(int.from_bytes(hashlib.blake2b(f"{self.key[node]} {step}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
        return at

    def way(self, node: int) -> list[int]:
        """The nodes from the outermost container to `node`."""
        out = []
        while node:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def scores(self) -> list[float]:
        """Of each container: text outside links and its sentences, in full for its own blocks, a share for those below."""
        out = [0.0] * len(self.step)
        for b in self.blocks:
            plain = max(0, len(b.text) - 2 * b.link_chars)
            out[b.node] += plain if b.heading else plain + 20 * len(SENTENCE.findall(b.text))
        for node in range(len(out) - 1, 0, -1):  # a node comes after its parent
            out[self.parent[node]] += 0.7 * out[node]
        out[0] = 0.0
        return out

    def best(self) -> int:
        scores = self.scores()
        return max(range(len(scores)), key=lambda n: (scores[n], self.key[n] if n else 0))

    def under(self, top: int) -> str:
        inside = [False] * len(self.step)
        inside[top] = True
        for node in range(top + 1, len(inside)):
            inside[node] = inside[self.parent[node]]
        return "\n".join(b.text for b in self.blocks if inside[b.node])

    def outermost(self, node: int) -> int:
        """The container that the article begins at: a container in it may outweigh it, which has less of what lies deeper."""
        way = self.way(node)
        for name in ("article", "main"):
            for n in way:
                if self.step[n].split(".")[0] == name:
                    return n
        around = {0, *way[:-1]}
        own = {b.node for b in self.blocks if b.node in around and not b.heading and 2 * b.link_chars <= len(b.text) and SENTENCE.search(b.text)}
        return 0 if 0 in own else next((n for n in way if n in own), node)


def attributes(raw: str) -> dict[str, str]:
    """The attributes that matter, the first of each name. Names are read between values, never in them."""
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for m in ATTRIBUTE.finditer(raw):
            if (name := m[1].lower()) in READ:
                out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def is_noise(tag: str, at: dict[str, str]) -> bool:
    """Whether the element is certainly not the article, whatever it holds."""
    if tag in ASIDE or "hidden" in at or at.get("aria-hidden") == "true":
        return True
    if not at or tag in ("body", "html", "article", "main"):
        return False
    if at.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"):
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I))


def named(pattern: re.Pattern, at: dict[str, str]) -> bool:
    return bool(pattern.search(at.get("class", "")) or pattern.search(at.get("id", "")))


def general(tag: str, at: dict[str, str]) -> str:
    names = sorted({DIGITS.sub("#", c.lower()) for c in at.get("class", "").split()})
    return ".".join([tag, *names])


class Stack:
    """Open elements, with the places of each tag and of the tags that bound others, so that no search is needed."""

    def __init__(self):
        self.open: list[tuple[str, bool, str, int]] = []  # tag, noise, step, the named part around it
        self.at: dict[str, list[int]] = {}
        self.bounds: dict[str, list[int]] = {"keeps": [], "block": [], "list": []}

    def kinds(self, tag: str) -> Iterator[list[int]]:
        yield self.at.setdefault(tag, [])
        for kind, names in (("keeps", KEEPS), ("block", BLOCK), ("list", LISTS)):
            if tag in names:
                yield self.bounds[kind]

    def push(self, tag: str, noise: bool, step: str, around: int) -> None:
        for places in self.kinds(tag):
            places.append(len(self.open))
        self.open.append((tag, noise, step, around))

    def pop(self) -> tuple[str, bool, str, int]:
        top = self.open.pop()
        for places in self.kinds(top[0]):
            places.pop()
        return top

    def last(self, tag: str, bound: str = "") -> int:
        """The place of the innermost open `tag`; -1 if there is none, or one of the `bound` elements lies within it."""
        places = self.at.get(tag)
        if not places or bound and self.bounds[bound] and self.bounds[bound][-1] > places[-1]:
            return -1
        return places[-1]


class Named:
    """Elements whose class or id says that they are not the article; 0 is the page. `others`: see OTHERS."""

    def __init__(self):
        self.parent, self.others, self.main, self.article, self.weight = [0], [False], [False], [False], [0]

    def add(self, around: int, others: bool) -> int:
        for of, x in ((self.parent, around), (self.others, others), (self.main, False), (self.article, False), (self.weight, 0)):
            of.append(x)
        return len(self.parent) - 1

    def dropped(self) -> list[bool]:
        for k in range(len(self.parent) - 1, 0, -1):  # what lies in an element lies in those around it
            up = self.parent[k]
            self.weight[up] += self.weight[k]
            self.main[up] |= self.main[k]
            self.article[up] |= self.article[k]
        out = [False]
        for k in range(1, len(self.parent)):
            most = 2 * self.weight[k] > self.weight[0]
            out.append(out[self.parent[k]] or not (self.main[k] or most and (self.article[k] or not self.others[k])))
        return out


def read(html: str | None) -> Page:
    page, stack, names = Page(), Stack(), Named()
    rows: list[tuple[list[tuple[str, int, bool]], int, bool, bool]] = []  # parts (text, named part around it, in a link), node, heading, form
    parts: list[tuple[str, int, bool]] = []
    noisy, in_link, heading, forms, node, around = 0, 0, 0, 0, 0, 0

    def flush():
        nonlocal parts
        if parts:
            rows.append((parts, node, heading > 0, forms > 0))
            parts = []

    def close_to(depth: int):
        nonlocal noisy, in_link, heading, forms, node, around
        while 0 <= depth < len(stack.open):
            tag, noise, step, around = stack.pop()
            noisy -= noise
            in_link -= tag == "a"
            heading -= tag in HEADINGS
            forms -= tag == "form"
            if step:
                node = page.parent[node]

    cut = TAG.split(UNSEEN.sub("", html or ""))  # text, tag name, attributes, text, ...
    if cut[0]:
        parts.append((cut[0], 0, False))
    for k in range(1, len(cut), 3):
        name, raw, after = cut[k].lower(), cut[k + 1], cut[k + 2]
        if name[0] == "/":
            name = name[1:]
            if name in BLOCK:
                flush()
            close_to(stack.last(name, "" if name in BLOCK else "keeps"))
        else:
            if name in BLOCK:
                flush()
                if name in CLOSES_P:
                    close_to(stack.last("p", "block"))
                if name in ITEMS:
                    close_to(stack.last(name, "list"))
            elif name == "br" and not noisy:
                parts.append((" ", around, False))
            if name not in VOID and raw[-1:] != "/":
                own = attributes(raw) if raw else {}
                step = general(name, own) if name in CONTAINER else ""
                noise = is_noise(name, own)
                stack.push(name, noise, step, around)
                noisy += noise
                in_link += name == "a"
                heading += name in HEADINGS
                forms += name == "form"
                if step:
                    node = page.below(node, step)
                if name == "main" or own.get("role", "").lower() == "main":
                    names.main[around] = True
                elif name == "article" and not named(NOISE, own):
                    names.article[around] = True
                elif own and name not in ("body", "html", "article") and named(NOISE, own):
                    around = names.add(around, named(OTHERS, own))
        if after and not noisy:
            parts.append((after, around, in_link > 0))
    flush()
    for own_parts, *_ in rows:
        for text, a, link in own_parts:
            if not link and (n := len(text.strip())):
                names.weight[a] += n + 20 * len(SENTENCE.findall(text))
    gone = names.dropped()
    for own_parts, at, head, form in rows:
        text = "".join(t for t, a, _ in own_parts if not gone[a])
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            page.blocks.append(Block(text, sum(len(t) for t, a, link in own_parts if link and not gone[a]), at, head, form))
    formed = [b for b in page.blocks if b.form]
    if formed and not (2 * sum(len(b.text) for b in formed) > sum(len(b.text) for b in page.blocks) and any(SENTENCE.search(b.text) for b in formed)):
        page.blocks = [b for b in page.blocks if not b.form]
    return page


def host() -> list[F.Column]:
    """A host as two hashes, 12 bytes."""
    name = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return [F.xxhash64(name).alias("_h1"), F.hash(name).alias("_h2")]


def host_paths(pages: DataFrame) -> DataFrame:
    """(_h1, _h2, path): the key of the path that the pages of each host vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            votes: dict[tuple[int, int, int], int] = {}
            for h1, h2, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                page = read(html.as_py())
                scores = page.scores()
                total = sum(scores)
                for path, score in zip(page.key, scores):
                    if n := round(1_000_000 * score / total) if total else 0:
                        votes[h1, h2, path] = votes.get((h1, h2, path), 0) + n
            h1, h2, path = zip(*votes) if votes else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int32()), pa.array(path, pa.int64()), pa.array(votes.values(), pa.int64())], ["_h1", "_h2", "path", "votes"])

    votes = pages.select(*host(), "html").mapInArrow(run, "_h1 long, _h2 int, path long, votes long")
    votes = votes.groupBy("_h1", "_h2", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("_h1", "_h2").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def text_of(html: str | None, path: int | None) -> str:
    """The main text of a page under the path of its host, or under its own best container if it has none such."""
    page = read(html)
    text = page.under(page.outermost(page.key.index(path))) if path is not None and path in page.key[1:] else ""
    return text or page.under(page.outermost(page.best()))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each page row."""
    pages = only(pages, "page_id", "url", "html")
    won = durable(host_paths(pages))
    joined = pages.select("page_id", "url", "html", *host()).join(won.hint("shuffle_hash"), ["_h1", "_h2"], "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            texts = [text_of(html.as_py(), path) for html, path in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
