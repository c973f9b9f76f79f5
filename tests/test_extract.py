"""Extraction held against the standard library's html parser, and structured data against its JSON parser."""

import json
from html.parser import HTMLParser

from sightline.audit import audit

DARK = {"head", "script", "style", "noscript", "template", "svg"}


class Reader(HTMLParser):
    """Walks a page tag by tag, with a stack of what hides text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.dark, self.texts, self.links, self.headings, self.images, self.titles, self.scripts, self.metas, self.lang = [], [], [], [], [], [], 0, {}, ""
        self.link = self.heading = self.title = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag in DARK:
            self.dark.append(tag)
        if tag == "a" and a.get("href"):
            self.link = (a["href"], a.get("rel", ""), [])
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = (int(tag[1]), [])
        if tag == "title":
            self.title = []
        if tag == "img":
            self.images.append((a.get("src", ""), a.get("alt")))
        if tag == "script" and a.get("src"):
            self.scripts += 1
        if tag == "html" and a.get("lang"):
            self.lang = a["lang"]
        if tag == "meta":
            self.metas[(a.get("name") or a.get("property") or a.get("http-equiv") or "").lower()] = a.get("content", "")

    def handle_endtag(self, tag):
        if tag in DARK and self.dark:
            self.dark.pop()
        if tag == "a" and self.link:
            self.links.append((self.link[0], self.link[1], " ".join(" ".join(self.link[2]).split())))
            self.link = None
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and self.heading:
            self.headings.append((self.heading[0], " ".join(" ".join(self.heading[1]).split())))
            self.heading = None
        if tag == "title" and self.title is not None:
            self.titles += self.title
            self.title = None

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        if not self.dark:
            for to in [self.texts] + [x[-1] for x in (self.link, self.heading) if x]:
                to.append(data)


def read(html):
    r = Reader()
    r.feed(html or "")
    r.close()
    return {
        "text": " ".join(" ".join(r.texts).split()), "title": " ".join("".join(r.titles).split()), "links": r.links, "headings": r.headings, "images": r.images, "scripts": r.scripts, "lang": r.lang,
        "description": r.metas.get("description", ""), "viewport": r.metas.get("viewport", ""), "words": len(" ".join(r.texts).split()),
    }


def ours(spark, pages):
    run = audit(spark.createDataFrame(pages, "page_id long, url string, html string"), max_pages=10_000)
    out = {}
    for r in run.table("page_signals").collect():
        out[r.url] = {"text": r.visible_text, "title": r.title, "links": [], "headings": [], "images": [], "scripts": r.n_scripts, "lang": r.lang, "description": r.description, "viewport": r.viewport, "words": r.word_count}
    for r in run.table("page_links").orderBy("pos").collect():
        out[r.url]["links"].append((r.href, r.rel, r.text))
    for r in run.table("page_headings").orderBy("pos").collect():
        out[r.url]["headings"].append((r.level, r.text))
    for r in run.table("page_images").orderBy("pos").collect():
        out[r.url]["images"].append((r.src, r.alt))
    return out


PAGES = [
    "<!doctype html><html lang='en'><head><title>A &amp; B</title><meta name=viewport content='width=1'><meta content=\"say &quot;so&quot;\" name=description></head><body><p>one<p>two</body></html>",
    "<!-- <a href='/no'>no</a> <h1>no</h1> <img src=no.png> --><a href='/yes'>yes</a>",
    "<script>var s = \"<a href='/no'>no</a><img src='no.png'><h1>no</h1><title>no</title>\";</script><h2>yes</h2><script src='a.js'></script>",
    "<style>a:after { content: '<h1>no</h1>' }</style><noscript><img src=pixel.gif alt=''>turn it on</noscript><p>seen</p>",
    "<a href=/one>first <a href=/two>second</a> <a name=mark>no link</a> <a href=''>empty</a> <a href=/three>never closed",
    "<h1>one <h2>two</h2> <h3>three</h4> <h5>open",
    "<a href=/i><svg><title>Icon</title><text>drawn</text></svg><span>Home</span> page</a><svg/><p>after</p>",
    "<A HREF='/UP' REL='nofollow me'>Up<BR>per</A><IMG SRC='x.png' ALT='An x'><IMG SRC=y.png>",
    "a < b and b > c &lt;tag&gt; &copy; 2020&nbsp;X",
    "<template><p>not yet</p></template><body><header>top</header><p>body text</p>",
    "<html><html lang=de><title>one</title><body><title> two</title>",
    "", "   ", "no tags at all", "<p></p>", "<!-- never closed <p>gone</p>", "<p>before</p><script>never closed <p>gone</p>",
    "中文字 and three words", "<b>b</b>old<i>i</i>",
]


def test_pages_read_as_the_standard_parser_reads_them(spark):
    pages = [(i, f"https://s.example.org/{i}", h) for i, h in enumerate(PAGES)]
    got = ours(spark, [*pages, (99, "https://s.example.org/none", None)])
    for _, url, h in pages:
        want = read(h)
        if "never closed" in h and "<a " not in h:  # what is never closed is no text: the parser gives it back at the end
            want = read(h[: h.index("<!--" if "<!--" in h else "<script>")])
        if "中" in h:
            want["words"] = 6
        assert got[url] == want, h
    assert got["https://s.example.org/none"]["text"] == ""


def test_pages_of_the_test_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = ours(spark, [(r.page_id, f"https://s.example.org/{r.page_id}", r.html) for r in rows])
    for r in rows:
        want = read(r.html)
        assert got[f"https://s.example.org/{r.page_id}"] == want


BLOCKS = {
    '{"@type": "WebSite", "target": "https://x.org/?q={term}{lang}"}': 1,  # valid: what stands in strings is no end
    '[{"@type": "A"}, {"@type": "B"}, 3, "x"]': 2,
    '{"@graph": [{"@type": "A"}, {"@type": "B"}]}': 2,
    '{"@type": "A", "n": {"m": 1}}\n {"@type": "B", "say": "a \\" }{ b"}{"@type": "C"}': 3,
    '{"@type": "A"} [{"@type": "lost"}]': 1,
    '/* note */ {"@type": "A"}': 1,
    '{"@type": "A"}{"@type": }{"@type": "C"}': 2,
    '{"@type": "A"': 0, "": 0, "null": 0, '"text"': 0, '{"@type": "A"};': 0,
}


def test_structured_data_is_salvaged_without_loss(spark):
    pages = [(i, f"https://s.example.org/{i}", f"<script type='application/ld+json'>{b}</script>") for i, b in enumerate(BLOCKS)]
    pages.append((99, "https://s.example.org/99", "<script type='application/ld+json'>{\"@type\": \"A\"}</script><script type='text/plain'>{\"@type\": \"B\"}</script><script type=\"application/ld+json\">{\"@type\": \"C\"}"))
    nodes = audit(spark.createDataFrame(pages, "page_id long, url string, html string"), max_pages=100).table("page_jsonld").collect()
    for i, (block, n) in enumerate(BLOCKS.items()):
        own = sorted((r for r in nodes if r.url == f"https://s.example.org/{i}"), key=lambda r: r.node_ord)
        assert len(own) == n, block
        try:
            whole = json.loads(block)
        except ValueError:
            continue
        if isinstance(whole, dict) and "@graph" not in whole:
            assert json.loads(own[0].node) == whole
    assert [r.first_type for r in nodes if r.url.endswith("/99")] == ["a"]
