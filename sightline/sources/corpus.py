"""Pages to analyse: the crawled `pages`, and sites made from the star tables by SQL.

The crawl's own pages have few features, so suppliers become home pages, parts product pages and orders articles; their
defects follow from keys, so that every rule has sites with and without it. Side tables (responses, robots, sitemaps,
link statuses, entities, peers, history) are made the same way. All grow with the tables they come from.
"""

from sightline.plans.relations import relation

#: Made pages: what they are made from, their page_id, url and html.
MADE = [
    ("supplier", "10000000 + s_suppkey", "'https://brand' || s_suppkey || '.example.org/'", r"""
  '<!DOCTYPE html><html' || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE ' lang="en"' END || '><head><title>' || CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name || ' - tools and toys for everyone' END || '</title>'
  || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '<meta name="viewport" content="width=device-width">' END
  || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '<meta name="description" content="' || s_name || ' sells tools and toys in nation ' || s_nationkey || '.' || CASE WHEN s_suppkey % 9 = 1 THEN repeat(' More words about it.', 10) ELSE '' END || '">' END
  || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '<meta property="og:site_name" content="' || CASE WHEN s_suppkey % 13 = 1 THEN 'Other Name' ELSE s_name END || '">' END
  || CASE WHEN s_suppkey % 17 = 3 THEN '<meta name="robots" content="noindex">' ELSE '' END
  || CASE WHEN s_suppkey % 19 = 4 THEN '<link rel="canonical" href="https://elsewhere.net/">' ELSE '<link rel="canonical" href="https://brand' || s_suppkey || '.example.org/">' END
  || CASE WHEN s_suppkey % 6 = 2 THEN '<link rel="alternate" hreflang="en" href="/"><link rel="alternate" hreflang="' || CASE WHEN s_suppkey % 12 = 2 THEN 'english' ELSE 'fr-FR' END || '" href="/about">' ELSE '' END
  || CASE WHEN s_suppkey % 8 = 5 THEN '<link rel="stylesheet" href="a.css"><link rel="stylesheet" href="b.css"><link rel="stylesheet" href="c.css"><link rel="stylesheet" href="d.css"><script src="1.js"></script><script src="2.js"></script><script src="3.js"></script><script async src="4.js"></script>' ELSE '' END
  || CASE WHEN s_suppkey % 10 = 0 THEN '' WHEN s_suppkey % 10 = 9 THEN '<script type="application/ld+json">{"@type": "Organization", "name": </script>'
     ELSE '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"' || s_name || '","url":"https://brand' || s_suppkey || '.example.org/"'
       || CASE WHEN s_suppkey % 4 = 1 THEN ',"sameAs":["https://www.linkedin.com/company/brand' || s_suppkey || '","https://www.wikidata.org/wiki/Q' || s_suppkey || '"]' ELSE '' END
       || CASE WHEN s_suppkey % 3 = 1 THEN ',"foundingDate":"' || (1990 + s_suppkey % 20) || '-05-01"' ELSE '' END
       || CASE WHEN s_suppkey % 5 = 2 THEN ',"address":{"@type":"PostalAddress","streetAddress":"' || s_suppkey || ' Main Street","addressLocality":"Springfield"}' ELSE '' END
       || CASE WHEN s_suppkey % 6 = 3 THEN ',"logo":"https://brand' || s_suppkey || '.example.org/logo.png"' ELSE '' END
       || CASE WHEN s_suppkey % 7 = 4 THEN ',"telephone":"+1 555 0100"' ELSE '' END
       || '},{"@type":["WebSite","Thing"],"name":"' || s_name || '"}' || CASE WHEN s_suppkey % 14 = 6 THEN ',{"@type":"Organization","name":"Rival ' || s_suppkey || '"}' ELSE '' END || ']}</script>' END
  || '</head><body>' || CASE WHEN s_suppkey % 15 = 7 THEN '<div>' ELSE '<nav>' END
  || '<a href="/about">About us</a><a href="/product/' || (s_suppkey * 20) || '">' || CASE WHEN s_suppkey % 6 = 0 THEN 'click here' ELSE 'First product' END || '</a><a' || CASE WHEN s_suppkey % 16 = 8 THEN ' rel="nofollow"' ELSE '' END || ' href="/blog/' || (s_suppkey * 150) || '">Blog</a><a'
  || CASE WHEN s_suppkey % 16 = 8 THEN ' rel="nofollow"' ELSE '' END || ' href="/missing/' || s_suppkey || '">Gone</a><a' || CASE WHEN s_suppkey % 16 = 8 THEN ' rel="nofollow"' ELSE '' END || ' href="../deep/./page?x=1#top">Deep</a>'
  || CASE WHEN s_suppkey % 4 = 2 THEN '<a href="https://twitter.com/brand' || s_suppkey || '">Tw</a>' || CASE WHEN s_suppkey % 8 = 2 THEN '<a href="https://x.com/other' || s_suppkey || '">X</a>' ELSE '' END ELSE '' END
  || CASE WHEN s_suppkey % 3 = 2 THEN '<a href="/contact">Contact</a><a href="mailto:info@brand' || s_suppkey || '.example.org">Mail</a>' ELSE '' END || CASE WHEN s_suppkey % 15 = 7 THEN '</div>' ELSE '</nav>' END
  || CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE '<h1>' || s_name || '</h1>' END || CASE WHEN s_suppkey % 9 = 4 THEN '<h1>Again</h1><h4>Low</h4><h5>Lower</h5>' ELSE '' END
  || '<p>' || s_name || ' is the leading provider of things. Founded in ' || (1990 + s_suppkey % 20 + CASE WHEN s_suppkey % 9 = 7 THEN 1 ELSE 0 END) || ', we make ' || repeat('good useful words for visitors ', cast(1 + s_suppkey % 12 AS int)) || '.</p>'
  || CASE WHEN s_suppkey % 5 = 3 THEN '<img src="a.png"><img src="b.png"><img src="c.png"><img src="d.png" alt="">' ELSE '<img src="a.png" alt="a">' END
  || CASE WHEN s_suppkey % 5 = 4 THEN '<form><input type="text" name="q"><input id="e" type="email"><label for="e">Mail</label><input type="search"><select name="s"></select><input type="submit"></form><iframe src="/map"></iframe>' ELSE '' END
  || CASE WHEN s_suppkey % 12 = 11 THEN '<div class="newsletter modal">Join</div>' ELSE '' END
  || '<footer>&copy; ' || (2015 + s_suppkey % 11) || ' ' || s_name || '</footer></body></html>'"""),
    ("supplier", "20000000 + s_suppkey", "'https://brand' || s_suppkey || '.example.org/about'", r"""
  '<html lang="en"><head><title>About ' || s_name || '</title><meta property="og:site_name" content="' || CASE WHEN s_suppkey % 13 = 2 THEN 'Unlike' ELSE s_name END || '"><link rel="alternate" hreflang="en" href="/about">'
  || CASE WHEN s_suppkey % 12 = 8 THEN '<link rel="alternate" hreflang="x-default" href="/">' ELSE '' END || '</head><body><nav><a href="/">Home</a><a href="report.pdf">1</a><a href="/b.pdf">2</a><a href="/c.PDF">3</a></nav><h1>About</h1><h2>Us</h2><h2>You</h2><p>We were established in '
  || (1990 + s_suppkey % 20) || '. ' || CASE WHEN s_suppkey % 6 = 1 THEN 'Sign in to continue reading.' ELSE '' END || '</p><p>Updated 20' || lpad(cast(10 + s_suppkey % 16 AS string), 2, '0') || '-0' || (1 + s_suppkey % 9) || '-31</p></body></html>'"""),
    ("part", "30000000 + p_partkey", "'https://brand' || cast(floor(p_partkey / 20) AS bigint) || '.example.org/product/' || p_partkey", r"""
  '<html lang="en"><head><title>' || CASE WHEN p_partkey % 6 = 0 THEN 'Product page' ELSE p_name || ' by ' || p_brand END || '</title>' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<meta name="viewport" content="width=device-width">' END
  || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<meta name="description" content="' || p_name || '">' END
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END || '"'
     || CASE WHEN p_partkey % 8 = 1 THEN '' ELSE ',"offers":{"@type":"Offer","price":"' || cast(cast(p_retailprice AS decimal(12,2)) AS string) || '","priceCurrency":"USD"}' END
     || CASE WHEN p_partkey % 9 = 2 THEN ',"brand":{"@type":"Brand","name":"' || p_brand || '"}' ELSE '' END || CASE WHEN p_partkey % 10 = 3 THEN ',"aggregateRating":{"@type":"AggregateRating","ratingValue":4}' ELSE '' END || '}</script>' END
  || '</head><body>' || CASE WHEN p_partkey % 21 = 5 THEN '<div id="app"></div><script>' || repeat('window.load(1);', 60) || '</script><noscript>Enable JavaScript</noscript>' WHEN p_partkey % 21 = 6 THEN '<noscript> javascript is off</noscript><!--' || repeat(' filler', 400) || '--><p>few</p>'
     ELSE '<nav><a href="/">Home</a><a href="/about">About</a>' || CASE WHEN p_partkey % 2 = 0 THEN '<a href="/product/' || (p_partkey + 1) || '">Next</a>' ELSE '<a href="/product/' || (p_partkey - 1) || '">read more</a>' END || '</nav><h1>' || p_name || '</h1><p>' || p_type || ' size ' || p_size || ' for $' || cast(cast(p_retailprice AS decimal(12,2)) AS string) || ' Add to cart. ' || repeat('Sound words describe the thing. ', cast(p_size AS int)) || '</p>' END
  || '<footer>&copy; 2012-' || (2018 + p_partkey % 8) || '</footer></body></html>'"""),
    ("orders", "50000000 + o_orderkey", "'https://brand' || cast(floor(o_orderkey / 150) AS bigint) || '.example.org/blog/' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN '/part/two' ELSE '' END", r"""
  '<html lang="en"><head><title>Story ' || o_orderkey || '</title></head><body><nav><a href="/">Home</a><a href="/blog">Blog</a></nav><h1>Story ' || o_orderkey || '</h1><p>5 min read. ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Posted ' || substring(cast(o_orderdate AS string), 1, 10) || '.' END
  || ' Priority ' || o_orderpriority || '. ' || repeat('The tale goes on with many plain words. ', cast(o_orderkey % 40 AS int)) || '</p></body></html>'"""),
]


def made(k: int, names: tuple[str, str, str] = ("", "", "")) -> str:
    """The columns of the kind k of made pages."""
    return ("SELECT {}%s, {}%s,{}%s\n" % names).format(*MADE[k][1:])


relation("crawl", "SELECT page_id, url, html FROM {pages} WHERE url IS NOT NULL" + "".join("\nUNION ALL\n" + made(k, ("", "", "") if k else (" AS page_id", " AS url", " AS html")) + "FROM {" + t[0] + "}" for k, t in enumerate(MADE)))

#: The html of the sample in Spark: the sample meets the tables that pages are made from, so that html is made for sampled pages alone, and these are dealt out evenly.
SAMPLE_HTML = (
    "SELECT /*+ REPARTITION($tasks$, page_id, url) */ page_id, url, html FROM (\nSELECT p.page_id, p.url, p.html FROM {pages} p JOIN {site_pages} s ON p.page_id = s.page_id AND p.url = s.url"
    + "".join("\nUNION ALL\nSELECT s.page_id, s.url," + html + "\nFROM {" + t + "} JOIN {site_pages} s ON s.page_id = " + page_id + " AND s.url = " + url for t, page_id, url, html in MADE)
    + ")"
)

relation("responses", r"""
SELECT 'https://brand' || event_id || '.example.org/' AS url, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, cast(floor(value * 50) AS bigint) AS elapsed_ms,
       cast(1000 + floor(value * 20000) AS bigint) AS raw_len, '' AS content_type, '' AS x_robots, CASE WHEN event_id % 29 = 6 THEN 'blocked_by_robots' ELSE '' END AS error,
       'https://brand' || event_id || '.example.org/' AS final_url, '{"Content-Type": "text/html; charset=utf-8"' || CASE WHEN event_id % 23 = 5 THEN ', "X-Robots-Tag": "noindex"' ELSE '' END || ', "server": "nginx"}' AS headers
FROM {events} WHERE event_id IN (SELECT s_suppkey FROM {supplier})
UNION ALL SELECT 'https://brand' || s_suppkey || '.example.org/llms.txt', CASE WHEN s_suppkey % 3 = 2 THEN 404 ELSE 200 END, cast(5 AS bigint), cast(s_suppkey % 4 AS bigint), CASE s_suppkey % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN '' WHEN 2 THEN 'text/markdown' ELSE 'image/png' END, '', '', 'https://brand' || s_suppkey || '.example.org/llms.txt', '{}' FROM {supplier}
UNION ALL SELECT 'https://brand' || s_suppkey || '.example.org/contact' || CASE WHEN s_suppkey % 13 = 1 THEN '-us' ELSE '' END, 200, cast(CASE WHEN s_suppkey % 13 = 1 THEN 4000 ELSE 5 END AS bigint), cast(900 AS bigint), CASE WHEN s_suppkey % 11 = 3 THEN 'application/json' ELSE 'text/html' END, '', '', 'https://brand' || s_suppkey || '.example.org/contact', '{}' FROM {supplier}
""")

# one row for each header, its name in lower case
relation("response_headers", r"""
SELECT url, final_url, lower(name) AS name, value FROM (SELECT url, final_url, name, get_json_object(headers, '$.' || name) AS value FROM (SELECT url, final_url, headers, explode(json_object_keys(headers)) AS name FROM {responses} WHERE headers IS NOT NULL)) WHERE value IS NOT NULL
""")

# the response of an address: that which ended there, else that which was asked for there (J1). What a table says apart goes before its headers.
relation("response_of", r"""
SELECT r.url, r.status, r.elapsed_ms, r.raw_len, coalesce(nullif(r.content_type, ''), h.content_type, '') AS content_type, coalesce(nullif(r.x_robots, ''), h.x_robots, '') AS x_robots, r.error FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY place, asked) AS k FROM (
    SELECT final_url AS url, 0 AS place, url AS asked, status, elapsed_ms, raw_len, content_type, x_robots, error FROM {responses} WHERE final_url IS NOT NULL
    UNION ALL SELECT url, 1, url, status, elapsed_ms, raw_len, content_type, x_robots, error FROM {responses} WHERE url IS NOT NULL)) r
LEFT JOIN (SELECT url, max(CASE WHEN name = 'content-type' THEN value END) AS content_type, max(CASE WHEN name = 'x-robots-tag' THEN value END) AS x_robots FROM {response_headers} GROUP BY url) h ON r.asked = h.url WHERE r.k = 1
""", kept=True)

relation("robots", r"""
SELECT 'brand' || s_suppkey || '.example.org' AS site, '# rules' || chr(10) || CASE s_suppkey % 6
  WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /private'
  WHEN 1 THEN 'User-agent: GPTBot' || chr(10) || 'User-agent: PerplexityBot' || chr(10) || 'Disallow: / # all'
  WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'Allow: /'
  WHEN 3 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'Sitemap: /sitemap.xml'
  WHEN 4 THEN 'User-agent: CCBot' || chr(10) || 'Crawl-delay: 5' || chr(10) || 'User-agent: OAI-SearchBot' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /'
  ELSE 'User-agent: *' || chr(10) || 'Allow: /' END AS body
FROM {supplier} WHERE s_suppkey % 7 <> 6
""")

relation("sitemaps", r"""
SELECT 'brand' || s_suppkey || '.example.org' AS site, 'https://brand' || s_suppkey || '.example.org/sitemap.xml' AS url, '<urlset><url><loc>https://brand' || s_suppkey || '.example.org/about</loc></url><url><loc> https://brand' || s_suppkey || '.example.org/product/' || (s_suppkey * 20) || ' </loc></url><url><loc>https://other.example.net/</loc></url>'
       || CASE WHEN s_suppkey % 8 = 0 THEN '<sitemap><loc>https://brand' || s_suppkey || '.example.org/maps/one.xml</loc></sitemap>' ELSE '' END || '</urlset>' AS body
FROM {supplier} WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'brand' || s_suppkey || '.example.org', 'https://brand' || s_suppkey || '.example.org/maps/' || CASE s_suppkey % 16 WHEN 0 THEN 'one' ELSE 'unnamed' END || '.xml', '<urlset><url><loc>https://brand' || s_suppkey || '.example.org/deep/page</loc></url></urlset>' FROM {supplier} WHERE s_suppkey % 8 = 0
""")

relation("link_status", r"""
SELECT 'https://brand' || s_suppkey || '.example.org/missing/' || s_suppkey AS url, CASE s_suppkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 503 WHEN 3 THEN 403 ELSE 0 END AS status FROM {supplier}
UNION ALL SELECT 'https://www.linkedin.com/company/brand' || s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 999 ELSE 404 END FROM {supplier}
UNION ALL SELECT 'https://brand' || s_suppkey || '.example.org/about', CASE WHEN s_suppkey % 18 = 14 THEN 410 ELSE 200 END FROM {supplier}
""")

relation("entities", r"""
SELECT s_name AS label, 'Q' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://brand' || s_suppkey || '.example.org/' ELSE 'https://fan' || s_suppkey || '.example.net/' END AS official_website, cast(1 AS int) AS hit_rank FROM {supplier} WHERE s_suppkey % 2 = 0
""")

relation("corpus_index", r"""SELECT 'example.org' AS domain, count(*) AS records FROM {nation} UNION ALL SELECT 'example.com' AS domain, cast(0 AS bigint) AS records FROM (SELECT count(*) FROM {region})""")

relation("external_runs", r"""SELECT 'brand' || s_suppkey || '.example.org' AS site FROM {supplier} WHERE s_suppkey % 5 <> 4 UNION ALL SELECT DISTINCT regexp_extract(lower(url), r'^[a-z]+://([^/?#:]*)', 1) AS site FROM {pages}""")

relation("audit_history", r"""
SELECT min(event_id) AS id, 'brand' || user_id || '.example.org' AS domain, to_date(ts) AS audited_at, cast(least(100, 40 + count(*)) AS int) AS score, count_if(event_type = 'error') AS total_findings
FROM {events} GROUP BY user_id, to_date(ts)
""")
