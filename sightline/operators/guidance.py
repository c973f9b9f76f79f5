"""What to do about findings: how-to texts, fix snippets, plans and narratives (survey W11, W17, W18, S11)."""

from sightline.operators.checks import values
from sightline.plans.relations import relation

#: rule, how to mend it.
HOW = [
    ("C1", "Allow the retrieval crawlers in robots.txt: give each a group of its own without a Disallow of the root."),
    ("C2", "Decide whether models may be trained on the content; if so, lift the Disallow for the training crawlers."),
    ("C3", "Remove the Disallow of the root from the group for all user agents."),
    ("C4", "Lift the Disallow rules that cover pages which should be found."),
    ("C5", "Find the failing requests in the server log and make the pages answer with status 200."),
    ("C6", "Take noindex out of the robots meta tag and the X-Robots-Tag header of pages that should be found."),
    ("C7", "Point each canonical link at the address of the page on its own domain."),
    ("C8", "Add an alternate link with hreflang x-default that names the page for everyone else."),
    ("C9", "Use a language code, with a region where needed, such as en or en-GB."),
    ("C10", "Let every language version name all the others, and itself."),
    ("C11", "Drop rel=nofollow from links within the site."),
    ("C12", "Repair or remove the links whose targets are gone."),
    ("C13", "Render the main content on the server, so that it is in the html as sent."),
    ("C14", "Put more of the page's content into the html as text."),
    ("C15", "Send readable content without scripts in place of a request to enable them."),
    ("C16", "Publish a sitemap and name it in robots.txt."),
    ("C17", "Correct the lines of robots.txt that no crawler understands."),
    ("D1", "Describe the organisation, the site and its main pages in JSON-LD."),
    ("D2", "Correct the JSON of the blocks that cannot be read."),
    ("D3", "Add an Organization and a WebSite node to the home page."),
    ("D4", "Add a Product node with an offer, price and currency to every product page."),
    ("D5", "Add an Article node with headline, author and dates to every article."),
    ("D6", "Fill in the recommended properties of each node."),
    ("D7", "Give the empty properties a value, or leave them out."),
    ("D8", "Keep a single Organization node with one name."),
    ("E1", "Give every page a title of its own."),
    ("E2", "Describe each page in a meta description of one or two sentences."),
    ("E3", "Make each title say what only that page holds."),
    ("E4", "Keep titles between 15 and 65 characters."),
    ("E5", "Keep meta descriptions within 160 characters."),
    ("E6", "Name the topic of each page in an h1 heading."),
    ("E7", "Keep one h1 and turn the others into h2."),
    ("E8", "Let headings go down one level at a time."),
    ("E9", "Describe each image that carries meaning in its alt text."),
    ("E10", "Write the facts shown in images as text too."),
    ("E11", "Declare the language on the html element."),
    ("E12", "Offer the content of the PDF files as pages."),
    ("F1", "Bring the copyright year up to date."),
    ("F2", "Review old pages and show when that was done."),
    ("F3", "Show the date of publication on articles, in text and markup."),
    ("R1", "List the brand's own profiles under sameAs of the Organization node."),
    ("R2", "Link to the brand's profiles and to sources that confirm it."),
    ("R3", "Write the brand name in one way on all pages."),
    ("R4", "Let site name, schema and title of the home page agree."),
    ("G1", "Add a viewport meta tag and a layout that fits phones."),
    ("G2", "Put one clear next step on the home page."),
    ("G3", "Mark the main menu up as a nav element."),
    ("G4", "Add links to related pages at the end of each page."),
    ("G5", "Compress images and split or drop scripts."),
    ("G6", "Cache pages and look for slow queries."),
    ("G7", "Load styles and scripts in the head later, or inline what is needed first."),
    ("G8", "Break long text up with subheadings."),
    ("G9", "Add breadcrumbs to pages deep in the site."),
    ("G10", "Show overlays only when asked for."),
    ("G11", "Let visitors read key pages without an account."),
    ("G12", "Let link texts say where the link leads."),
    ("G13", "Give each form control a label."),
    ("G14", "Give each iframe a title."),
    ("H1", "State one founding year everywhere."),
    *[(f"H2_{p}", f"Link to one {p} handle everywhere.") for p in ("twitter", "instagram", "facebook", "linkedin", "youtube", "tiktok", "github")],
    ("H3", "Back claims of rank with a source, or tone them down."),
    ("H4", "State each fact about the brand in one way."),
    ("I1", "Make each regional address answer, or drop it from hreflang and menus."),
    ("X1e", "Set the official website of the entity to this site and list the entity under sameAs."),
    ("X2e", "Set up authoritative profiles, beginning with a knowledge-base entity, and list them under sameAs."),
    ("X3e", "Correct or remove profile links that lead nowhere."),
    ("X4e", "Earn coverage elsewhere, so that open crawls of the web hold the domain."),
    ("O1", "Check the address, and whether the site lets this crawler in."),
]
relation("how_to", values(HOW, "check_id, how"))

#: rule, markup to paste; [brand] and [home] are filled in, <...> is for the owner.
SNIPPETS = [
    ("D1", '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"[brand]","url":"[home]/","logo":"<logo address>","sameAs":["<profile address>"]},{"@type":"WebSite","name":"[brand]","url":"[home]/"}]}</script>'),
    ("D3", '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"[brand]","url":"[home]/","logo":"<logo address>","sameAs":["<profile address>"]},{"@type":"WebSite","name":"[brand]","url":"[home]/"}]}</script>'),
    ("D4", '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"<product>","brand":{"@type":"Brand","name":"[brand]"},"offers":{"@type":"Offer","price":"<price>","priceCurrency":"<currency>"}}</script>'),
    ("D5", '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"<title>","author":{"@type":"Person","name":"<author>"},"datePublished":"<date>","publisher":{"@type":"Organization","name":"[brand]"}}</script>'),
    ("R1", '"sameAs":["<profile address>","<knowledge-base entity>"]'),
    ("G9", '<script type="application/ld+json">{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"[brand]","item":"[home]/"},{"@type":"ListItem","position":2,"name":"<section>","item":"<section address>"}]}</script>'),
    ("E1", "<title><what only this page holds> | [brand]</title>"),
    ("E4", "<title><what only this page holds> | [brand]</title>"),
    ("E2", '<meta name="description" content="<one or two sentences with the facts of this page>">'),
    ("E5", '<meta name="description" content="<one or two sentences with the facts of this page>">'),
    ("E6", "<h1><topic of this page></h1>"),
    ("G1", '<meta name="viewport" content="width=device-width, initial-scale=1">'),
    ("C1", "User-agent: PerplexityBot / Allow: / / User-agent: OAI-SearchBot / Allow: /"),
    ("C3", "User-agent: * / Allow: / / Sitemap: [home]/sitemap.xml"),
    ("C6", "remove: <meta name=\"robots\" content=\"noindex\">"),
    ("C7", '<link rel="canonical" href="[home]/<path>">'),
    ("C8", '<link rel="alternate" hreflang="x-default" href="[home]/">'),
    ("C16", "Sitemap: [home]/sitemap.xml"),
    ("G13", '<label for="<id>"><what to enter></label>'),
    ("G14", '<iframe title="<what it shows>" src="<address>"></iframe>'),
]
relation("snippets", values(SNIPPETS, "check_id, template"))

#: category, action (fixed values).
ACTIONS = [
    ("structured-data", "add_or_fix_structured_data"), ("entity-identity", "strengthen_entity_identity"), ("extractability", "edit_page_markup"), ("crawlability", "edit_robots_or_sitemap"), ("indexability", "fix_index_directive"),
    ("reachability", "fix_server_response"), ("js-render-gap", "server_render_content"), ("freshness", "refresh_dates_or_content"), ("corroboration", "add_external_profiles"), ("mobile", "add_responsive_layout"),
    ("conversion", "add_cta_or_remove_barrier"), ("orientation", "improve_navigation"), ("performance", "optimize_performance"), ("readability", "restructure_content"), ("accessibility", "fix_accessibility"),
]
relation("actions", values(ACTIONS, "category, action"))

relation("fix_snippets", r"""
SELECT f.site, f.id, f.check_id, replace(replace(s.template, '[brand]', coalesce(b.brand, f.site)), '[home]', 'https://' || f.site) AS snippet
FROM {findings} f JOIN {snippets} s ON f.check_id = s.check_id LEFT JOIN {brand_names} b ON f.site = b.site
""")
relation("fix_plan", r"""
SELECT m.site, r.step, m.id, m.title, m.category, coalesce(a.action, 'review_and_fix') AS action, m.severity, m.effort_label AS effort, m.points_at_stake AS expected_gain_points, array_join(slice(split(coalesce(m.affected, ''), r' \| '), 1, 5), ' | ') AS affected_pages, s.snippet IS NOT NULL AS has_snippet, s.snippet
FROM {roadmap} r JOIN {matrix} m ON r.site = m.site AND r.id = m.id LEFT JOIN {actions} a ON m.category = a.category LEFT JOIN {fix_snippets} s ON m.site = s.site AND m.id = s.id
""")
relation("action_plan", r"""
SELECT p.site, p.step AS rank, p.id AS finding_id, p.title AS action, f.reason AS why, coalesce(h.how, 'Review the pages named and mend them.') AS how, f.dimension, p.severity, p.effort, p.expected_gain_points, m.quadrant, p.has_snippet
FROM {fix_plan} p JOIN {findings} f ON p.site = f.site AND p.id = f.id JOIN {matrix} m ON p.site = m.site AND p.id = m.id LEFT JOIN {how_to} h ON f.check_id = h.check_id
""")
relation("exported_findings", r"""
SELECT f.site, f.id, f.priority, f.severity, f.dimension, f.category, f.confidence, f.impact, m.effort, m.effort_label, m.quadrant, m.points_at_stake, f.title,
       printf('%d found', f.n) || coalesce('; ' || f.scope, '') || coalesce('; for example ' || f.example, '') AS evidence, f.reason AS why, coalesce(h.how, 'Review the pages named and mend them.') AS suggested_action, f.severity AS action_priority, coalesce(f.affected, '') AS affected_pages
FROM {findings} f JOIN {matrix} m ON f.site = m.site AND f.id = m.id LEFT JOIN {how_to} h ON f.check_id = h.check_id
""")

#: least score, verdict (fixed values), and what it means.
VERDICTS = [
    (90, "Excellent", "Assistants can find, read and cite it."), (80, "Strong", "Little stands in the way of being cited."), (70, "Fair", "Some gaps keep it from being cited more."),
    (60, "Weak", "Several faults keep it from being found and read."), (0, "At risk", "Basic faults keep it out of answers."),
]
relation("verdicts", values(VERDICTS, "least, verdict, meaning"))
relation("site_verdicts", "SELECT site, CASE " + " ".join(f"WHEN value >= {least} THEN '{verdict}'" for least, verdict, _ in VERDICTS[:-1]) + f" ELSE '{VERDICTS[-1][1]}' END AS verdict FROM {{site_scores}}")
relation("narratives", r"""
SELECT site, ord, line FROM (
  SELECT k.site, 1 AS ord, printf('%s scores %d of 100 (grade %s, %s). %s', k.site, k.value, k.grade, v.verdict, v.meaning) AS line FROM {kpis} k JOIN {site_verdicts} s ON k.site = s.site JOIN {verdicts} v ON s.verdict = v.verdict
  UNION ALL SELECT site, 2, CASE WHEN total = 0 THEN 'Nothing was found by the checks that ran.' WHEN critical_high > 0 THEN printf('%d finding(s) are critical or high and come first; the weakest area is %s.', critical_high, coalesce(weakest, 'unknown')) ELSE printf('No finding is critical or high; most is to be gained in %s.', coalesce(weakest, 'no area')) END FROM {kpis}
  UNION ALL SELECT k.site, 3, printf('%d quick win(s) would add about %d point(s), to %d%s.', k.quick_wins, k.quick_win_gain, k.after_quick_wins, CASE WHEN p.quick_wins_reach_next_grade THEN ' and a better grade' ELSE '' END) FROM {kpis} k JOIN {projection} p ON k.site = p.site WHERE k.quick_wins > 0 AND k.total > 0
  UNION ALL SELECT k.site, 4, printf('With all findings mended the score would be %d (+%d); the effort is %s.', p.after_all_fixed, p.headroom, lower(k.effort_band)) FROM {kpis} k JOIN {projection} p ON k.site = p.site WHERE k.total > 0
  UNION ALL SELECT s.site, 5, printf('Discoverability (%d) and engagement (%d) are %d points apart; %s pulls the score down.', cast(bround(s.discoverability, 0) AS bigint), cast(bround(s.engagement, 0) AS bigint), cast(bround(abs(s.discoverability - s.engagement), 0) AS bigint), CASE WHEN s.discoverability < s.engagement THEN 'discoverability' ELSE 'engagement' END)
    FROM {site_scores} s JOIN {kpis} k ON s.site = k.site WHERE k.total > 0 AND abs(s.discoverability - s.engagement) >= 10
  UNION ALL SELECT c.site, 6, printf('%d of %d areas were assessed%s.', c.n - c.n_open, c.n, CASE WHEN c.n_open > 0 THEN '; not assessed and not claimed to be healthy: ' || c.labels ELSE '' END)
    FROM (SELECT site, count(*) AS n, count_if(status = 'not_assessed') AS n_open, coalesce(listagg(open_label, ', ') WITHIN GROUP (ORDER BY open_label), '') AS labels FROM (SELECT site, status, CASE WHEN status = 'not_assessed' THEN label END AS open_label FROM {area_coverage}) GROUP BY site) c JOIN {kpis} k ON c.site = k.site WHERE k.total > 0)
""")
relation("brief_lines", r"""
SELECT site, section, ord, line FROM (
  SELECT site, 1 AS section, cast(ord AS bigint) AS ord, line FROM {narratives}
  UNION ALL SELECT site, 2, cast(ord AS bigint), printf('%s: %s (%s)', label, cast(cast(bround(score, 0) AS bigint) AS string), status) FROM {pillar_scores}
  UNION ALL SELECT site, 3, cast(place AS bigint), id || ' ' || title || printf(' (+%d)', points_at_stake) FROM {quick_wins} WHERE place <= 5
  UNION ALL SELECT site, 4, cast(priority AS bigint), id || ' [' || severity || '] ' || title FROM {findings}
  UNION ALL SELECT site, 5, cast(rank AS bigint), printf('%d. %s', rank, how) FROM {action_plan}
  UNION ALL SELECT site, 6, cast(ord AS bigint), printf('%s: %d finding(s), %s', label, findings, status) FROM {funnel})
""")
