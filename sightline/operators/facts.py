"""Facts and answers: claims, citation score, answer simulation and readiness, prompts, graph, opportunities (survey A15-A27, H4, J8)."""

from sightline.functions.urls import cleaned_input, host
from sightline.operators.checks import FOUNDED, IDENTITY_URL, values
from sightline.operators.scoring import grade
from sightline.plans.relations import relation

ORG = "array('organization', 'localbusiness', 'website', 'corporation', 'store')"
OFFER_HREF = r"(?i)/(?:product|products|shop|store|pricing|plans|services?|solutions?)(?:/|$)"
PRICE = r"(?i)[$€£₹]\s?\d|\b\d+(?:\.\d\d)?\s?(?:USD|EUR|GBP|INR)\b"
#: Questions and the claim types that answer them, in order (fixed values).
QUESTIONS = [
    (1, "Who is %s and what do they do?", "brand_name", 1), (1, "Who is %s and what do they do?", "offering", 2), (2, "When was %s founded?", "founding_year", 1), (3, "Where is %s based / headquartered?", "location", 1), (4, "What does %s sell or offer?", "offering", 1),
    (5, "How do I contact %s?", "contact", 1), (6, "How much do %s''s products/services cost?", "price_signal", 1), (7, "Is %s a legitimate, established company?", "identity_link", 1), (7, "Is %s a legitimate, established company?", "social_profile", 2),
    (7, "Is %s a legitimate, established company?", "founding_year", 3), (7, "Is %s a legitimate, established company?", "brand_name", 4),
]
relation("question_types", values([(a, b.replace("''", "'"), c, d) for a, b, c, d in QUESTIONS], "q, question, type, type_ord"))

relation("consistency", r"""
SELECT t.site, coalesce(c.n, 0) AS conflicts, CASE WHEN c.n IS NULL THEN 'none' WHEN c.elevated THEN 'elevated' ELSE 'low' END AS risk, coalesce(s.n, 0) AS superlatives
FROM {site_totals} t LEFT JOIN (SELECT site, count(*) AS n, bool_or(severity = 'medium') AS elevated FROM {fact_conflicts} GROUP BY site) c ON t.site = c.site LEFT JOIN (SELECT site, count(*) AS n FROM {superlatives} GROUP BY site) s ON t.site = s.site
""")

relation("year_claims", r"""
SELECT site, value, bool_or(in_sd) AS in_sd, bool_or(NOT in_sd) AS in_text FROM (
  SELECT site, explode(regexp_extract_all(visible_text, r'""" + FOUNDED + r"""', 1)) AS value, false AS in_sd FROM {page_facts} WHERE is_home OR regexp_like(url, r'""" + IDENTITY_URL + r"""')
  UNION ALL SELECT site, regexp_extract(get_json_object(node, '$.foundingDate'), r'^((?:19|20)\d\d)', 1), true FROM {page_jsonld} WHERE regexp_like(coalesce(get_json_object(node, '$.foundingDate'), ''), r'^(?:19|20)\d\d'))
GROUP BY site, value
""")
relation("node_claims", r"""
SELECT site, min_by(address, page_ord * 1000 + node_ord) FILTER (WHERE address <> '') AS address, bool_or(has_contact) AS has_contact, bool_or(has_price) AS has_price FROM (
  SELECT site, page_ord, node_ord, CASE WHEN arrays_overlap(types, """ + ORG + r""") THEN coalesce(CASE WHEN startswith(a, '{') THEN concat_ws(', ', nullif(get_json_object(node, '$.address.streetAddress'), ''), nullif(get_json_object(node, '$.address.addressLocality'), ''), nullif(get_json_object(node, '$.address.addressRegion'), ''), nullif(get_json_object(node, '$.address.addressCountry'), '')) ELSE trim(a) END, '') ELSE '' END AS address,
         coalesce(get_json_object(node, '$.contactPoint'), get_json_object(node, '$.ContactPoint'), nullif(get_json_object(node, '$.telephone'), ''), nullif(get_json_object(node, '$.email'), '')) IS NOT NULL AS has_contact,
         arrays_overlap(types, array('offer', 'aggregateoffer')) AND coalesce(get_json_object(node, '$.price'), get_json_object(node, '$.lowPrice')) IS NOT NULL AS has_price
  FROM (SELECT site, page_ord, node_ord, types, node, get_json_object(node, '$.address') AS a FROM {page_jsonld}))
GROUP BY site
""")
relation("offer_names", r"""
SELECT site, listagg(name, '; ') WITHIN GROUP (ORDER BY first_seen) AS names FROM (SELECT site, name, first_seen, row_number() OVER (PARTITION BY site ORDER BY first_seen, name) AS k FROM (
  SELECT site, left(get_json_object(node, '$.name'), 60) AS name, min(page_ord * 1000 + node_ord) AS first_seen FROM {page_jsonld} WHERE arrays_overlap(types, array('product', 'service', 'offer', 'course')) AND coalesce(get_json_object(node, '$.name'), '') <> '' GROUP BY site, left(get_json_object(node, '$.name'), 60))) WHERE k <= 4 GROUP BY site
""")
relation("link_claims", r"""
SELECT site, bool_or(regexp_like(href, r'""" + OFFER_HREF + r"""')) AS offers, bool_or(regexp_like(href, r'(?i)/contact')) AS contact_page, min_by(regexp_extract(href, r'(?i)^mailto:([^?]+)', 1), page_ord * 10000 + pos) FILTER (WHERE regexp_like(href, r'(?i)^mailto:[^?]')) AS email,
       min_by(trim(regexp_extract(href, r'(?i)^tel:(.+)$', 1)), page_ord * 10000 + pos) FILTER (WHERE regexp_like(href, r'(?i)^tel:.')) AS tel, bool_or(regexp_like(lower(href), r'^(?:tel|mailto):')) AS machine_contact, bool_or(contains(lower(href), '/pricing')) AS pricing, bool_or(regexp_like(text, r'(?i)\b(?:products?|services?|pricing|plans)\b')) AS offer_text, bool_or(regexp_like(text, r'(?i)\bcontact\b')) AS contact_text
FROM {page_links} GROUP BY site
""")
relation("identity_claims", r"""
SELECT site, type, value, o FROM (SELECT site, type, value, o, row_number() OVER (PARTITION BY site ORDER BY o, type, value) AS k FROM (
  SELECT site, 'identity_link' AS type, profile AS value, min(o) AS o FROM (SELECT site, page_ord * 100000 AS o, explode(CASE WHEN startswith(s, '[') THEN from_json(s, 'array<string>') ELSE array(s) END) AS profile FROM (SELECT site, page_ord, get_json_object(node, '$.sameAs') AS s FROM {page_jsonld}) WHERE s IS NOT NULL) GROUP BY site, profile
  UNION ALL SELECT site, 'social_profile', platform || ':@' || handle, min(page_ord * 100000 + 50000 + pos) FROM {social_handles} GROUP BY site, platform || ':@' || handle)) WHERE k <= 10
""")
relation("raw_claims", r"""
SELECT b.site, 1 AS ext, cast(0 AS bigint) AS o, 'brand_name' AS type, b.brand AS value, coalesce(n.hit, false) AS in_sd, length(b.brand) >= 3 AND contains(lower(h.title || ' ' || left(h.visible_text, 4000)), lower(b.brand)) AS in_text, false AS off_site
FROM {brand_names} b JOIN {page_facts} h ON b.site = h.site AND h.is_home LEFT JOIN (SELECT n.site, bool_or(lower(get_json_object(n.node, '$.name')) = lower(b.brand)) AS hit FROM {page_jsonld} n JOIN {brand_names} b ON n.site = b.site WHERE arrays_overlap(n.types, """ + ORG + r""") GROUP BY n.site) n ON b.site = n.site
UNION ALL SELECT site, 2, cast(value AS bigint), 'founding_year', value, in_sd, in_text, false FROM {year_claims}
UNION ALL SELECT c.site, 3, 0, 'location', c.address, true, contains(lower(h.visible_text), lower(regexp_extract(c.address, r'^([^,]*)', 1))), false FROM {node_claims} c JOIN {page_facts} h ON c.site = h.site AND h.is_home WHERE c.address IS NOT NULL
UNION ALL SELECT t.site, 4, 0, 'offering', coalesce(o.names, 'offering section(s) linked in navigation'), o.names IS NOT NULL, coalesce(l.offers, false), false FROM {site_totals} t LEFT JOIN {offer_names} o ON t.site = o.site LEFT JOIN {link_claims} l ON t.site = l.site WHERE o.names IS NOT NULL OR coalesce(l.offers, false)
UNION ALL SELECT t.site, 5, 0, 'contact', CASE WHEN l.email IS NOT NULL OR l.tel IS NOT NULL THEN concat_ws(', ', l.email, l.tel) WHEN l.contact_page THEN 'contact page present' ELSE 'contact schema present' END, coalesce(c.has_contact, false), l.email IS NOT NULL OR l.tel IS NOT NULL OR coalesce(l.contact_page, false), false
  FROM {site_totals} t LEFT JOIN {link_claims} l ON t.site = l.site LEFT JOIN {node_claims} c ON t.site = c.site WHERE l.email IS NOT NULL OR l.tel IS NOT NULL OR coalesce(l.contact_page, false) OR coalesce(c.has_contact, false)
UNION ALL SELECT site, 6, o, type, value, type = 'identity_link', type = 'social_profile', true FROM {identity_claims}
UNION ALL SELECT t.site, 7, 0, 'price_signal', 'prices present on site', coalesce(c.has_price, false), t.priced, false FROM (SELECT site, bool_or(regexp_like(visible_text, r'""" + PRICE + r"""')) AS priced FROM {page_facts} GROUP BY site) t LEFT JOIN {node_claims} c ON t.site = c.site WHERE t.priced OR coalesce(c.has_price, false)
""")
relation("claims", r"""
SELECT c.site, 'C-' || lpad(cast(row_number() OVER (PARTITION BY c.site ORDER BY ext, o, c.type, value) AS string), 3, '0') AS id, c.type, b.brand AS subject, value, in_sd, in_text, off_site,
       CASE WHEN x.site IS NOT NULL THEN 'contradicted' WHEN in_sd AND in_text THEN 'quotable' WHEN in_sd THEN 'structured_only' WHEN in_text THEN 'text_only' WHEN off_site THEN 'external_only' ELSE 'unverified' END AS status,
       CASE WHEN in_sd AND in_text THEN 'high' WHEN in_sd OR in_text THEN 'medium' ELSE 'low' END AS confidence, coalesce(nullif(concat_ws('+', CASE WHEN in_sd THEN 'structured' END, CASE WHEN in_text THEN 'text' END, CASE WHEN off_site THEN CASE WHEN e.verified THEN 'external' ELSE 'declared-offsite' END END), ''), 'none') AS corroboration
FROM {raw_claims} c JOIN {brand_names} b ON c.site = b.site JOIN {external_evidence} e ON c.site = e.site LEFT JOIN (SELECT DISTINCT site, CASE WHEN fact = 'founding_year' THEN 'founding_year' ELSE 'social_profile' END AS type FROM {fact_conflicts}) x ON c.site = x.site AND c.type = x.type
""", stored=True)
relation("claim_summary", r"""
SELECT site, count(*) AS total, count_if(status = 'quotable') AS quotable, count_if(status = 'structured_only') AS structured_only, count_if(status = 'text_only') AS text_only, count_if(status = 'contradicted') AS contradicted, count_if(in_text) AS in_text, count_if(off_site) AS off_site, bool_or(type IN ('identity_link', 'social_profile')) AS has_links,
       cast(bround(100.0 * count_if(status = 'quotable') / count(*), 0) AS bigint) AS quotable_pct, cast(bround(100.0 * count_if(in_sd) / count(*), 0) AS bigint) AS machine_pct FROM {claims} GROUP BY site
""")
relation("citation_components", r"""
SELECT site, component, value, weight, ord FROM (
  SELECT c.site, 'machine_quotability' AS component, c.machine_pct AS value, 0.30 AS weight, 1 AS ord FROM {claim_summary} c
  UNION ALL SELECT site, 'extractability', cast(bround(100.0 * in_text / total, 0) AS bigint), 0.20, 2 FROM {claim_summary}
  UNION ALL SELECT c.site, 'corroboration', cast(CASE WHEN e.verified THEN 100 WHEN c.off_site >= 2 THEN 65 WHEN c.off_site = 1 THEN 50 ELSE 30 END AS bigint), 0.25, 3 FROM {claim_summary} c JOIN {external_evidence} e ON c.site = e.site
  UNION ALL SELECT site, 'stability', cast(greatest(0, 100 - 30 * conflicts) AS bigint), 0.15, 4 FROM {consistency}
  UNION ALL SELECT site, 'attribution', cast(CASE WHEN has_links THEN 100 ELSE 60 END AS bigint), 0.10, 5 FROM {claim_summary})
""")
relation("citation_scores", f"""SELECT site, score, {grade('score')} AS grade, weakest FROM (SELECT site, cast(bround(cast(sum(value * weight) AS double), 0) AS bigint) AS score, min_by(component, value * 10 + ord) AS weakest FROM {{citation_components}} GROUP BY site)""")
relation("simulated_answers", r"""
SELECT s.site, s.q, printf(s.question, b.brand) AS question, CASE WHEN k = 0 THEN 'no' WHEN contradicted THEN 'risky' WHEN structured OR textual THEN 'yes' ELSE 'partial' END AS answerable, CASE WHEN k = 0 THEN 'none' WHEN contradicted THEN 'conflicting' WHEN structured THEN 'structured' WHEN textual THEN 'text' ELSE 'off-site' END AS basis,
       k > 0 AND NOT contradicted AND structured AS would_cite, CASE WHEN best = 0 THEN 'high' WHEN best = 1 THEN 'medium' ELSE 'low' END AS confidence, k AS supporting
FROM (SELECT t.site, t.q, t.question, count(c.id) AS k, coalesce(bool_or(c.status = 'contradicted'), false) AS contradicted, coalesce(bool_or(c.in_sd), false) AS structured, coalesce(bool_or(c.in_text), false) AS textual, min(CASE c.confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END) AS best
      FROM {site_questions} t LEFT JOIN {claims} c ON t.site = c.site AND t.type = c.type GROUP BY t.site, t.q, t.question) s JOIN {brand_names} b ON s.site = b.site
""")
relation("site_questions", r"""SELECT b.site, t.q, t.question, t.type FROM (SELECT DISTINCT site, explode(array(1, 2, 3, 4, 5, 6, 7)) AS q FROM {claims}) b JOIN {question_types} t ON b.q = t.q""", stored=True)
relation("answer_summary", r"""SELECT site, count(*) AS questions, cast(bround(100.0 * count_if(answerable IN ('yes', 'partial')) / count(*), 0) AS bigint) AS answerable_pct, cast(bround(100.0 * count_if(would_cite) / count(*), 0) AS bigint) AS citable_pct FROM {simulated_answers} GROUP BY site""")

relation("node_keys", r"""
SELECT site, lower(k) AS k, is_home FROM (SELECT site, is_home, explode(keys) AS k FROM {page_jsonld})
UNION ALL SELECT site, lower(k), is_home FROM (SELECT site, is_home, explode(json_object_keys(v)) AS k FROM (SELECT site, is_home, get_json_object(node, '$.offers') AS v FROM {page_jsonld} UNION ALL SELECT site, is_home, get_json_object(node, '$.address') FROM {page_jsonld} UNION ALL SELECT site, is_home, get_json_object(node, '$.brand') FROM {page_jsonld} UNION ALL SELECT site, is_home, get_json_object(node, '$.contactPoint') FROM {page_jsonld}) WHERE startswith(v, '{'))
""")
relation("readiness_facts", r"""
SELECT t.site, h.site_name, h.title, k.has_address, k.has_contact, k.has_price, k.has_hours, y.t_identity, y.t_offer, y.t_product, y.t_local, y.named_org, x.address_text, x.price_text, x.hours_text, x.cart, coalesce(l.offers, false) AS offers, coalesce(l.offer_text, false) AS offer_text, coalesce(l.machine_contact, false) AS machine_contact, coalesce(l.contact_page OR l.contact_text, false) AS contact_link, coalesce(l.pricing, false) AS pricing
FROM {site_totals} t JOIN (SELECT site, site_name, title FROM {page_facts} WHERE is_home) h ON t.site = h.site
LEFT JOIN (SELECT site, bool_or(k = 'address') AS has_address, bool_or(k IN ('contactpoint', 'telephone', 'email')) AS has_contact, bool_or(k IN ('price', 'offers')) AS has_price, bool_or(k IN ('openinghours', 'openinghoursspecification')) AS has_hours FROM {node_keys} GROUP BY site) k ON t.site = k.site
LEFT JOIN (SELECT site, bool_or(arrays_overlap(types, array('organization', 'website', 'localbusiness'))) AS t_identity, bool_or(arrays_overlap(types, array('product', 'service', 'offer', 'course', 'offercatalog'))) AS t_offer, bool_or(array_contains(types, 'product')) AS t_product, bool_or(arrays_overlap(types, array('localbusiness', 'restaurant', 'store'))) AS t_local, bool_or(first_type IN ('organization', 'website', 'localbusiness') AND coalesce(get_json_object(node, '$.name'), '') <> '') AS named_org FROM {page_jsonld} GROUP BY site) y ON t.site = y.site
LEFT JOIN (SELECT site, bool_or(page_ord <= 4 AND regexp_like(visible_text, r'\b\d{5,6}\b') AND regexp_like(visible_text, r'(?i)\b(?:street|st\.|road|rd\.|ave|suite|floor|city)\b')) AS address_text, bool_or(page_ord <= 4 AND regexp_like(visible_text, r'""" + PRICE + r"""')) AS price_text, bool_or(page_ord <= 4 AND regexp_like(visible_text, r'(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s*[:–-]|\bopening hours\b|\bhours?\s*:')) AS hours_text, bool_or(page_ord <= 3 AND has_cart) AS cart FROM {page_facts} GROUP BY site) x ON t.site = x.site
LEFT JOIN {link_claims} l ON t.site = l.site
""")
relation("answer_readiness", r"""
SELECT site, key, CASE key
  WHEN 'identity' THEN CASE WHEN coalesce(t_identity AND named_org, false) THEN 'machine_readable' WHEN site_name <> '' OR title <> '' THEN 'text_only' ELSE 'missing' END
  WHEN 'offerings' THEN CASE WHEN coalesce(t_offer, false) THEN 'machine_readable' WHEN offers OR offer_text THEN 'text_only' ELSE 'missing' END
  WHEN 'location' THEN CASE WHEN coalesce(has_address, false) THEN 'machine_readable' WHEN address_text THEN 'text_only' ELSE 'missing' END
  WHEN 'contact' THEN CASE WHEN coalesce(has_contact, false) OR machine_contact THEN 'machine_readable' WHEN contact_link THEN 'text_only' ELSE 'missing' END
  WHEN 'pricing' THEN CASE WHEN NOT (coalesce(t_product, false) OR cart OR pricing) THEN 'n/a' WHEN coalesce(has_price, false) THEN 'machine_readable' WHEN price_text THEN 'text_only' ELSE 'missing' END
  ELSE CASE WHEN NOT (coalesce(t_local, false) OR coalesce(has_address, false)) THEN 'n/a' WHEN coalesce(has_hours, false) THEN 'machine_readable' WHEN hours_text THEN 'text_only' ELSE 'missing' END END AS state
FROM (SELECT r.*, explode(array('identity', 'offerings', 'location', 'contact', 'pricing', 'hours')) AS key FROM {readiness_facts} r)
""")
relation("readiness_scores", r"""SELECT site, count_if(state = 'machine_readable') AS score, count_if(state <> 'n/a') AS applicable, count_if(state = 'text_only') AS text_only, count_if(state = 'missing') AS missing FROM {answer_readiness} GROUP BY site""")
relation("prompts", r"""
SELECT a.site, a.key, printf(CASE a.key WHEN 'identity' THEN 'What is %s?' WHEN 'offerings' THEN 'What does %s offer?' WHEN 'location' THEN 'Where is %s located?' WHEN 'contact' THEN 'How can I contact %s?' WHEN 'pricing' THEN 'What does %s charge?' ELSE 'When is %s open?' END, b.brand) AS prompt, CASE a.state WHEN 'machine_readable' THEN 'ready' WHEN 'text_only' THEN 'partial' WHEN 'missing' THEN 'weak' ELSE 'n/a' END AS state FROM {answer_readiness} a JOIN {brand_names} b ON a.site = b.site
UNION ALL SELECT b.site, 'trust', printf('Is %s trustworthy?', b.brand), CASE WHEN e.verified THEN 'ready' WHEN p.site IS NOT NULL THEN 'partial' ELSE 'weak' END FROM {brand_names} b JOIN {external_evidence} e ON b.site = e.site LEFT JOIN (SELECT DISTINCT site FROM {profile_urls}) p ON b.site = p.site
""")

relation("graph_hubs", r"""
SELECT t.site, h.name IS NOT NULL AS has_hub, left(coalesce(nullif(h.name, ''), t.site), 32) AS label FROM {site_totals} t LEFT JOIN (
  SELECT site, min_by(coalesce(get_json_object(node, '$.name'), ''), CASE WHEN coalesce(get_json_object(node, '$.name'), '') <> '' THEN 0 ELSE 10000000 END + page_ord * 1000 + node_ord) AS name FROM {page_jsonld} WHERE first_type IN ('organization', 'localbusiness', 'website') GROUP BY site) h ON t.site = h.site
""")
relation("graph_counts", r"""
SELECT site, count_if(first_type = 'product') AS products, count_if(first_type IN ('article', 'blogposting', 'newsarticle')) AS articles, bool_or(first_type = 'product' AND array_contains(keys, 'brand')) AS has_brand, bool_or(first_type = 'product' AND (array_contains(keys, 'aggregateRating') OR array_contains(keys, 'review'))) AS has_rating, bool_or(first_type IN ('article', 'blogposting', 'newsarticle') AND array_contains(keys, 'author')) AS has_author FROM {page_jsonld} GROUP BY site
""")
relation("graph_sameas", r"""SELECT site, profile, k FROM (SELECT site, value AS profile, row_number() OVER (PARTITION BY site ORDER BY o, value) AS k FROM {identity_claims} WHERE type = 'identity_link' AND startswith(value, 'http')) WHERE k <= 5""")
relation("graph_nodes", r"""
SELECT site, 'hub' AS id, CASE WHEN has_hub THEN 'Organization' ELSE 'Site' END AS type, label FROM {graph_hubs}
UNION ALL SELECT site, 'sa' || (k - 1), 'sameAs', left(""" + host("profile") + r""", 26) FROM {graph_sameas}
UNION ALL SELECT site, 'prod', 'Product', 'Products ×' || products FROM {graph_counts} WHERE products > 0
UNION ALL SELECT site, 'art', 'Article', 'Articles ×' || articles FROM {graph_counts} WHERE articles > 0
UNION ALL SELECT site, 'pers' || (k - 1), 'Person', left(name, 26) FROM {graph_people}
""")
relation("graph_people", r"""SELECT site, name, k FROM (SELECT site, get_json_object(node, '$.name') AS name, row_number() OVER (PARTITION BY site ORDER BY page_ord, node_ord) AS k FROM {page_jsonld} WHERE first_type = 'person' AND coalesce(get_json_object(node, '$.name'), '') <> '') WHERE k <= 2""")
relation("graph_edges", r"""
SELECT site, 'hub' AS source, id AS target, CASE type WHEN 'sameAs' THEN 'sameAs' WHEN 'Product' THEN 'offers' WHEN 'Article' THEN 'publishes' ELSE 'author' END AS rel FROM {graph_nodes} WHERE id <> 'hub' AND type <> 'Person'
UNION ALL SELECT p.site, CASE WHEN c.articles > 0 THEN 'art' ELSE 'hub' END, 'pers' || (p.k - 1), 'author' FROM {graph_people} p JOIN {graph_counts} c ON p.site = c.site
""")
relation("graph_missing", r"""
SELECT site, 'hub' AS source, 'identity' AS rel FROM {graph_hubs} WHERE NOT has_hub
UNION ALL SELECT h.site, 'hub', 'sameAs' FROM {graph_hubs} h LEFT JOIN (SELECT DISTINCT site FROM {graph_sameas}) s ON h.site = s.site WHERE h.has_hub AND s.site IS NULL
UNION ALL SELECT site, 'prod', 'brand' FROM {graph_counts} WHERE products > 0 AND NOT has_brand
UNION ALL SELECT site, 'prod', 'rating' FROM {graph_counts} WHERE products > 0 AND NOT has_rating
UNION ALL SELECT site, 'art', 'author' FROM {graph_counts} WHERE articles > 0 AND NOT has_author
""")

relation("opportunities", r"""
SELECT site, 'OP-' || lpad(cast(row_number() OVER (PARTITION BY site ORDER BY rule) AS string), 3, '0') AS id, rule, category FROM (
  SELECT site, 1 AS rule, 'entity-identity' AS category FROM {page_jsonld} WHERE first_type IN ('organization', 'localbusiness') GROUP BY site HAVING NOT bool_or(array_contains(keys, 'logo'))
  UNION ALL SELECT site, 2, 'corroboration' FROM {page_facts} GROUP BY site HAVING bool_or(t_article OR regexp_like(url, r'(?i)/(?:blog|article|news|post)')) AND NOT bool_or(has_author OR t_person)
  UNION ALL SELECT site, 3, 'structured-data' FROM {page_facts} GROUP BY site HAVING bool_or(t_product) AND NOT bool_or(has_rating)
  UNION ALL SELECT f.site, 4, 'structured-data' FROM {page_facts} f LEFT JOIN (SELECT site, page_ord, count_if(regexp_like(text, r'\?\s*$')) AS n FROM {page_headings} GROUP BY site, page_ord) q ON f.site = q.site AND f.page_ord = q.page_ord GROUP BY f.site HAVING NOT bool_or(f.t_faq) AND bool_or(contains(lower(f.url), 'faq') OR coalesce(q.n, 0) >= 3)
  UNION ALL SELECT site, 5, 'structured-data' FROM {page_facts} GROUP BY site HAVING NOT bool_or(t_breadcrumb) AND count_if(is_deep) >= 3
  UNION ALL SELECT site, 6, 'structured-data' FROM {page_facts} WHERE is_home AND has_search AND NOT t_search
  UNION ALL SELECT h.site, 7, 'extractability' FROM {page_facts} h JOIN (SELECT site FROM {page_facts} GROUP BY site HAVING NOT bool_or(t_faq)) n ON h.site = n.site WHERE h.is_home AND h.word_count BETWEEN 30 AND 90)
""")

relation("peers", r"""SELECT 'brand' || s_suppkey || '.example.org' AS site, 'brand' || (s_suppkey + k) || '.example.org' AS peer FROM (SELECT s_suppkey, explode(array(1, 2, 3)) AS k FROM {supplier})""", stored=True)
relation("peer_gaps", r"""
SELECT site, pillar, peer AS leader, theirs AS leader_score, own AS own_score FROM (
  SELECT p.site, a.pillar, p.peer, b.score AS theirs, a.score AS own, row_number() OVER (PARTITION BY p.site, a.pillar ORDER BY b.score DESC, p.peer) AS k
  FROM {peers} p JOIN {pillar_scores} a ON p.site = a.site JOIN {pillar_scores} b ON p.peer = b.site AND a.pillar = b.pillar)
WHERE k = 1 AND theirs >= own + 15
""")
relation("peer_rows", r"""SELECT p.site, p.peer, a.value AS own, b.value AS theirs, a.value - b.value AS lead, CASE WHEN b.discoverability <= b.engagement THEN 'discoverability' ELSE 'engagement' END AS weakest FROM {peers} p JOIN {site_scores} a ON p.site = a.site JOIN {site_scores} b ON p.peer = b.site""")
relation("history_deltas", r"""
SELECT domain, audited_at, score, score - lag(score) OVER (PARTITION BY domain ORDER BY audited_at, id) AS delta, count(*) OVER (PARTITION BY domain ORDER BY audited_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS runs FROM {audit_history}
""")
relation("latest_audit", r"""SELECT domain, audited_at, score, total_findings FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY audited_at DESC, id DESC) AS k FROM {audit_history}) WHERE k = 1""")
relation("headline", r"""SELECT s.site, s.value AS visibility, c.score AS citation, r.score AS readiness, r.applicable, a.answerable_pct, a.citable_pct, k.risk FROM {site_scores} s LEFT JOIN {citation_scores} c ON s.site = c.site LEFT JOIN {readiness_scores} r ON s.site = r.site LEFT JOIN {answer_summary} a ON s.site = a.site LEFT JOIN {consistency} k ON s.site = k.site""")
relation("expected", r"""SELECT 'brand' || s_suppkey || '.example.org' AS site, CASE s_suppkey % 4 WHEN 0 THEN 'extractability' WHEN 1 THEN 'crawlability' WHEN 2 THEN 'freshness' ELSE 'mobile' END AS category FROM {supplier}""")
relation("expected_limits", r"""SELECT 'brand' || s_suppkey || '.example.org' AS site, cast(s_suppkey % 3 AS int) AS max_critical, cast(s_suppkey % 4 + 1 AS int) AS max_high, CASE s_suppkey % 5 WHEN 0 THEN 'hreflang' WHEN 1 THEN 'call-to-action' ELSE '' END AS absent_title FROM {supplier}""")
# Of each labelled site: what was to be found and was missed, and what should not be there (A31)
relation("evaluation_rows", r"""
SELECT s.site, coalesce(e.expected, 0) AS expected, coalesce(e.found, 0) AS found, coalesce(e.missed, '') AS missed, coalesce(t.n, 0) AS findings, coalesce(l.absent, 0) + CASE WHEN c.critical > m.max_critical THEN 1 ELSE 0 END + CASE WHEN c.high > m.max_high THEN 1 ELSE 0 END AS false_positives,
       coalesce(e.missed, '') = '' AND coalesce(l.absent, 0) = 0 AND NOT coalesce(c.critical > m.max_critical, false) AND NOT coalesce(c.high > m.max_high, false) AS passed
FROM (SELECT site FROM {expected} UNION SELECT site FROM {expected_limits}) s
LEFT JOIN (SELECT e.site, count(*) AS expected, count_if(f.site IS NOT NULL) AS found, listagg(missing, ',') WITHIN GROUP (ORDER BY missing) AS missed
           FROM (SELECT e.site, e.category, CASE WHEN f.site IS NULL THEN e.category END AS missing FROM (SELECT DISTINCT site, category FROM {expected}) e LEFT JOIN (SELECT DISTINCT site, category FROM {findings}) f ON e.site = f.site AND e.category = f.category) e
           LEFT JOIN (SELECT DISTINCT site, category FROM {findings}) f ON e.site = f.site AND e.category = f.category GROUP BY e.site) e ON s.site = e.site
LEFT JOIN {expected_limits} m ON s.site = m.site LEFT JOIN {severity_counts} c ON s.site = c.site LEFT JOIN (SELECT site, count(*) AS n FROM {findings} GROUP BY site) t ON s.site = t.site
LEFT JOIN (SELECT m.site, cast(1 AS bigint) AS absent FROM {expected_limits} m JOIN {findings} f ON m.site = f.site WHERE m.absent_title <> '' AND contains(lower(f.title), m.absent_title) GROUP BY m.site) l ON s.site = l.site
""")
relation("evaluation", r"""
SELECT count(*) AS sites, count_if(passed) AS passed, sum(expected) AS expected, sum(found) AS found, CASE WHEN sum(expected) > 0 THEN bround(cast(sum(found) AS double) / sum(expected), 3) ELSE 1.0 END AS recall, sum(false_positives) AS false_positives, bool_and(passed) AS all_passed FROM {evaluation_rows}
""")
# Maps at the usual place or named there, five of a site at most, and the pages that they name (S4)
relation("sitemap_locs", r"""
SELECT site, url, loc FROM (SELECT DISTINCT site, url, trim(loc) AS loc FROM (SELECT site, url, explode(regexp_extract_all(body, r'(?i)<loc>([^<]*)</loc>', 1)) AS loc FROM {sitemaps})) WHERE loc <> ''
""", stored=True)
relation("sitemap_maps", r"""
SELECT site, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY level, url) AS k FROM (SELECT site, url, min(level) AS level FROM (
  SELECT site, url, 0 AS level FROM {sitemaps} WHERE endswith(url, '/sitemap.xml')
  UNION ALL SELECT DISTINCT m.site, m.url, 0 FROM {sitemaps} m JOIN {robots} r ON m.site = r.site WHERE contains(r.body, m.url)
  UNION ALL SELECT site, loc, 1 FROM {sitemap_locs} WHERE endswith(url, '/sitemap.xml') AND endswith(loc, '.xml')) GROUP BY site, url)) WHERE k <= 5
""")
relation("sitemap_urls", r"""
SELECT site, loc FROM (SELECT site, loc, row_number() OVER (PARTITION BY site ORDER BY loc) AS k FROM (SELECT DISTINCT l.site, l.loc FROM {sitemap_locs} l JOIN {sitemap_maps} m ON l.site = m.site AND l.url = m.url WHERE NOT endswith(l.loc, '.xml') AND contains(l.loc, '://' || l.site || '/'))) WHERE k <= 50
""")
relation("input_targets", "SELECT raw, " + cleaned_input("raw") + " AS url FROM (SELECT '[see](https://brand' || s_suppkey || '.example.org/)' AS raw FROM {supplier} UNION ALL SELECT ' <brand' || s_suppkey || '.example.org> ' FROM {supplier} UNION ALL SELECT '//' || s_name FROM {supplier})")
