"""The opN_ queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_tokenizer import digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_of

    return language_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import corpus_scores

    return corpus_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import corpus_variants

    return corpus_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_tokens": op1_piece_tokens,
    "op2_language": op2_language,
    "op3_main_text": op3_main_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_reply_order": op5_reply_order,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_neighbours": op8_neighbours,
    "op9_secrets": op9_secrets,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_kneser_ney": op11_kneser_ney,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}

LLM_ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT d.rowid_ AS r, d.doc_id, u.i, u.line,
         translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS text FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u),
shared AS (SELECT k, min(doc_id) AS smallest FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id > s.smallest AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r""",
    "op10_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0 AND doc_id IS NOT NULL)),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
both_ AS (SELECT a.r AS ra, b.r AS rb, a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT DISTINCT a, b FROM both_ JOIN sizes x ON x.r = ra JOIN sizes y ON y.r = rb WHERE a <> b AND c >= 0.8 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM words WHERE doc_id IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT w.doc_id, r.m AS class_id, len(coalesce(w.w, [])) AS n_words
FROM words w LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id""",
    "op7_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, runs.n, item_id FROM runs JOIN win ON runs.t = win.t AND runs.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op3_main_text": r"""
WITH plain AS (
  SELECT row_number() OVER () AS r, page_id, url,
         regexp_extract(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?is)<article\b[^>]*>(.*?)</article>', 1) AS a FROM pages),
blocks AS (SELECT r, unnest(regexp_split_to_array(a, '(?i)</?(?:p|h[1-6]|div|ul|ol|li|blockquote)\b[^>]*>')) AS b,
                  generate_subscripts(regexp_split_to_array(a, '(?i)</?(?:p|h[1-6]|div|ul|ol|li|blockquote)\b[^>]*>'), 1) AS i FROM plain),
texts AS (SELECT r, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
            regexp_replace(regexp_replace(b, '(?i)<br\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM blocks),
whole AS (SELECT r, string_agg(t, chr(10) ORDER BY i) AS text FROM texts WHERE t <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM plain LEFT JOIN whole USING (r)""",
    "op5_reply_order": r"""
WITH RECURSIVE lines AS (
  SELECT m, conv_id, turn, role, i, line, length(regexp_replace(regexp_extract(line, '^\s*((?:>\s?)+)', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^\s*((?:>\s?)+)', '') AS bare
  FROM (SELECT m, conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM (SELECT row_number() OVER () AS m, * FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)))),
rows_ AS (SELECT m, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role,
                 trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), ' ') AS body FROM lines GROUP BY m),
cut AS (SELECT *, CASE WHEN level = 0 OR trim(bare) = '' THEN 0 ELSE level END AS l FROM lines),
begun AS (SELECT *, l > 0 AND l IS DISTINCT FROM lag(l) OVER (PARTITION BY m ORDER BY i) AS starts FROM cut),
numbered AS (SELECT *, sum(starts::INT) OVER (PARTITION BY m ORDER BY i) - 1 AS pos FROM begun),
passages AS (SELECT m, conv_id, turn, pos, any_value(l) AS level, string_agg(bare, chr(10) ORDER BY i) AS text FROM numbered WHERE l > 0 GROUP BY ALL),
norm_passages AS (SELECT *, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM passages),
asked AS (SELECT * FROM norm_passages WHERE len(list_filter(string_split(n, ' '), lambda x: x <> '')) >= 3 AND conv_id IS NOT NULL AND turn IS NOT NULL),
units AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS n
          FROM (SELECT conv_id, turn, unnest([body] || regexp_split_to_array(body, '\n\s*\n') || string_split(body, chr(10))) AS u FROM rows_)),
links AS (SELECT a.conv_id, a.turn, a.level, a.pos, max(u.turn) AS source FROM asked a JOIN units u ON a.conv_id = u.conv_id AND a.n = u.n AND u.turn < a.turn GROUP BY ALL),
first AS (SELECT conv_id, turn, arg_min(source, level * 1000000 + pos) AS source, count(*) AS n_linked FROM links GROUP BY ALL),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM (SELECT DISTINCT conv_id, turn FROM rows_ WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
nodes AS (SELECT conv_id, turn, coalesce(source, earlier) AS parent, coalesce(n_linked, 0) AS n_linked FROM turns LEFT JOIN first USING (conv_id, turn)),
placed AS (SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth FROM nodes WHERE parent IS NULL
           UNION ALL SELECT n.conv_id, n.turn, p.root_turn, p.depth + 1 FROM nodes n JOIN placed p ON n.conv_id = p.conv_id AND n.parent = p.turn)
SELECT r.conv_id, r.turn, r.role, r.body, coalesce(q.n, 0) AS n_quotes, coalesce(n.n_linked, 0) AS n_linked, n.parent AS parent_turn, p.root_turn, p.depth
FROM rows_ r LEFT JOIN nodes n USING (conv_id, turn) LEFT JOIN placed p USING (conv_id, turn)
LEFT JOIN (SELECT m, count(*) AS n FROM passages GROUP BY m) q USING (m)""",
}
