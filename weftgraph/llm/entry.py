"""The queries of this subpackage over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, fingerprints, hard_negatives, html_extract, language_id, ngram_join, piece_codec, secret_scan, sessions, sharding, url_filter, warc
from weftgraph.llm import quality_rules as Q

RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
#: Listed canonical URLs: site roots, which cover all pages and subdomains below.
LISTED = [f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": lambda s, d: html_extract.extract_pages(_read(s, d, "pages")),
        "op2_ngram_jaccard_join": lambda s, d: ngram_join.link_documents(_read(s, d, "documents")),
        "op3_warc_derivatives": lambda s, d: warc.derivatives(_read(s, d, "pages")),
        "op4_secret_scan": lambda s, d: secret_scan.secret_digest(_read(s, d, "documents")),
        "op5_language_id": lambda s, d: language_id.language_digest(_read(s, d, "documents")),
        "op6_url_filter": lambda s, d: url_filter.judge_urls(_read(s, d, "pages"), RULES, s.createDataFrame([(k,) for k in LISTED], "key string")),
        "op7_decontamination": lambda s, d: decontaminate.overlap_digest(_read(s, d, "documents"), _read(s, d, "benchmark")),
        "op8_quality_rules": lambda s, d: Q.quality_verdicts(_read(s, d, "documents")),
        "op9_sharding": lambda s, d: sharding.shard_plan(_read(s, d, "documents")),
        "op10_sentencepiece": lambda s, d: piece_codec.encode_digest(_read(s, d, "documents")),
        "op11_gap_sessions": lambda s, d: sessions.sessions(_read(s, d, "clicks")),
        "op12_fingerprints": lambda s, d: fingerprints.fingerprint_digest(_read(s, d, "documents")),
        "op13_hard_negatives": lambda s, d: hard_negatives.mine(hard_negatives.shifted(_read(s, d, "embeddings")), F.col("vec_id") % 100 == 0),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op8_quality_rules": OP8_SQL, "op11_gap_sessions": OP11_SQL, "op13_hard_negatives": OP13_SQL}


OP6_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    ({" OR ".join(f"host = '{k[:-1]}' OR host LIKE '%.{k[:-1]}'" for k in LISTED)}) AS listed
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""

_PHRASES = " OR ".join(f"contains(lower(t), '{p}')" for p in Q.BOILERPLATE)
_CLOSING = ", ".join("'" + c.replace("'", "''") + "'" for c in Q.CLOSING)
_SPACES = "[ \\t\\n\\x0b\\x0c\\r]"
OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, list_filter(string_split_regex(text, '{_SPACES}+'), lambda x: x <> '') AS w FROM docs),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM cut),
windows AS (SELECT r, k, word,
    lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4,
    lead(word, 5) OVER o AS w5, lead(word, 6) OVER o AS w6, lead(word, 7) OVER o AS w7
  FROM words WINDOW o AS (PARTITION BY r ORDER BY k)),
twice AS (SELECT r, k FROM (
    SELECT r, k, count(*) OVER (PARTITION BY r, word, w1, w2, w3, w4, w5, w6, w7) AS n FROM windows WHERE w7 IS NOT NULL) WHERE n > 1),
repeats AS (SELECT r, sum(least(8, coalesce(k - last, 8))) AS n FROM (
    SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS last FROM twice) GROUP BY r),
cuts AS (SELECT r, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs)),
lines AS (SELECT r, k, line, length(regexp_replace(line, '{_SPACES}', '', 'g')) AS solid, t, length(t) AS n,
    length(regexp_replace(t, '[^|›»•]', '', 'g')) AS bars,
    length(regexp_replace(t, '[^#*$%&<>{{}}\\\\]', '', 'g')) AS marks,
    length(regexp_replace(t, '[^!]', '', 'g')) AS shouts,
    length(regexp_replace(t, '[^ \\t]', '', 'g')) AS gaps
  FROM (SELECT *, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS t FROM cuts)),
items AS (SELECT *, solid > 0 AND gaps <= {Q.MENU_GAPS} AND right(t, 1) NOT IN ({_CLOSING}) AS item FROM lines),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY r, item ORDER BY k) AS run, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again FROM items),
failing AS (SELECT *, solid > 0 AND (again OR (item AND count(*) OVER (PARTITION BY r, item, run) >= {Q.MENU_RUN}) OR ({_PHRASES})
      OR (bars >= {Q.MENU_BARS} AND bars * 8 > gaps) OR (marks >= {Q.MARKS} AND marks * 10 > n) OR (shouts >= {Q.MARKS} AND shouts * 20 > n)
      OR (gaps >= {Q.UNPUNCTUATED_GAPS} AND NOT regexp_matches(t, '{Q.STOPS}'))
      OR (gaps <= {Q.MENU_GAPS} AND (t LIKE '%...' OR t LIKE '%…'))) AS fails FROM runs),
by_line AS (SELECT r, count(*) FILTER (again AND solid > 0) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
    coalesce(sum(solid) FILTER (fails), 0) AS n_lost_chars FROM failing GROUP BY r),
counts AS (SELECT d.doc_id, len(c.w) AS n_words,
    length(regexp_replace(d.text, '{_SPACES}', '', 'g')) AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n_failed_lines, 0) AS n_failed_lines, coalesce(l.n_lost_chars, 0) AS n_lost_chars
  FROM docs d JOIN cut c USING (r) LEFT JOIN by_line l USING (r) LEFT JOIN repeats p USING (r)),
judged AS (SELECT *, (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost_chars <= {Q.MAX_LOST_PERCENT} * word_chars AS kept, CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(n_lost_chars AS BIGINT) AS n_lost_chars
FROM judged
"""

#: Only the length rule needs rounds, as many as one run of clicks with neither gap nor final click has sessions.
OP11_SQL = """
WITH RECURSIVE clean AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) AS arrived, coalesce(value >= 60 AND kind = 'purchase', false) AS final,
         coalesce(CASE WHEN isnan(value) THEN 0 ELSE CAST(floor(100 * value + 0.5) AS BIGINT) END, 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY us, client_id, arrived NULLS FIRST, final, cents) = 1),
timely AS (
  SELECT *, row_number() OVER o AS rn, lag(us) OVER o AS last_us, lag(final) OVER o AS last_final
  FROM clean WHERE NOT coalesce(arrived - us > 3600000000, false) WINDOW o AS (PARTITION BY client_id ORDER BY us, click_id)),
marked AS (
  SELECT *, CASE WHEN last_final THEN 'end' WHEN us - last_us >= 300000000 THEN 'gap' END AS reason FROM timely),
runs AS (
  SELECT *, count(*) FILTER (rn = 1 OR reason IS NOT NULL) OVER (PARTITION BY client_id ORDER BY rn) AS run FROM marked),
starts AS (
  SELECT client_id, run, rn, us FROM runs WHERE rn = 1 OR reason IS NOT NULL
  UNION ALL
  SELECT r.client_id, r.run, min(r.rn), min(r.us) FROM starts s JOIN runs r ON r.client_id = s.client_id AND r.run = s.run AND r.us > s.us + 7200000000
  GROUP BY r.client_id, r.run),
cut AS (
  SELECT r.*, s.rn IS NOT NULL AS starting, coalesce(r.reason, 'length') AS why FROM runs r LEFT JOIN starts s ON s.client_id = r.client_id AND s.rn = r.rn),
numbered AS (SELECT *, count(*) FILTER (starting) OVER (PARTITION BY client_id ORDER BY rn) AS k FROM cut),
made AS (
  SELECT client_id, k, arg_min(click_id, rn) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents) AS cents,
         arg_max(final, rn) AS final, arg_min(why, rn) AS why, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY rn)) AS path_sha256
  FROM numbered GROUP BY client_id, k),
ended AS (SELECT *, lead(start_us) OVER o AS next_us, lead(why) OVER o AS next_why FROM made WINDOW o AS (PARTITION BY client_id ORDER BY k)),
late AS (
  SELECT e.client_id, e.k, count(*) AS n FROM clean c JOIN ended e ON e.client_id = c.client_id AND c.us >= e.start_us AND (e.next_us IS NULL OR c.us < e.next_us)
  WHERE c.arrived - c.us > 3600000000 GROUP BY e.client_id, e.k)
SELECT client_id, session_id, start_us, end_us, CAST(n_clicks AS BIGINT) AS n_clicks, CAST(coalesce(n, 0) AS BIGINT) AS n_late, CAST(cents AS BIGINT) AS value_cents,
  coalesce(next_why, CASE WHEN final THEN 'end' ELSE 'none' END) AS closed_by, path_sha256
FROM ended LEFT JOIN late USING (client_id, k)
"""

OP13_SQL = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS key, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM clean a JOIN clean b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, key, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, key) <= 5)
SELECT p.anchor_id, p.key AS positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, n.key AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 80 * p.score AND 100 * p.score
WINDOW o AS (PARTITION BY p.anchor_id, p.key ORDER BY n.score DESC, n.key)
QUALIFY row_number() OVER o <= 5
"""
