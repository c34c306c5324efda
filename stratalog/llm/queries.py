"""The queries op1 to op10 over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exactdedup, htmltext, mixing, ngramlm, quality, simhash, sstable, toxicity, urlfilter
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).drop("source", "at", "slots")  # the columns of its SQL


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(read(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_toxicity, op4_lm_scoring, op5_bpe, op6_token_shards, op7_exact_dedup, op8_mixing, op9_html_text, op10_quality_rules)}

ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(coalesce(text, '')) AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AND raw = first_value(raw) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id ASC NULLS LAST, raw)
""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, [3, 1, 2][((pos - 1) % 3 + 1)::INT] AS weight, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER p, 0)::DOUBLE) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level
       FROM s2 WINDOW p AS (ORDER BY cap::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap::DOUBLE <= level * weight AS stops FROM s3),
s5 AS (SELECT *, CASE WHEN stops THEN cap::DOUBLE ELSE weight * (SELECT arg_min(level, (cap::DOUBLE / weight, pos)) FROM s4 WHERE NOT stops) END AS target FROM s4),
e AS (SELECT source, source_size, target, floor(target + 0.5)::BIGINT AS stop FROM s5),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM d)
SELECT o.doc_id, o.size, e.source_size, e.target,
       (greatest(0, least(stop - pos0, size)) + greatest(0, least(stop - pos0 - source_size, size)))::BIGINT AS taken
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
""",
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
v AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM v) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat FROM m, (SELECT unnest(range(5)) AS j) GROUP BY r),
l AS (SELECT r, string_split(t, chr(10)) AS ls FROM w),
l1 AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
l2 AS (SELECT r, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l1),
l3 AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again, len(ws) AS n,
       length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(line, '[^!]', '', 'g')) AS bang,
       length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^a-z]', '', 'g')) AS low,
       regexp_matches(line, '[.!?:;"'')…»”。！？][\x20\x09-\x0D]*$') AS ended,
       len(list_filter(ws, lambda w: w IN ('|', '/', '>', '»', '·', '•', '-', '–', '—'))) AS parted,
       len(list_filter(ws, lambda w: contains(w, '://') OR starts_with(w, 'www.'))) AS links,
       len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS said FROM l2 WHERE len(ws) > 0),
l4 AS (SELECT *, n <= 3 AND NOT ended AS s, row_number() OVER (PARTITION BY r ORDER BY i) AS j FROM l3),
l5 AS (SELECT *, coalesce(lag(s) OVER o, false) AS p1, coalesce(lag(s, 2) OVER o, false) AS p2, coalesce(lead(s) OVER o, false) AS f1, coalesce(lead(s, 2) OVER o, false) AS f2 FROM l4 WINDOW o AS (PARTITION BY r ORDER BY j)),
q AS (SELECT r, sum(again::INT) AS n_dup,
       sum(CASE WHEN again OR 10 * sym > 3 * n OR 2 * bang > n OR (n >= 8 AND NOT ended) OR (n >= 3 AND 10 * up > 7 * (up + low))
           OR (s AND (p1 AND p2 OR p1 AND f1 OR f1 AND f2)) OR (parted >= 2 AND 3 * parted >= n) OR (links >= 1 AND 2 * links >= n) OR (n >= 4 AND 3 * said >= n)
           OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'all rights reserved|cookie policy|privacy policy|terms of service|terms of use|subscribe to our|click here|sign in to|licensed under|copyright \(c\)|alle rechte vorbehalten|datenschutzerklärung|allgemeine geschäftsbedingungen|tous droits réservés|politique de confidentialité|mentions légales|todos los derechos reservados|política de privacidad|aviso legal')
           THEN length(array_to_string(ws, '')) ELSE 0 END) AS lost FROM l5 GROUP BY r),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
       coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars FROM w LEFT JOIN q USING (r) LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= 0.5 * word_chars AS kept, lost_chars
FROM f
""",
}
