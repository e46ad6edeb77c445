"""The opN_ queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, lines, pieces, quality, repeats, simhash, tokenids, toxicity, warc
from .common import table


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_references(docs))


def op2_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without key_range and ordinal, which depend on how many archives there are."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("key_range", "ordinal")


def op10_sstable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_divergence": op1_quality_divergence,
        "op2_toxicity_trees": op2_toxicity_trees,
        "op3_hyperdimensional_language": op3_hyperdimensional_language,
        "op4_sentencepiece_viterbi": op4_sentencepiece_viterbi,
        "op5_simhash_ball": op5_simhash_ball,
        "op6_bloom_line_dedup": op6_bloom_line_dedup,
        "op7_repeated_strings": op7_repeated_strings,
        "op8_qgram_decontamination": op8_qgram_decontamination,
        "op9_warc_index_merge": op9_warc_index_merge,
        "op10_sstable_token_ids": op10_sstable_token_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_bloom_line_dedup": LINE_DEDUP_SQL, "op7_repeated_strings": REPEATS_SQL, "op9_warc_index_merge": WARC_SQL}


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.i, l.line, r.key IS NOT NULL AND l.doc_id <> r.last AS dropped FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

REPEATS_SQL = r"""
WITH docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), strings AS (
  SELECT doc_id, i, md5(b[i : i + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM docs WHERE n >= 100)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1
), marked AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again)
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 99 AS hi FROM marked GROUP BY doc_id, span
), kept AS (
  SELECT s.doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, max(hi) AS last,
    string_agg(CASE WHEN lo > before + 1 THEN hex(b[before + 1 : lo - 1]) ELSE '' END, '' ORDER BY lo) AS parts
  FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans) s JOIN docs USING (doc_id) GROUP BY s.doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN last IS NULL THEN b ELSE unhex(parts || CASE WHEN last < n THEN hex(b[last + 1 : n]) ELSE '' END) END) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


WARC_SQL = r"""
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest, regexp_extract(url, '^[a-z]+://(?:www[.])?([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 3155760000), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM pages
), captures AS (
  SELECT page_id, strlen(payload) AS payload_bytes, captured, max(page_id) OVER (PARTITION BY payload) AS chosen,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(digest, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
    lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END) AS url_key
  FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> chosen THEN chosen END AS refers_to, url_key, captured, row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) AS history_no
FROM captures
"""
