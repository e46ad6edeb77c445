"""Annotated documents made from the plain tables, the same way in Spark and in SQL: every line is a paragraph block; its
first word is a bold (even lines) or italic (odd lines) mark, its second a link with attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.document import FEATURE_COLUMNS, FIRST_MARKER

SPACE = "org.marginalia.sample.facet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, content, marker_start, marker_end): places by running sums within the row, so nothing is shuffled."""
    parts = F.split(F.concat(F.lit(FIRST_MARKER), F.coalesce("text", F.lit(""))), "\n", -1)
    starts = F.aggregate(F.transform(parts, lambda x: F.octet_length(x)), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(parts.alias("line"), F.slice(starts, F.lit(1), F.size(parts)).alias("at"))).alias("idx", "x"))
    first = F.col("idx") == 0
    content = F.when(first, F.substring("x.line", F.lit(2), F.length("x.line"))).otherwise(F.col("x.line"))
    return rows.select("doc_id", "idx", content.alias("content"), F.when(first, 0).otherwise(F.col("x.at") - 1).cast("int").alias("marker_start"), F.when(first, 3).otherwise(F.col("x.at")).cast("int").alias("marker_end"))


def annotated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with markers, features)."""
    marked = docs.select("doc_id", F.concat(F.lit(FIRST_MARKER), F.coalesce("text", F.lit(""))).alias("text"))
    l = lines(docs)  # noqa: E741
    w1, w2 = F.regexp_extract("content", r"^([^ ]*)", 1), F.regexp_extract("content", r"^[^ ]* ([^ ]+)", 1)
    s1 = F.col("marker_end")
    s2 = s1 + F.octet_length(w1) + 1
    even = F.col("idx") % 2 == 0
    name = F.when(even, "bold").otherwise("italic")
    level = F.col("idx") % 3 + 1
    block = F.struct((F.col("idx") * 3).alias("facet_ord"), F.col("marker_start").alias("byte_start"), s1.alias("byte_end"), F.lit("paragraph").alias("name"), F.lit('{"name":"paragraph","parents":["root"]}').alias("data"))
    mark = F.struct((F.col("idx") * 3 + 1).alias("facet_ord"), s1.alias("byte_start"), (s1 + F.octet_length(w1)).alias("byte_end"), name.alias("name"), F.concat(F.lit('{"name":"'), name, F.lit('"}')).alias("data"))
    link = F.struct((F.col("idx") * 3 + 2).alias("facet_ord"), s2.alias("byte_start"), (s2 + F.octet_length(w2)).alias("byte_end"), F.lit("link").alias("name"), F.concat(F.lit('{"attrs":{"href":"u/'), F.col("idx").cast("string"), F.lit('","level":'), level.cast("string"), F.lit(',"open":'), F.when(even, "true").otherwise("false"), F.lit('},"name":"link"}')).alias("data"))
    rows = l.select("doc_id", F.explode(F.filter(F.array(block, F.when(w1 != "", mark), F.when(w2 != "", link)), lambda x: x.isNotNull())).alias("f"))
    features = rows.select("doc_id", F.col("f.facet_ord").cast("int").alias("facet_ord"), F.lit(0).alias("feat_ord"), F.col("f.byte_start").alias("byte_start"), F.col("f.byte_end").alias("byte_end"), F.lit(SPACE).alias("type_id"), F.col("f.name").alias("name"), F.col("f.data").alias("data"))
    return marked, features.select(FEATURE_COLUMNS)


#: The same in SQL: views L (lines) and X (features; ``href``, ``level`` and ``open`` stand for the data).
SQL = r"""
WITH L0 AS (
  SELECT doc_id, unnest(string_split('￼' || coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split('￼' || coalesce(text, ''), chr(10)), 1) - 1 AS idx
  FROM documents
), L1 AS (
  SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM L0
), L AS (
  SELECT doc_id, CAST(idx AS INTEGER) AS idx, CASE WHEN idx = 0 THEN substr(line, 2) ELSE line END AS content,
    CAST(CASE WHEN idx = 0 THEN 0 ELSE place - 1 END AS INTEGER) AS marker_start, CAST(CASE WHEN idx = 0 THEN 3 ELSE place END AS INTEGER) AS marker_end FROM L1
), W AS (
  SELECT *, regexp_extract(content, '^([^ ]*)', 1) AS w1, regexp_extract(content, '^[^ ]* ([^ ]+)', 1) AS w2 FROM L
), X AS (
  SELECT doc_id, idx, idx * 3 AS facet_ord, marker_start AS byte_start, marker_end AS byte_end, 'paragraph' AS name, NULL AS href, NULL AS level, NULL AS open FROM W
  UNION ALL SELECT doc_id, idx, idx * 3 + 1, marker_end, marker_end + CAST(strlen(w1) AS INTEGER), CASE WHEN idx % 2 = 0 THEN 'bold' ELSE 'italic' END, NULL, NULL, NULL FROM W WHERE w1 <> ''
  UNION ALL SELECT doc_id, idx, idx * 3 + 2, marker_end + CAST(strlen(w1) AS INTEGER) + 1, marker_end + CAST(strlen(w1) + 1 + strlen(w2) AS INTEGER), 'link', 'u/' || idx, idx % 3 + 1, idx % 2 = 0 FROM W WHERE w2 <> ''
), T AS (
  SELECT doc_id, '￼' || coalesce(text, '') AS text FROM documents
), B AS (
  SELECT doc_id, idx AS block_index, content, marker_end AS content_start, CAST(marker_end + strlen(content) AS INTEGER) AS content_end FROM L
)
"""
