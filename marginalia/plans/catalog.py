"""Registered queries of the document engine and their SQL twins; each goes over its whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, offsets
from ..lens import Lens, LensGraph, apply_lens, apply_lens_to_docs, inverse, trace_lens
from ..operators import blocks as blk
from ..operators import edit, facet_sql, hir, layers, normalize
from ..sources import document
from ..sources.formats import convert, lens_to_hub, read_format, round_trip
from ..streaming import edits
from .sample import SPACE, SQL, annotated, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
COLUMNS = ["doc_id", "facet_ord", "byte_start", "byte_end", "name"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = SQL + sql if not sql.lstrip().startswith("--plain") else sql.replace("--plain", "")
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return annotated(table(spark, sf_dir, "documents"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages imported from HTML, brought to the common vocabulary, and counted by kind of feature."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw"))
    _, features = read_format(pages, "html")
    return apply_lens(features, lens_to_hub("html")).groupBy("type_id", "name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


# -- documents, features, scalars -------------------------------------------------------------------------------------


@query("SELECT T.doc_id, CAST(length(T.text) AS INTEGER) AS n_chars, CAST(strlen(T.text) AS INTEGER) AS n_bytes, CAST(count(X.doc_id) AS INTEGER) AS n_features, max(CASE WHEN X.name = 'bold' THEN 1 ELSE 0 END) AS has_bold FROM T LEFT JOIN X USING (doc_id) GROUP BY T.doc_id, T.text")
def document_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON, parsed once for all scalars."""
    docs, features = _base(spark, sf_dir)
    nested = document.nest(features, docs).select("doc_id", document.parse(F.col("doc")).alias("doc"))
    return document.scalars(nested, SPACE, "bold").withColumnRenamed("has_mark", "has_bold")


def _json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, features = _base(spark, sf_dir)
    facet_sql.register_functions(spark)
    return document.nest(features, docs)


@query("SELECT T.doc_id, CAST(length(T.text) AS INTEGER) AS n_chars, CAST(count(X.doc_id) AS INTEGER) AS n_features, max(CASE WHEN X.name = 'bold' THEN 1 ELSE 0 END) AS has_bold, '0.1.0' AS version FROM T LEFT JOIN X USING (doc_id) GROUP BY T.doc_id, T.text")
def sql_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL scalar functions."""
    return _json_docs(spark, sf_dir).selectExpr("doc_id", "rt_char_length(doc) AS n_chars", "rt_feature_count(doc) AS n_features", f"rt_has_mark(doc, '{SPACE}#bold') AS has_bold", "rt_version() AS version")


@query("SELECT doc_id, block_index, 'paragraph' AS name, '[\"root\"]' AS parents, content AS text FROM B")
def sql_blocks_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function of blocks, lateral to its document."""
    return spark.sql("SELECT d.doc_id, b.block_index, b.name, b.parents, b.text FROM {d} d, LATERAL rt_blocks(d.doc) b", d=_json_docs(spark, sf_dir))


#: The digest is made once a document, below the table function.
_DOC_ROWS = "SELECT d.doc_id, f.byte_start, f.byte_end, f.name, d.digest FROM (SELECT *, md5(rt_text(doc)) AS digest FROM {d}) d, LATERAL rt_facets(d.doc) f"


@query("SELECT X.doc_id, CASE WHEN byte_start >= 3 THEN byte_start + 2 ELSE byte_start END AS byte_start, CASE WHEN byte_start >= 3 OR byte_end > 3 THEN byte_end + 2 ELSE byte_end END AS byte_end, name, md5('￼é' || substr(T.text, 2)) AS digest FROM X JOIN T USING (doc_id)")
def sql_insert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DOC_ROWS, d=_json_docs(spark, sf_dir).selectExpr("doc_id", "rt_insert_text(doc, 3, 'é') AS doc"))


@query("""SELECT doc_id, s AS byte_start, e AS byte_end, name, md5(CASE WHEN n <= 3 THEN text ELSE '￼' || substr(text, 7) END) AS digest FROM (
  SELECT X.*, n, text, CASE WHEN n <= 3 THEN byte_start WHEN byte_start <= 3 THEN byte_start WHEN byte_start >= n THEN byte_start - (n - 3) ELSE 3 END AS s,
    CASE WHEN n <= 3 THEN byte_end WHEN byte_end <= 3 THEN byte_end WHEN byte_end >= n THEN byte_end - (n - 3) ELSE 3 END AS e
  FROM X JOIN (SELECT doc_id, text, CAST(strlen(substr(text, 1, 6)) AS INTEGER) AS n FROM T) USING (doc_id)) WHERE n <= 3 OR s < e""")
def sql_delete_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DOC_ROWS, d=_json_docs(spark, sf_dir).selectExpr("doc_id", "rt_delete_text(doc, 3, octet_length(substring(rt_text(doc), 1, 6))) AS doc"))


@query("SELECT doc_id, byte_start, byte_end, name FROM X WHERE NOT (name = 'paragraph' AND idx = 0)")
def sql_remove_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT d.doc_id, f.byte_start, f.byte_end, f.name FROM {d} d, LATERAL rt_facets(d.doc) f", d=_json_docs(spark, sf_dir).selectExpr("doc_id", f"rt_remove_mark(doc, 0, 3, '{SPACE}#paragraph') AS doc"))


@query("SELECT doc_id, byte_start, byte_end, CASE name WHEN 'bold' THEN 'strong' ELSE name END AS name FROM X WHERE name <> 'italic'")
def sql_apply_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = json.dumps(_lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "italic"}, "replace": None}]).to_json())
    return spark.sql("SELECT d.doc_id, f.byte_start, f.byte_end, f.name FROM {d} d, LATERAL rt_facets(d.doc) f", d=_json_docs(spark, sf_dir).select("doc_id", F.call_udf("rt_apply_lens", "doc", F.lit(lens)).alias("doc")))


@query(f"SELECT doc_id, byte_start, byte_end, '{SPACE}' AS type_id, name, href FROM X")
def rt_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat view: a row a feature, by exploding the nested form."""
    docs, features = _base(spark, sf_dir)
    rows = document.feature_rows(document.nest(features, docs).select("doc_id", document.parse(F.col("doc")).alias("doc")))
    return rows.select("doc_id", "byte_start", "byte_end", "type_id", "name", F.get_json_object("data", "$.attrs.href").alias("href"))


@query(f"SELECT doc_id, byte_start, byte_end, name FROM X WHERE name = 'link'")
def rt_facets_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL, lateral to its document."""
    docs, features = _base(spark, sf_dir)
    facet_sql.register_functions(spark)
    return spark.sql("SELECT d.doc_id, f.byte_start, f.byte_end, f.name FROM {d} d, LATERAL rt_facets(d.doc) f WHERE f.name = 'link'", d=document.nest(features, docs))


@query("SELECT doc_id, block_index, content_start, content_end, content AS text FROM B")
def rt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blk.blocks(*_base(spark, sf_dir)).select("doc_id", F.col("block_index").cast("int").alias("block_index"), "content_start", "content_end", "text")


@query("SELECT d.lang, count(*) AS n_blocks, max(length(B.content)) AS longest FROM B JOIN documents d USING (doc_id) GROUP BY d.lang")
def paragraph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blk.blocks(*_base(spark, sf_dir))
    return b.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n_blocks"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT doc_id, content AS text, 0 AS block_index FROM B WHERE block_index = 0")
def first_block_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blk.first_block(blk.blocks(*_base(spark, sf_dir)), "paragraph").select("doc_id", "text", F.col("block_index").cast("int").alias("block_index"))


@query("SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM X GROUP BY name")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    return f.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT doc_id, facet_ord, byte_start, byte_end, name FROM X")
def facet_namespace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    other = f.withColumn("type_id", F.lit("com.example.other"))
    return normalize.filter_namespace(f.unionByName(other), "org.marginalia").select(COLUMNS)


@query("SELECT doc_id, count(*) AS n FROM X WHERE name = 'link' GROUP BY doc_id")
def has_mark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    return f.where(normalize.has_mark(f, f"{SPACE}#link")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT X.doc_id, facet_ord, decode(encode(T.text)[byte_start + 1 : byte_end]) AS part, CAST(length(decode(encode(T.text)[1 : byte_start])) AS INTEGER) AS char_start FROM X JOIN T USING (doc_id) WHERE name = 'link'")
def text_at_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    j = f.where("name = 'link'").join(docs, "doc_id")
    return j.select("doc_id", "facet_ord", offsets.text_at(F.col("text"), F.col("byte_start"), F.col("byte_end")).alias("part"), offsets.byte_to_char(F.col("text"), F.col("byte_start")).alias("char_start"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(strlen(text) AS INTEGER) AS n_bytes, CAST(strlen(substr(text, 1, length(text) // 2)) AS INTEGER) AS half_bytes FROM T")
def char_byte_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _base(spark, sf_dir)
    half = F.floor(F.char_length("text") / 2).cast("int")
    return docs.select("doc_id", offsets.byte_to_char(F.col("text"), F.octet_length("text")).alias("n_chars"), offsets.char_to_byte(F.col("text"), F.char_length("text")).alias("n_bytes"), offsets.char_to_byte(F.col("text"), half).alias("half_bytes"))


_TOKEN_SQL = r'''regexp_extract_all(text, 'https?://[^\s,"'']+|@[A-Za-z0-9._-]+|#[A-Za-z0-9_-]+')'''


def _tokens(text: Column, doc_id: Column, mark: str) -> Column:
    """Texts with a mention, a tag and a link in front, and every further word marked."""
    return F.concat(F.lit("See @u"), doc_id.cast("string"), F.lit(". #t"), (doc_id % 7).cast("string"), F.lit(" (https://e.org/p"), doc_id.cast("string"), F.lit("?a=#b). "), F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(f" {mark}")))


def _tokens_sql(doc_id: str, mark: str, rows: str) -> str:
    return f"""--plain
WITH D AS (
  SELECT {doc_id} AS doc_id, 'See @u' || {doc_id} || '. #t' || {doc_id} % 7 || ' (https://e.org/p' || {doc_id} || '?a=#b). ' || replace(coalesce(text, ''), ' ', ' {mark}') AS text FROM {rows}
), M AS (
  SELECT doc_id, unnest({_TOKEN_SQL}) AS raw, generate_subscripts({_TOKEN_SQL}, 1) - 1 AS ord FROM D
), K AS (
  SELECT doc_id, CAST(ord AS INTEGER) AS ord, CASE WHEN raw[1] = '@' THEN 'mention' WHEN raw[1] = '#' THEN 'tag' ELSE 'link' END AS kind,
    CASE WHEN raw[1] IN ('@', '#') THEN substr(raw, 2) ELSE regexp_replace(raw, '[.!?)]+$', '') END AS value FROM M WHERE NOT (raw[1] = '@' AND raw LIKE '%.')
)
"""


@query(_tokens_sql("(conv_id * 1000 + turn)", "@", "conversations") + "SELECT * FROM K")
def detect_tokens_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return detect.detect(turns.select("doc_id", _tokens(F.col("text"), F.col("doc_id"), "@").alias("text"))).select("doc_id", F.col("ord").cast("int").alias("ord"), "kind", "value")


@query(_tokens_sql("doc_id", "#", "documents") + "SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM K GROUP BY kind")
def detect_tokens_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = detect.detect(docs.select("doc_id", _tokens(F.col("text"), F.col("doc_id"), "#").alias("text")))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum(F.octet_length("value")).alias("bytes"))


# -- order, grouping, validation --------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY byte_start, byte_end DESC, facet_ord) - 1 AS INTEGER) AS facet_ord, byte_start, byte_end, name FROM X")
def canonical_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    return normalize.sort_features(f).select(COLUMNS)


def _halves(f: DataFrame) -> DataFrame:
    """Each bold mark of two bytes or more as two marks that touch."""
    bold = f.where("name = 'bold' and byte_end - byte_start > 1")
    left = bold.withColumn("byte_end", F.col("byte_start") + 1)
    right = bold.withColumn("byte_start", F.col("byte_start") + 1).withColumn("facet_ord", F.col("facet_ord") + 1)
    return left.unionByName(right)


@query("SELECT doc_id, byte_start, byte_end, name FROM X WHERE name = 'bold' AND byte_end - byte_start > 1")
def coalesce_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    return normalize.normalize(_halves(f)).select("doc_id", "byte_start", "byte_end", "name")


@query("SELECT doc_id, byte_start, byte_end, CAST(2 AS BIGINT) AS n FROM X WHERE name <> 'paragraph' AND byte_end > byte_start")
def group_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    marks = f.where("name <> 'paragraph'")
    twice = marks.unionByName(marks.withColumn("facet_ord", F.col("facet_ord") + 100_000))
    return normalize.group_ranges(twice).groupBy("doc_id", "facet_ord", "byte_start", "byte_end").agg(F.count(F.lit(1)).alias("n")).drop("facet_ord")


@query("""SELECT doc_id, facet_ord, CASE name WHEN 'link' THEN 'inverted_range' WHEN 'italic' THEN 'out_of_bounds' ELSE CASE WHEN idx = 0 THEN 'not_on_boundary' ELSE 'marker_width' END END AS problem FROM X WHERE name <> 'bold'
UNION ALL SELECT doc_id, 0, 'overlapping_blocks' FROM X WHERE name = 'paragraph' AND idx = 1""")
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the five problems: links turned round, italics run over, first blocks begin within a character, second ones
    before them, others have no marker."""
    docs, f = _base(spark, sf_dir)
    block = lambda n: (F.col("name") == "paragraph") & (F.col("facet_ord") == n)
    start = F.when(F.col("name") == "link", F.col("byte_end") + 1).when(block(0), 1).when(block(3), 0).when(F.col("name") == "paragraph", F.col("byte_end")).otherwise(F.col("byte_start"))
    end = F.when(F.col("name") == "italic", 1_000_000_000).otherwise(F.col("byte_end"))
    return normalize.validate(docs, f.withColumns({"byte_start": start, "byte_end": end}))


# -- edits ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, facet_ord, CASE WHEN byte_start >= 3 THEN byte_start + 2 ELSE byte_start END AS byte_start, CASE WHEN byte_start >= 3 OR byte_end > 3 THEN byte_end + 2 ELSE byte_end END AS byte_end, name FROM X")
def insert_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    changes = docs.select("doc_id", F.lit(3).alias("pos"), F.lit("é").alias("ins"))
    return edit.insert_text(docs, f, changes)[1].select(COLUMNS)


@query("SELECT doc_id, CAST(strlen(text) + 2 AS INTEGER) AS n_bytes, md5('￼é' || substr(text, 2)) AS digest FROM T")
def insert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    changes = docs.select("doc_id", F.lit(3).alias("pos"), F.lit("é").alias("ins"))
    return edit.insert_text(docs, f, changes)[0].select("doc_id", F.octet_length("text").alias("n_bytes"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("""SELECT doc_id, facet_ord, s AS byte_start, e AS byte_end, name FROM (
  SELECT X.*, n, CASE WHEN n <= 3 THEN byte_start WHEN byte_start <= 3 THEN byte_start WHEN byte_start >= n THEN byte_start - (n - 3) ELSE 3 END AS s,
    CASE WHEN n <= 3 THEN byte_end WHEN byte_end <= 3 THEN byte_end WHEN byte_end >= n THEN byte_end - (n - 3) ELSE 3 END AS e
  FROM X JOIN (SELECT doc_id, CAST(strlen(substr(text, 1, 6)) AS INTEGER) AS n FROM T) USING (doc_id)) WHERE n <= 3 OR s < e""")
def delete_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    changes = docs.select("doc_id", F.lit(3).alias("lo"), F.octet_length(F.substring("text", 1, 6)).alias("hi"))
    return edit.delete_text(docs, f, changes)[1].select(COLUMNS)


@query("SELECT X.doc_id, facet_ord, CASE WHEN byte_start >= 3 THEN byte_start + 1 ELSE byte_start END AS byte_start, CASE WHEN byte_start >= 3 OR byte_end > 3 THEN byte_end + 1 ELSE byte_end END AS byte_end, name, md5('￼y' || substr(T.text, 2)) AS digest FROM X JOIN T USING (doc_id)")
def two_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of each document, one after the other."""
    docs, f = _base(spark, sf_dir)
    steps = [{"op": "insertText", "byte_pos": 3, "text": "xy"}, {"op": "deleteText", "byte_start": 3, "byte_end": 4}]
    changes = docs.select("doc_id", F.posexplode(F.array(*[F.lit(json.dumps(x)) for x in steps])).alias("seq", "mutation"))
    d, g = edits.apply_mutations(changes, docs, f, SPACE)
    return g.join(d, "doc_id").select(*COLUMNS, F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT doc_id, facet_ord, byte_start, byte_end, name FROM X WHERE NOT (name = 'bold' AND idx = 0)")
def remove_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    gone = f.where("facet_ord = 1").select("doc_id", "byte_start", "byte_end", F.concat_ws("#", "type_id", "name").alias("key"))
    return edit.remove_mark(f, gone).select(COLUMNS)


@query("SELECT name, count(*) AS n FROM (SELECT name FROM X UNION ALL SELECT 'comment' FROM T) GROUP BY name")
def add_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    marks = docs.select("doc_id", F.lit(0).alias("byte_start"), F.octet_length("text").alias("byte_end"), F.lit(SPACE).alias("type_id"), F.lit("comment").alias("name"), F.lit(edit.mark_data("comment")).alias("data"))
    return edit.add_mark(f, marks).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# -- lenses -----------------------------------------------------------------------------------------------------------

TARGET = "com.example.facet"


def _lens(rules: list[dict], passthrough: str = "keep", **more: object) -> Lens:
    return Lens.from_json({"id": "example", "source": SPACE, "target": TARGET, "rules": rules, "passthrough": passthrough} | more)


def _shown(f: DataFrame) -> DataFrame:
    return f.select("doc_id", "facet_ord", "byte_start", "byte_end", "type_id", "name")


@query(f"SELECT doc_id, facet_ord, byte_start, byte_end, CASE WHEN name IN ('bold', 'italic') THEN '{TARGET}' ELSE '{SPACE}' END AS type_id, CASE name WHEN 'bold' THEN 'strong' WHEN 'italic' THEN 'emphasis' ELSE name END AS name FROM X")
def lens_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "italic"}, "replace": {"name": "emphasis"}}])
    return _shown(apply_lens(_base(spark, sf_dir)[1], lens))


@query(f"SELECT doc_id, facet_ord, byte_start, byte_end, '{TARGET}' AS type_id, 'strong' AS name FROM X WHERE name = 'bold'")
def lens_drop_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "italic"}, "replace": None}], "drop")
    return _shown(apply_lens(_base(spark, sf_dir)[1], lens))


@query(f"SELECT doc_id, facet_ord, CASE WHEN name = 'link' AND level = 2 AND open THEN 'a2' ELSE name END AS name FROM X")
def lens_match_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "link", "matchAttrs": {"level": 2, "open": True}}, "replace": {"name": "a2"}}, {"match": {"name": "link", "matchAttrs": {"level": "3"}}, "replace": {"name": "wrong"}}])
    return apply_lens(_base(spark, sf_dir)[1], lens).select("doc_id", "facet_ord", "name")


@query(f"SELECT doc_id, facet_ord, CASE WHEN name = 'link' AND level IN (1, 3) THEN 'odd' WHEN name = 'link' THEN 'even' ELSE name END AS name FROM X")
def lens_match_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "link", "matchAttrsAny": {"level": [1, 3]}}, "replace": {"name": "odd"}}, {"match": {"name": "link", "matchAttrsAll": {"level": [2]}}, "replace": {"name": "even"}}])
    return apply_lens(_base(spark, sf_dir)[1], lens).select("doc_id", "facet_ord", "name")


@query("SELECT doc_id, facet_ord, CASE WHEN name = 'link' THEN 'h' || level || '-{none}' ELSE name END AS name FROM X")
def lens_template_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "link"}, "replace": {"name": {"template": "h{level}-{none}"}}}])
    return apply_lens(_base(spark, sf_dir)[1], lens).select("doc_id", "facet_ord", "name")


@query("SELECT doc_id, facet_ord, href AS url, CAST(NULL AS VARCHAR) AS level, CASE WHEN name = 'link' THEN 'new' END AS rel FROM X")
def lens_attr_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rename, add and keep in their fixed order."""
    lens = _lens([{"match": {"name": "link"}, "replace": {"renameAttrs": {"href": "url"}, "addAttrs": {"rel": "new"}, "keepAttrs": ["url", "rel"]}}])
    f = apply_lens(_base(spark, sf_dir)[1], lens)
    return f.select("doc_id", "facet_ord", *[F.get_json_object("data", f"$.attrs.{k}").alias(k) for k in ("url", "level", "rel")])


@query("SELECT doc_id, facet_ord, CASE WHEN name = 'link' THEN CAST(level * 2 AS VARCHAR) END AS level, CASE WHEN name = 'link' THEN CASE WHEN open THEN 'false' ELSE 'true' END END AS open, 'p:' || href AS href FROM X")
def lens_map_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "link"}, "replace": {"mapAttrValue": {"level": {"op": "multiply", "value": 2}, "open": {"op": "negate"}, "href": {"op": "prefix", "value": "p:"}}}}])
    f = apply_lens(_base(spark, sf_dir)[1], lens)
    return f.select("doc_id", "facet_ord", *[F.get_json_object("data", f"$.attrs.{k}").alias(k) for k in ("level", "open", "href")])


@query("SELECT doc_id, facet_ord, CASE WHEN name = 'paragraph' THEN '[\"body\"]' END AS parents FROM X")
def lens_parent_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "root"}, "replace": {"name": "body"}}])
    return apply_lens(_base(spark, sf_dir)[1], lens).select("doc_id", "facet_ord", F.get_json_object("data", "$.parents").alias("parents"))


@query("SELECT doc_id, facet_ord, CASE name WHEN 'bold' THEN 'b' WHEN 'link' THEN 'anchor' ELSE name END AS name FROM X WHERE name <> 'italic'")
def lens_compose_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path through a graph of vocabularies, as one composed lens."""
    graph = LensGraph()
    graph.register(_lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "italic"}, "replace": {"name": "em"}}, {"match": {"name": "link"}, "replace": {"name": "a"}}, {"match": {}, "replace": {}}]))
    graph.register(Lens.from_json({"id": "second", "source": TARGET, "target": "com.example.third", "rules": [{"match": {"name": "strong"}, "replace": {"name": "b"}}, {"match": {"name": "em"}, "replace": None}, {"match": {"name": "a"}, "replace": {"name": "anchor"}}, {"match": {}, "replace": {}}]}))
    return apply_lens(_base(spark, sf_dir)[1], graph.find_path(SPACE, "com.example.third")).select("doc_id", "facet_ord", "name")


@query("SELECT doc_id, facet_ord, name, href FROM X")
def lens_inverse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "link"}, "replace": {"name": "a", "renameAttrs": {"href": "url"}, "mapAttrValue": {"level": {"op": "add", "value": 3}}}}])
    f = apply_lens(apply_lens(_base(spark, sf_dir)[1], lens), inverse(lens))
    return f.select("doc_id", "facet_ord", "name", F.get_json_object("data", "$.attrs.href").alias("href"))


@query("SELECT 0 AS rule_index, count(*) AS matched, 'replace' AS action FROM X WHERE name = 'bold' UNION ALL SELECT 1, count(*), 'drop' FROM X WHERE name = 'link'")
def lens_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lens([{"match": {"name": "bold"}, "replace": {"name": "strong"}}, {"match": {"name": "link"}, "replace": None}])
    return trace_lens(_base(spark, sf_dir)[1], lens).select("rule_index", "matched", "action")


@query("SELECT X.doc_id, byte_start, byte_end, 'mention' AS name, href || '!' AS handle FROM X WHERE name = 'link'")
def lens_join_same_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of one range become a third; the facets they came from go."""
    _, f = _base(spark, sf_dir)
    links = f.where("name = 'link'")
    spans = links.withColumn("name", F.lit("span")).withColumn("data", F.lit('{"name":"span"}')).withColumn("facet_ord", F.col("facet_ord") + 100_000)
    rule = {"primary": {"name": "span"}, "joined": [{"name": "link", "alias": "l", "required": True}], "produce": {"name": {"from": "literal", "value": "mention"}, "typeId": TARGET, "attrs": {"handle": {"from": "joinedAttr", "alias": "l", "attr": "href", "transform": {"ops": [{"op": "suffix", "value": "!"}]}}}}, "deleteMatched": ["link", "span"]}
    lens = Lens("join", SPACE, TARGET, (Lens.from_json({"id": "x", "source": SPACE, "target": TARGET, "rules": [{"join": rule}]}).rules[0],))
    return apply_lens(links.unionByName(spans), lens).select("doc_id", "byte_start", "byte_end", "name", F.get_json_object("data", "$.handle").alias("handle"))


@query("SELECT T.doc_id, CAST(strlen(T.text) - coalesce(sum(X.byte_end - X.byte_start), 0) AS INTEGER) AS n_bytes FROM T LEFT JOIN X ON X.doc_id = T.doc_id AND X.name = 'link' GROUP BY T.doc_id, T.text")
def lens_delete_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    lens = _lens([{"match": {"name": "link"}, "replace": None, "deleteText": True}])
    return apply_lens_to_docs(docs, f, lens)[0].select("doc_id", F.octet_length("text").alias("n_bytes"))


# -- statements over features -----------------------------------------------------------------------------------------


@query("SELECT doc_id, facet_ord, CASE WHEN name = 'bold' THEN 'strong' ELSE name END AS name, CASE WHEN name = 'bold' THEN 'strong' ELSE name END AS data_name FROM X WHERE name <> 'italic'")
def facet_sql_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    out, _ = facet_sql.apply_facet_sql(f, "UPDATE features SET name = 'strong' WHERE name = 'bold'; DELETE FROM features WHERE name = 'italic'")
    return out.select("doc_id", "facet_ord", "name", F.get_json_object("data", "$.name").alias("data_name"))


@query("SELECT doc_id, byte_start, byte_end, 'copy' AS name FROM X WHERE name = 'link' UNION ALL SELECT doc_id, byte_start, byte_end, name FROM X")
def facet_sql_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    out, _ = facet_sql.apply_facet_sql(f, "INSERT INTO features (doc_id, byte_start, byte_end, type_id, name) SELECT doc_id, byte_start, byte_end, type_id, 'copy' FROM features WHERE name = 'link'")
    return out.select("doc_id", "byte_start", "byte_end", "name")


@query("SELECT name, count(*) AS n, CAST(sum(byte_end - byte_start) AS BIGINT) AS bytes FROM X GROUP BY name")
def facet_sql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _base(spark, sf_dir)
    return facet_sql.apply_facet_sql(f, "SELECT name, count(*) AS n, sum(byte_end - byte_start) AS bytes FROM features GROUP BY name")[1][0]


@query("SELECT doc_id, facet_ord, 'features' AS name, '{\"a\":\"features, {x}\",\"n\":' || byte_end || '}' AS made FROM X WHERE name = 'bold'")
def facet_sql_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals that look like the table or like placeholders; json_object."""
    _, f = _base(spark, sf_dir)
    return facet_sql.apply_facet_sql(f, "UPDATE features SET name = 'features' WHERE name = 'bold'; SELECT doc_id, facet_ord, name, json_object('a', 'features, {x}', 'n', byte_end) AS made FROM features WHERE name = 'features'")[1][0]


# -- segments and trees -----------------------------------------------------------------------------------------------


@query("""SELECT B.doc_id, B.block_index, CAST(count(*) AS BIGINT) AS n_marks, CAST(min(greatest(X.byte_start, content_start) - content_start) AS INTEGER) AS first_start
FROM B JOIN X ON X.doc_id = B.doc_id AND X.name <> 'paragraph' AND X.byte_start < B.content_end AND X.byte_end > B.content_start GROUP BY B.doc_id, B.block_index""")
def block_facets_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    met = blk.block_facets(blk.blocks(docs, f), f)
    return met.groupBy("doc_id", F.col("block_index").cast("int").alias("block_index")).agg(F.count(F.lit(1)).alias("n_marks"), F.min("mark_start").alias("first_start"))


@query("""SELECT doc_id, block_index, CAST(lag_ AS INTEGER) AS seg_start, CAST(cut AS INTEGER) AS seg_end FROM (
  SELECT doc_id, block_index, cut, lag(cut) OVER (PARTITION BY doc_id, block_index ORDER BY cut) AS lag_ FROM (
    SELECT doc_id, block_index, 0 AS cut FROM B UNION SELECT doc_id, block_index, content_end - content_start FROM B
    UNION SELECT X.doc_id, B.block_index, X.byte_start - B.content_start FROM X JOIN B ON X.doc_id = B.doc_id AND X.idx = B.block_index WHERE X.name <> 'paragraph'
    UNION SELECT X.doc_id, B.block_index, X.byte_end - B.content_start FROM X JOIN B ON X.doc_id = B.doc_id AND X.idx = B.block_index WHERE X.name <> 'paragraph')) WHERE lag_ IS NOT NULL
UNION ALL SELECT doc_id, block_index, 0, 0 FROM B WHERE content_end = content_start""")
def segment_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    return blk.segments(blk.blocks(docs, f), f).select("doc_id", F.col("block_index").cast("int").alias("block_index"), "seg_start", "seg_end")


@query("SELECT name, count(*) AS n, CAST(sum(byte_end - byte_start) AS BIGINT) AS bytes FROM X WHERE name <> 'paragraph' GROUP BY name")
def segment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    m = blk.segments(blk.blocks(docs, f), f).select("content", F.explode("marks").alias("m"))
    return m.groupBy(F.col("m.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query()
def hir_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    b = blk.blocks(docs, f)
    return hir.nodes(b, blk.segments(b, f)).select("doc_id", "node_id", "parent_id", "depth", "kind", "name", "content")


@query("""SELECT B.doc_id, CAST(1 AS BIGINT) AS containers, count(DISTINCT B.block_index) AS blocks, CAST(count(c.cut) FILTER (c.cut > 0) AS BIGINT) AS texts FROM B LEFT JOIN (
  SELECT doc_id, block_index, 0 AS cut FROM B UNION SELECT doc_id, block_index, content_end - content_start FROM B
  UNION SELECT X.doc_id, B.block_index, X.byte_start - B.content_start FROM X JOIN B ON X.doc_id = B.doc_id AND X.idx = B.block_index WHERE X.name <> 'paragraph'
  UNION SELECT X.doc_id, B.block_index, X.byte_end - B.content_start FROM X JOIN B ON X.doc_id = B.doc_id AND X.idx = B.block_index WHERE X.name <> 'paragraph') c ON c.doc_id = B.doc_id AND c.block_index = B.block_index GROUP BY B.doc_id""")
def hir_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees by kind of node: one container, a block a line, a text a segment."""
    docs, f = _base(spark, sf_dir)
    b = blk.blocks(docs, f)
    of = lambda k, n: F.sum((F.col("kind") == k).cast("long")).alias(n)
    return hir.nodes(b, blk.segments(b, f)).groupBy("doc_id").agg(of("container", "containers"), of("block", "blocks"), of("text", "texts"))


@query()
def hir_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, f = _base(spark, sf_dir)
    b = blk.blocks(docs, f)
    return hir.to_json(hir.nodes(b, blk.segments(b, f)))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' blocks under their headings."""
    docs, f = _pages(spark, sf_dir)
    hub = apply_lens(f, lens_to_hub("html"))
    return blk.section_levels(blk.blocks(docs, hub)).select("doc_id", "block_index", "name", "level", "section")


# -- formats ----------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_format(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw")), "html")


@query(r"""--plain
SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<a[\s>]')) AS BIGINT) AS n FROM pages WHERE len(regexp_extract_all(html, '<a[\s>]')) > 0""")
def html_anchor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)[1].where("name = 'a'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("raw")), "html", "markdown")


def _round(name: str) -> Query:
    """Whether what is printed is read as the same text and features, null and empty texts included."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_trip(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw")), name)

    return run


_SAME = "--plain SELECT doc_id, true AS same_text, true AS same_features FROM documents"


@query("--plain SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) + 1 END AS INTEGER) AS n_chars, true AS same_text, true AS same_features FROM documents")
def plaintext_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round("plaintext")(spark, sf_dir)


@query(_SAME)
def markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round("markdown")(spark, sf_dir).drop("n_chars")


@query(_SAME)
def slack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round("slack")(spark, sf_dir).drop("n_chars")


@query(_SAME)
def mediawiki_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round("mediawiki")(spark, sf_dir).drop("n_chars")


# -- annotation layers ------------------------------------------------------------------------------------------------


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, f = _base(spark, sf_dir)
    refs = F.array(F.struct(F.lit("kb").alias("source"), F.concat(F.lit("Q"), (F.col("facet_ord") % 50).cast("string")).alias("identifier")))
    a = f.where("name <> 'paragraph'").select("doc_id", (F.col("facet_ord") % 3).alias("layer_ord"), F.col("facet_ord").cast("string").alias("uuid"), "byte_start", "byte_end", F.col("name").alias("label"), F.col("data").alias("value"), F.lit("t1").alias("ontology_type_ref"), refs.alias("knowledge_refs"))
    kinds = a.select("doc_id", "layer_ord").distinct().select("doc_id", "layer_ord", F.when(F.col("layer_ord") == 1, "span").otherwise("token").alias("kind"), F.lit("ner").alias("subkind"))
    return a, kinds


@query("SELECT doc_id, CAST(facet_ord AS VARCHAR) AS uuid, name AS label FROM X WHERE name <> 'paragraph' AND byte_start <= 20 AND 20 < byte_end")
def stab_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.at(_layers(spark, sf_dir)[0], 20).select("doc_id", "uuid", "label")


@query("SELECT doc_id, CAST(facet_ord AS VARCHAR) AS uuid, name AS label FROM X WHERE name <> 'paragraph' AND byte_start < 100 AND 10 < byte_end")
def overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.in_range(_layers(spark, sf_dir)[0], 10, 100).select("doc_id", "uuid", "label")


@query("SELECT doc_id, CAST(facet_ord AS VARCHAR) AS uuid FROM X WHERE name = 'bold' AND facet_ord % 3 = 1")
def annotation_query_kind_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, kinds = _layers(spark, sf_dir)
    return layers.query(a, kinds, kind="span", subkind="", label="bold").select("doc_id", "uuid")


@query("SELECT 'kb:Q' || (facet_ord % 50) AS key, count(*) AS n_refs, count(DISTINCT doc_id) AS n_docs FROM X WHERE name <> 'paragraph' GROUP BY 1")
def concept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.concept_counts(layers.concept_index(_layers(spark, sf_dir)[0]))


@query("""SELECT 'kb:Q' || (facet_ord % 50) AS key, doc_id, CAST(facet_ord AS VARCHAR) AS uuid FROM X WHERE name <> 'paragraph'
AND facet_ord % 50 IN (SELECT facet_ord % 50 FROM X WHERE doc_id = 1 AND name <> 'paragraph') AND facet_ord % 50 IN (SELECT facet_ord % 50 FROM X WHERE doc_id = 2 AND name <> 'paragraph')""")
def shared_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.shared_concepts(layers.concept_index(_layers(spark, sf_dir)[0]), 1, 2).select("key", "doc_id", "uuid")


@query(f"SELECT doc_id, byte_start, byte_end, '{SPACE}#' || name AS label FROM X")
def to_layers_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.to_layers(_base(spark, sf_dir)[1])[0].select("doc_id", "byte_start", "byte_end", "label")


@query(f"SELECT doc_id, byte_start, byte_end, '{SPACE}' AS type_id, name FROM X")
def layers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = layers.to_layers(_base(spark, sf_dir)[1])
    return layers.from_layers(a, c).select("doc_id", "byte_start", "byte_end", "type_id", "name")


@query("SELECT doc_id, CAST(facet_ord AS VARCHAR) AS uuid, CAST(least(greatest(byte_start - 6, least(byte_start, 4)), byte_start) AS INTEGER) AS byte_start, CAST(least(greatest(byte_end - 6, least(byte_end, 4)), byte_end) AS INTEGER) AS byte_end FROM X WHERE name <> 'paragraph'")
def layer_delete_collapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _layers(spark, sf_dir)
    changes = a.select("doc_id").distinct().select("doc_id", F.lit(4).alias("lo"), F.lit(10).alias("hi"))
    return layers.delete_text(a, changes).select("doc_id", "uuid", "byte_start", "byte_end")


@query("SELECT 't2' AS ontology_type_ref, count(*) AS n FROM X WHERE name <> 'paragraph'")
def ontology_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _layers(spark, sf_dir)
    old = spark.createDataFrame([("t1", "Person")], "uuid string, name string")
    new = spark.createDataFrame([("t2", "person")], "uuid string, name string")
    return layers.migrate(a, layers.migration(old, new)).groupBy("ontology_type_ref").agg(F.count(F.lit(1)).alias("n"))


# -- patches ----------------------------------------------------------------------------------------------------------


@query("--plain SELECT conv_id AS doc_id, CAST(sum(strlen(coalesce(text, '')) + CASE WHEN turn > first_ THEN 1 ELSE 3 END) AS INTEGER) AS n_bytes FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_ FROM conversations) GROUP BY conv_id")
def patch_fold_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as patches that type them one under the other; the fold gives the whole text."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    units = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    at = F.coalesce(F.sum(units + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    p = c.select(F.col("conv_id").alias("doc_id"), F.row_number().over(w).alias("n"), at.alias("at"), "text")
    value = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    marker = p.select("doc_id", (F.col("n") * 2).alias("seq"), F.lit("splice").alias("action"), F.array(F.lit("text"), F.col("at").cast("string")).alias("path"), value(F.when(F.col("n") == 1, "￼").otherwise("\n")).alias("value"), F.lit(0).alias("length"))
    typed = p.select("doc_id", (F.col("n") * 2 + 1).alias("seq"), F.lit("splice").alias("action"), F.array(F.lit("text"), (F.col("at") + 1).cast("string")).alias("path"), value(F.col("text")).alias("value"), F.lit(0).alias("length"))
    docs = p.select("doc_id").distinct().withColumn("text", F.lit(""))
    return edits.apply_patches(marker.unionByName(typed), docs, SPACE).select("doc_id", F.octet_length("text").alias("n_bytes"))


