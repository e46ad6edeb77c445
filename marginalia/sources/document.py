"""Documents as rows: JSON form, nested form and the exploded features table.

features: doc_id, facet_ord, feat_ord, byte_start, byte_end, type_id, name, data - data is the JSON of all fields but $type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonfn

WIRE = "text string, facets array<struct<index:struct<byteStart:int,byteEnd:int>,features:array<string>>>"
FEATURES = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("facet_ord", "feat_ord", "byte_start", "byte_end")), *(T.StructField(c, T.StringType()) for c in ("type_id", "name", "data"))]
)
FEATURE_COLUMNS = FEATURES.fieldNames()
FIRST_MARKER, NEXT_MARKER = "￼", "\n"
VERSION = "0.1.0"


def parse(doc: Column, strict: bool = True) -> Column:
    """JSON text to the nested form; malformed JSON raises, or gives null where not strict."""
    return F.from_json(doc, WIRE, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Text without features, in nested form."""
    return df.withColumn("doc", F.struct(F.col(text).alias("text"), F.array().cast(T.StructType.fromDDL(WIRE)["facets"].dataType).alias("facets")))


def feature_rows(df: DataFrame, doc: str = "doc", doc_id: str = "doc_id") -> DataFrame:
    """The flat view of a nested column: a row a feature, in order."""
    facets = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.col(f"{doc}.facets")).alias("facet_ord", "facet"))
    rows = facets.select("doc_id", "facet_ord", F.col("facet.index.byteStart").alias("byte_start"), F.col("facet.index.byteEnd").alias("byte_end"), F.posexplode("facet.features").alias("feat_ord", "json"))
    parsed = rows.withColumn("m", jsonfn.as_map(F.col("json")))  # parsed once
    text = lambda k: F.try_variant_get(F.element_at("m", F.lit(k)), "$", "string")
    name = F.when(F.schema_of_variant(F.element_at("m", F.lit("name"))) == "STRING", text("name"))
    return parsed.select("doc_id", "facet_ord", "feat_ord", "byte_start", "byte_end", text("$type").alias("type_id"), name.alias("name"), jsonfn.as_json(jsonfn.without_keys(F.col("m"), ["$type"])).alias("data"))


def scalars(df: DataFrame, type_id: str, name: str | None = None, doc: str = "doc") -> DataFrame:
    """(doc_id, n_chars, n_bytes, n_features, has_mark) of a nested column: what the SQL scalars give, from one parse."""
    facets, text = F.col(f"{doc}.facets"), F.col(f"{doc}.text")
    kind, own = (lambda x: F.get_json_object(x, "$.$type")), (lambda x: F.get_json_object(x, "$.name"))
    whole = lambda x: (kind(x) == type_id) & (F.coalesce(own(x) == name, F.lit(False)) if name is not None else F.lit(True))
    split = lambda x: F.coalesce(F.concat_ws("#", kind(x), own(x)) == type_id, F.lit(False)) if name is None and "#" in type_id else F.lit(False)
    count = F.aggregate(facets, F.lit(0), lambda n, f: n + F.size(f["features"]))
    found = F.exists(facets, lambda f: F.exists(f["features"], lambda x: F.coalesce(whole(x), F.lit(False)) | split(x)))
    return df.select("doc_id", F.char_length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"), F.coalesce(count, F.lit(0)).alias("n_features"), F.coalesce(found, F.lit(False)).cast("int").alias("has_mark"))


def nest(features: DataFrame, docs: DataFrame) -> DataFrame:
    """Back to (doc_id, doc JSON). Features of one facet stay together; a document without features has no facets key."""
    body = F.regexp_replace(F.col("data"), r"^\{", "")
    typed = F.concat(F.lit('{"$type":'), F.regexp_extract(F.expr("to_json(named_struct('v', type_id))"), r'^\{"v":(.*)\}$', 1), F.when(body == "}", body).otherwise(F.concat(F.lit(","), body)))
    rows = features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("byte_start", (-F.col("byte_end")).alias("e"), "facet_ord", "feat_ord", typed.alias("j")))).alias("fs"))

    def piece(x: Column, i: Column) -> Column:
        """A feature, and before the first of a facet the end of the one before and its own head."""
        last = F.try_element_at(F.col("fs"), i)
        head = F.concat(F.lit('{"index":{"byteStart":'), x["byte_start"], F.lit(',"byteEnd":'), -x["e"], F.lit('},"features":['))
        same = (last["byte_start"] == x["byte_start"]) & (last["e"] == x["e"]) & (last["facet_ord"] == x["facet_ord"])
        return F.concat(F.when(i == 0, head).when(same, F.lit(",")).otherwise(F.concat(F.lit("]},"), head)), x["j"])

    whole = rows.withColumn("facets", F.concat(F.array_join(F.transform("fs", piece), ""), F.lit("]}")))
    quoted = F.regexp_extract(F.expr("to_json(named_struct('v', text))"), r'(?s)^\{"v":(.*)\}$', 1)
    facets = F.when(F.col("facets").isNull(), F.lit("")).otherwise(F.concat(F.lit(',"facets":['), F.col("facets"), F.lit("]")))
    return docs.join(whole, "doc_id", "left").select("doc_id", F.concat(F.lit('{"text":'), quoted, facets, F.lit("}")).alias("doc"))


def lines_to_blocks(docs: DataFrame, type_id: str, name: str = "paragraph") -> tuple[DataFrame, DataFrame]:
    """Plain text: every line is a block. Returns (docs with markers in the text, features)."""
    marked = docs.select("doc_id", F.concat(F.lit(FIRST_MARKER), F.coalesce("text", F.lit(""))).alias("text"))
    # of each line its bytes; a running sum places it. Lines of a document are summed within the row, so nothing is shuffled
    sizes = F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.octet_length(x))
    starts = F.aggregate(sizes, F.array(F.lit(-1)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)))
    first = len(FIRST_MARKER.encode())
    rows = marked.select("doc_id", F.posexplode(F.slice(starts, F.lit(1), F.size(sizes))).alias("facet_ord", "at"))
    start = F.when(F.col("facet_ord") == 0, 0).otherwise(F.col("at"))
    features = rows.select("doc_id", "facet_ord", F.lit(0).alias("feat_ord"), start.cast("int").alias("byte_start"), F.when(F.col("facet_ord") == 0, first).otherwise(start + 1).cast("int").alias("byte_end"), F.lit(type_id).alias("type_id"), F.lit(name).alias("name"), F.lit(f'{{"name":"{name}","parents":[]}}').alias("data"))
    return marked, features
