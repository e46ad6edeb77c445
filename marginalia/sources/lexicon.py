"""Vocabularies: format-lexicon JSON to a small table, and features classified by it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of feature classes.
CLASSES = {"block": "Block", "inline": "InlineMark", "inlineMark": "InlineMark", "entity": "Entity", "comment": "Comment", "meta": "Meta"}
SCHEMA = "key string, feature_class string, expand_start boolean, expand_end boolean, void boolean"


def entries(lexicon: str | dict) -> list[tuple]:
    """Rows of one lexicon. An unknown class is an inline mark; a type with @version is listed with and without it."""
    d = json.loads(lexicon) if isinstance(lexicon, str) else lexicon
    out = []
    for f in d.get("features") or []:
        if "typeId" not in f:
            raise ValueError("a feature without typeId")
        row = (CLASSES.get(f.get("featureClass", ""), "InlineMark"), bool(f.get("expandStart")), bool(f.get("expandEnd")), bool(f.get("void")))
        keys = [f["typeId"]]
        if "@" in f["typeId"]:
            head, _, tail = f["typeId"].rpartition("@")
            keys.append(head + ("#" + tail.split("#", 1)[1] if "#" in tail else ""))
        out += [(k, *row) for k in keys]
    return out


def load(spark: SparkSession, lexicons: list[str | dict]) -> DataFrame:
    """The table; a key registered later takes the place of an earlier one."""
    return spark.createDataFrame([tuple(r) for r in {r[0]: r for x in lexicons for r in entries(x)}.values()], SCHEMA)


def classify(features: DataFrame, lexicon: DataFrame) -> DataFrame:
    """features with feature_class, expand_start, expand_end: by type#name, else by type, else an inline mark that does not
    expand; flags on the feature itself come first. Vocabularies are hundreds of rows, which the planner broadcasts."""
    full = lexicon.select(F.col("key").alias("__k1"), F.struct("feature_class", "expand_start", "expand_end").alias("__v1"))
    kind = lexicon.select(F.col("key").alias("__k2"), F.struct("feature_class", "expand_start", "expand_end").alias("__v2"))
    j = features.join(full, F.concat_ws("#", "type_id", "name") == F.col("__k1"), "left").join(kind, F.col("type_id") == F.col("__k2"), "left")
    v = F.coalesce("__v1", "__v2")
    wire = lambda k: F.get_json_object("data", f"$.{k}").cast("boolean")
    return j.select(*features.columns, F.coalesce(v["feature_class"], F.lit("InlineMark")).alias("feature_class"), F.coalesce(wire("expandStart"), v["expand_start"], F.lit(False)).alias("expand_start"), F.coalesce(wire("expandEnd"), v["expand_end"], F.lit(False)).alias("expand_end"))


def annotations(features: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Classified features as (doc_id, ord, kind, type_name, byte_start, byte_end, data) in canonical order."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("byte_start", F.col("byte_end").desc(), "facet_ord", "feat_ord")
    type_name = F.when(F.col("name").isNull(), F.col("type_id")).otherwise(F.concat_ws("#", "type_id", "name"))
    return classify(features, lexicon).select("doc_id", (F.row_number().over(w) - 1).alias("ord"), F.when(F.col("feature_class") == "Block", "Block").otherwise("Inline").alias("kind"), type_name.alias("type_name"), "byte_start", "byte_end", "data")


def schema_counts(lexicon: str | dict) -> dict[str, int]:
    """Vertices and edges of the record schema a lexicon stands for: a record a feature, and its fields."""
    d = json.loads(lexicon) if isinstance(lexicon, str) else lexicon
    features = d.get("features") or []
    fields = sum(len([k for k in f if k != "typeId"]) for f in features)
    return {"vertices": 1 + len(features) + fields, "edges": len(features) + fields}
