"""Canonical order, grouping by range, coalescing of adjacent marks, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.offsets import on_boundary
from ..sources.document import FEATURE_COLUMNS


def canonical(*more: str) -> list[Column]:
    """Start ascending, end descending, then as stored."""
    return [F.col("byte_start"), F.col("byte_end").desc(), F.col("facet_ord"), F.col("feat_ord"), *map(F.col, more)]


def sort_features(features: DataFrame) -> DataFrame:
    """facet_ord renumbered in canonical order; the rows themselves have none."""
    w = Window.partitionBy("doc_id").orderBy(F.col("byte_start"), F.col("byte_end").desc(), F.col("facet_ord"))
    return features.withColumn("facet_ord", (F.dense_rank().over(w) - 1).cast("int")).select(FEATURE_COLUMNS)


def group_ranges(features: DataFrame) -> DataFrame:
    """One facet a range: features of equal ranges follow one another in stored order, repeats kept."""
    w = Window.partitionBy("doc_id").orderBy(F.col("byte_start"), F.col("byte_end").desc())
    own = Window.partitionBy("doc_id", "byte_start", "byte_end").orderBy("facet_ord", "feat_ord")
    ranked = features.withColumn("__facet", (F.dense_rank().over(w) - 1).cast("int")).withColumn("__feat", (F.row_number().over(own) - 1).cast("int"))
    return ranked.withColumn("facet_ord", F.col("__facet")).withColumn("feat_ord", F.col("__feat")).select(FEATURE_COLUMNS)


def coalesce_marks(features: DataFrame, is_block: Column | None = None) -> DataFrame:
    """Merge a facet with the one before it in canonical order where it starts at that one's end, has the same features
    and is no block (by default: no ``parents`` key)."""
    block = F.get_json_object("data", "$.parents").isNotNull() if is_block is None else is_block
    grouped = group_ranges(features)
    facets = grouped.groupBy("doc_id", "facet_ord", "byte_start", "byte_end").agg(
        F.array_sort(F.collect_list(F.struct("feat_ord", "type_id", "name", "data"))).alias("fs"), F.bool_or(block).alias("block")
    )
    w = Window.partitionBy("doc_id").orderBy("facet_ord")
    joins = (F.lag("byte_end").over(w) == F.col("byte_start")) & (F.lag("fs").over(w) == F.col("fs")) & ~F.col("block") & ~F.lag("block").over(w)
    island = F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = facets.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.any_value("fs").alias("fs"))
    rows = merged.select("doc_id", (F.col("island") - 1).cast("int").alias("facet_ord"), "byte_start", "byte_end", F.explode("fs").alias("f"))
    return rows.select("doc_id", "facet_ord", F.col("f.feat_ord").alias("feat_ord"), "byte_start", "byte_end", F.col("f.type_id").alias("type_id"), F.col("f.name").alias("name"), F.col("f.data").alias("data"))


def normalize(features: DataFrame) -> DataFrame:
    return coalesce_marks(features)


def validate(docs: DataFrame, features: DataFrame) -> DataFrame:
    """(doc_id, facet_ord, problem). Overlaps of blocks are found with a running maximum, not pairwise."""
    joined = features.join(docs.select("doc_id", "text"), "doc_id")
    n = F.octet_length("text")
    block = F.get_json_object("data", "$.parents").isNotNull()
    marker = F.octet_length(F.decode(F.substring(F.encode("text", "UTF-8"), F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start")), "UTF-8"))
    simple = (
        F.when(F.col("byte_start") > F.col("byte_end"), "inverted_range")
        .when((F.col("byte_start") < 0) | (F.col("byte_end") > n), "out_of_bounds")
        .when(~on_boundary(F.col("text"), F.col("byte_start")) | ~on_boundary(F.col("text"), F.col("byte_end")), "not_on_boundary")
        .when(block & ~F.coalesce(marker, F.lit(0)).isin(1, 3), "marker_width")
    )
    one = joined.select("doc_id", "facet_ord", simple.alias("problem")).where("problem is not null").distinct()
    blocks = features.where(block).select("doc_id", "facet_ord", "byte_start", "byte_end").distinct()
    before = F.max("byte_end").over(Window.partitionBy("doc_id").orderBy("byte_start", "byte_end", "facet_ord").rowsBetween(Window.unboundedPreceding, -1))
    overlaps = blocks.withColumn("m", before).where("m > byte_start").select("doc_id", "facet_ord", F.lit("overlapping_blocks").alias("problem"))
    return one.unionByName(overlaps)


def filter_namespace(features: DataFrame, namespace: str) -> DataFrame:
    """Features whose type starts with a namespace."""
    return features.where(F.startswith("type_id", F.lit(namespace)))


def has_mark(features: DataFrame, type_id: str, name: str | None = None) -> Column:
    """Predicate on a features row; ``type#name`` is split, and a type that itself holds # is found as well."""
    whole = F.col("type_id") == type_id
    if name is not None:
        return whole & F.coalesce(F.col("name") == name, F.lit(False))
    if "#" in type_id:
        kind, _, named = type_id.rpartition("#")
        return whole | ((F.col("type_id") == kind) & F.coalesce(F.col("name") == named, F.lit(False)))
    return whole
