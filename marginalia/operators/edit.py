"""Text edits that keep ranges: arithmetic on columns. Positions are bytes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.offsets import on_boundary
from ..sources.document import FEATURE_COLUMNS
from .normalize import normalize

#: Marks that grow with text typed at their ends.
EXPAND_BOTH = ("bold", "italic", "strikethrough", "underline")


def expands(which: str, lexicon: DataFrame | None = None) -> Column:
    """The wire flag of a feature, else the registry's (a column expand_start / expand_end), else false. Blocks never."""
    flag = F.get_json_object("data", "$.expandStart" if which == "start" else "$.expandEnd").cast("boolean")
    known = [F.col(f"expand_{which}")] if lexicon is not None else []
    return F.coalesce(flag, *known, F.lit(False)) & F.get_json_object("data", "$.parents").isNull()


def _facet_flags(features: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Any feature of a facet sets the flag for all of it."""
    if lexicon is not None:
        full = lexicon.select(F.col("key").alias("__full"), F.col("expand_start").alias("__s1"), F.col("expand_end").alias("__e1"))
        kind = lexicon.select(F.col("key").alias("__kind"), F.col("expand_start").alias("__s2"), F.col("expand_end").alias("__e2"))
        key = F.concat_ws("#", "type_id", "name")
        features = features.join(full, key == F.col("__full"), "left").join(kind, F.col("type_id") == F.col("__kind"), "left")
        features = features.withColumn("expand_start", F.coalesce("__s1", "__s2")).withColumn("expand_end", F.coalesce("__e1", "__e2"))
    whole = Window.partitionBy("doc_id", "facet_ord")
    return features.withColumn("__xs", F.bool_or(expands("start", lexicon)).over(whole)).withColumn("__xe", F.bool_or(expands("end", lexicon)).over(whole)).select(*FEATURE_COLUMNS, "__xs", "__xe")


def one_each(edits: DataFrame, columns: list[str]) -> DataFrame:
    """edits(doc_id, columns as __columns): raises for a document with two; streaming.edits.apply_mutations takes many."""
    many = F.raise_error(F.lit("two edits of one document"))
    own = edits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in columns])
    return own.select("doc_id", *[F.when(F.col("__n") > 1, many.cast(edits.schema[c].dataType)).otherwise(F.col(c)).alias(f"__{c}") for c in columns])


def insert_text(docs: DataFrame, features: DataFrame, edits: DataFrame, lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edits(doc_id, pos, ins): one insertion a document, two raise. Out of range or within a character raises; an empty one or a
    null position changes nothing. Text at a range's edge joins it only where the range expands there."""
    e = one_each(edits, ["pos", "ins"]).withColumn("__ins", F.coalesce("__ins", F.lit("")))
    d = docs.join(e, "doc_id", "left")
    raw = F.encode("text", "UTF-8")
    spliced = F.decode(F.concat(F.substring(raw, F.lit(1), F.col("__pos")), F.encode("__ins", "UTF-8"), F.substring(raw, F.col("__pos") + 1, F.octet_length("text"))), "UTF-8")
    text = F.when(F.col("__pos").isNull() | (F.col("__ins") == ""), F.col("text")).when(on_boundary(F.col("text"), F.col("__pos")), spliced).otherwise(F.raise_error(F.lit("insert position out of range or within a character")))
    f = _facet_flags(features, lexicon).join(e, "doc_id", "left")
    n, pos, s, end = F.octet_length("__ins"), F.col("__pos"), F.col("byte_start"), F.col("byte_end")
    live = pos.isNotNull() & (F.col("__ins") != "")
    shift = live & ((pos < s) | ((pos == s) & ~F.col("__xs")))
    grow = live & ~shift & ((pos < end) | ((pos == end) & F.col("__xe")))
    new = f.withColumn("__s", F.when(shift, s + n).otherwise(s)).withColumn("__e", F.when(shift | grow, end + n).otherwise(end))
    return d.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns]), new.select("doc_id", "facet_ord", "feat_ord", F.col("__s").alias("byte_start"), F.col("__e").alias("byte_end"), "type_id", "name", "data")


def clip(s: Column, e: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """A range after [lo, hi) is gone: what lies before stays, after shifts, overlaps shrink."""
    gone = hi - lo
    place = lambda x: F.when(x <= lo, x).when(x >= hi, x - gone).otherwise(lo)
    return place(s), place(e)


def delete_text(docs: DataFrame, features: DataFrame, edits: DataFrame, keep_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """edits(doc_id, lo, hi): one deletion a document, two raise; nothing unless 0 <= lo < hi <= bytes. Ranges that become empty go
    (or stay with zero width, as annotation spans do)."""
    e = one_each(edits, ["lo", "hi"])
    d = docs.join(e, "doc_id", "left")
    n = F.octet_length("text")
    live = F.coalesce((F.col("__lo") >= 0) & (F.col("__lo") < F.col("__hi")) & (F.col("__hi") <= n), F.lit(False))
    edges = on_boundary(F.col("text"), F.col("__lo")) & on_boundary(F.col("text"), F.col("__hi"))
    raw = F.encode("text", "UTF-8")
    cut = F.decode(F.concat(F.substring(raw, F.lit(1), F.col("__lo")), F.substring(raw, F.col("__hi") + 1, n)), "UTF-8")
    text = F.when(~live, F.col("text")).when(edges, cut).otherwise(F.raise_error(F.lit("delete range cuts a character")))
    f = features.join(d.select("doc_id", "__lo", "__hi", live.alias("__live")), "doc_id", "left")
    s, t = clip(F.col("byte_start"), F.col("byte_end"), F.col("__lo"), F.col("__hi"))
    on = F.coalesce("__live", F.lit(False))
    new = f.select("doc_id", "facet_ord", "feat_ord", F.when(on, s).otherwise(F.col("byte_start")).alias("byte_start"), F.when(on, t).otherwise(F.col("byte_end")).alias("byte_end"), "type_id", "name", "data", on.alias("__on"))
    if not keep_empty:
        new = new.where(~F.col("__on") | (F.col("byte_start") < F.col("byte_end")))
    return d.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns]), new.drop("__on")


def add_mark(features: DataFrame, marks: DataFrame) -> DataFrame:
    """marks(doc_id, byte_start, byte_end, type_id, name, data): appended, then normalized."""
    last = 1_000_000_000
    new = marks.select("doc_id", F.lit(last).alias("facet_ord"), F.lit(0).alias("feat_ord"), "byte_start", "byte_end", "type_id", "name", F.coalesce("data", F.to_json(F.struct("name"))).alias("data"))
    return normalize(features.unionByName(new))


def add_block(features: DataFrame, blocks: DataFrame) -> DataFrame:
    """As add_mark for block features; ``parents`` is written if absent."""
    data = F.when(F.get_json_object("data", "$.parents").isNull(), F.concat(F.lit('{"parents":[],"name":'), F.regexp_extract(F.to_json(F.struct(F.col("name").alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("}"))).otherwise(F.col("data"))
    return add_mark(features, blocks.withColumn("data", data))


def remove_mark(features: DataFrame, removals: DataFrame) -> DataFrame:
    """removals(doc_id, byte_start, byte_end, key): features of exactly that range and key, a type or type#name."""
    r = removals.select("doc_id", "byte_start", "byte_end", "key")
    keyed = features.withColumn("__keys", F.array(F.col("type_id"), F.concat_ws("#", "type_id", "name")))
    hit = (keyed["doc_id"] == r["doc_id"]) & (keyed["byte_start"] == r["byte_start"]) & (keyed["byte_end"] == r["byte_end"]) & F.array_contains(keyed["__keys"], r["key"])
    return keyed.join(r, hit, "left_anti").drop("__keys")


def mark_data(name: str, **fields: object) -> str:
    return json.dumps({"name": name, **fields})
