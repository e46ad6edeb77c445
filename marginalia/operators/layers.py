"""Linguistic layers: annotations on spans, queries over them, edits, ontologies, alignments, and a concept index.

annotation_layers(doc_id, layer_ord, kind, subkind, ...); annotations(doc_id, layer_ord, uuid, byte_start, byte_end,
token_index, label, value, parent_id, confidence, ontology_type_ref, knowledge_refs, features)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.offsets import anchor, anchor_name, anchor_type
from .edit import clip


def query(annotations: DataFrame, layers: DataFrame, kind: str | None = None, subkind: str | None = None, label: str | None = None) -> DataFrame:
    """Equality filters; None or '' is no filter."""
    for column, value in (("kind", kind), ("subkind", subkind)):
        if value:
            layers = layers.where(F.col(column) == value)
    found = annotations.join(layers.select("doc_id", "layer_ord", "kind", "subkind"), ["doc_id", "layer_ord"])
    return found.where(F.col("label") == label) if label else found


def at(annotations: DataFrame, offset: Column | int) -> DataFrame:
    """Those whose span holds a position; annotations without a span never do."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return annotations.where((F.col("byte_start") <= offset) & (offset < F.col("byte_end")))


def in_range(annotations: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return annotations.where((F.col("byte_start") < end) & (start < F.col("byte_end")))


def by_labels(annotations: DataFrame, labels: list[str]) -> DataFrame:
    return annotations.where(F.col("label").isin(*labels)) if labels else annotations.limit(0)


def ranges(annotations: DataFrame, colors: dict[str, str], default: str = "#cccccc") -> DataFrame:
    """Spans with a colour by label, in drawing order (ord): start ascending, end descending."""
    palette = F.create_map(*[F.lit(x) for kv in colors.items() for x in kv]) if colors else F.create_map(F.lit(""), F.lit(default))
    w = Window.partitionBy("doc_id").orderBy("byte_start", F.col("byte_end").desc(), "layer_ord", "uuid")
    spanned = annotations.where("byte_start is not null and byte_end is not null")
    return spanned.select("doc_id", (F.row_number().over(w) - 1).alias("ord"), "byte_start", "byte_end", "label", F.coalesce(F.element_at(palette, F.col("label")), F.lit(default)).alias("color"), "layer_ord")


def insert_text(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, pos, n): spans at or after pos shift by n bytes, spans around it grow."""
    j = annotations.join(edits.select("doc_id", F.col("pos").alias("__p"), F.col("n").alias("__n")), "doc_id", "left")
    s, e, p, n = F.col("byte_start"), F.col("byte_end"), F.col("__p"), F.coalesce("__n", F.lit(0))
    new_s, new_e = F.when(s >= p, s + n).otherwise(s), F.when(e > p, e + n).when(s >= p, e + n).otherwise(e)
    return j.withColumn("__s", new_s).withColumn("byte_end", new_e).withColumn("byte_start", F.col("__s")).drop("__s", "__p", "__n")


def delete_text(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, lo, hi): spans within collapse to zero width at lo and stay."""
    j = annotations.join(edits.select("doc_id", F.col("lo").alias("__lo"), F.col("hi").alias("__hi")), "doc_id", "left")
    s, e = clip(F.col("byte_start"), F.col("byte_end"), F.col("__lo"), F.col("__hi"))
    on = F.col("__lo").isNotNull() & (F.col("__lo") < F.col("__hi"))
    return j.withColumn("__s", F.when(on, s).otherwise(F.col("byte_start"))).withColumn("byte_end", F.when(on, e).otherwise(F.col("byte_end"))).withColumn("byte_start", F.col("__s")).drop("__s", "__lo", "__hi")


def to_layers(features: DataFrame, kind: str = "span") -> tuple[DataFrame, DataFrame]:
    """Features as annotations labelled type#name, and the complement that labels lose: expansion flags and facet groups."""
    rows = features.select("doc_id", F.lit(0).alias("layer_ord"), F.lit(kind).alias("kind"), F.concat_ws(":", "facet_ord", "feat_ord").alias("uuid"), "byte_start", "byte_end", anchor(F.col("type_id"), F.col("name")).alias("label"), F.col("data").alias("value"), "facet_ord", "feat_ord")
    complement = rows.select("doc_id", "byte_start", "byte_end", "label", "facet_ord", "feat_ord", F.get_json_object("value", "$.expandStart").cast("boolean").alias("expand_start"), F.get_json_object("value", "$.expandEnd").cast("boolean").alias("expand_end"))
    return rows.drop("facet_ord", "feat_ord"), complement


def from_layers(annotations: DataFrame, complement: DataFrame | None = None) -> DataFrame:
    """Back to features: equal ranges are one facet, in canonical order."""
    key = ["doc_id", "byte_start", "byte_end", "label"]
    spanned = annotations.where("byte_start is not null")
    if complement is not None:
        spanned = spanned.join(complement.select(*key, F.col("feat_ord").alias("__feat")).groupBy(*key).agg(F.min("__feat").alias("__feat")), key, "left")
    else:
        spanned = spanned.withColumn("__feat", F.lit(0))
    facet = Window.partitionBy("doc_id").orderBy("byte_start", F.col("byte_end").desc())
    feat = Window.partitionBy("doc_id", "byte_start", "byte_end").orderBy("__feat", "uuid")
    return spanned.select("doc_id", (F.dense_rank().over(facet) - 1).cast("int").alias("facet_ord"), (F.row_number().over(feat) - 1).cast("int").alias("feat_ord"), "byte_start", "byte_end", anchor_type(F.col("label")).alias("type_id"), anchor_name(F.col("label")).alias("name"), F.col("value").alias("data"))


def concept_index(annotations: DataFrame) -> DataFrame:
    """A row a reference: key ``source:identifier``. Kept flat, so that a concept in very many documents is no one row."""
    refs = annotations.select("doc_id", "layer_ord", "uuid", "label", "byte_start", "byte_end", F.explode("knowledge_refs").alias("k"))
    return refs.select(F.concat_ws(":", F.col("k.source"), F.col("k.identifier")).alias("key"), "doc_id", "layer_ord", "uuid", "label", "byte_start", "byte_end")


def concept_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("doc_id").alias("n_docs"))


def find_by_entity(index: DataFrame, source: str, identifier: str) -> DataFrame:
    return index.where(F.col("key") == f"{source}:{identifier}")


def remove_document(index: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return index.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def shared_concepts(index: DataFrame, a: int, b: int) -> DataFrame:
    """All references, in any document, of concepts that two documents share."""
    keys = lambda d: index.where(F.col("doc_id") == d).select("key").distinct()
    return index.join(keys(a), "key", "left_semi").join(keys(b), "key", "left_semi")


def resolve(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """refs(source, identifier, ...) with an entity table(source, identifier, ...); unresolved ones are left out."""
    return refs.join(entities, ["source", "identifier"])


def ontology_graph(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """types(uuid, name, parent_ref, description, roles array<struct<role_name, filler_type>>) -> vertices and edges. A
    type with a description and roles is a situation type, any other an entity type."""
    situation = F.col("description").isNotNull() & (F.coalesce(F.size("roles"), F.lit(0)) > 0)
    own = types.select(F.col("uuid").alias("vertex"), F.when(situation, "situation-type").otherwise("entity-type").alias("kind"), "name")
    roles = types.select("uuid", F.explode("roles").alias("r"))
    slots = roles.select(F.concat_ws(":", "uuid", F.col("r.role_name")).alias("vertex"), F.lit("role-slot").alias("kind"), F.col("r.role_name").alias("name"))
    edges = roles.select(F.col("uuid").alias("source"), F.concat_ws(":", "uuid", F.col("r.role_name")).alias("target"), F.lit("role").alias("kind"))
    extends = types.where("parent_ref is not null").select(F.col("uuid").alias("source"), F.col("parent_ref").alias("target"), F.lit("extends").alias("kind"))
    return own.unionByName(slots), edges.unionByName(extends)


def migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_ref, new_ref) of types with equal names, case aside."""
    a, b = (t.groupBy(F.lower("name").alias("n")).agg(F.min("uuid").alias(c)) for t, c in ((old, "old_ref"), (new, "new_ref")))
    return a.join(b, "n").select("old_ref", "new_ref")


def migrate(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Type references moved to the new ontology; those without a counterpart stay, marked unmapped."""
    m = mapping.select(F.col("old_ref").alias("ontology_type_ref"), "new_ref")
    j = annotations.join(m, "ontology_type_ref", "left")
    return j.withColumn("unmapped", F.col("ontology_type_ref").isNotNull() & F.col("new_ref").isNull()).withColumn("ontology_type_ref", F.coalesce("new_ref", "ontology_type_ref")).drop("new_ref")


def aligned_tokens(links: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """links(doc_id, link_id, source_indices, target_indices, ...) with tokens(doc_id, token_index, text) of both sides, pair by
    pair within a document."""
    pairs = links.select("doc_id", "link_id", F.explode("source_indices").alias("s"), "target_indices").select("doc_id", "link_id", "s", F.explode("target_indices").alias("t"))
    a = source.select("doc_id", F.col("token_index").alias("s"), F.col("text").alias("source_text"))
    b = target.select("doc_id", F.col("token_index").alias("t"), F.col("text").alias("target_text"))
    return pairs.join(a, ["doc_id", "s"]).join(b, ["doc_id", "t"]).select("doc_id", "link_id", F.col("s").alias("source_index"), F.col("t").alias("target_index"), "source_text", "target_text")


def cross_convert(records: DataFrame, fields: dict[str, str], renames: dict[str, str] | None = None) -> DataFrame:
    """Records of one schema as another's: fields of one name (or renamed) are cast, others are null."""
    renames = {v: k for k, v in (renames or {}).items()}
    return records.select(*[(F.col(renames.get(c, c)) if renames.get(c, c) in records.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
