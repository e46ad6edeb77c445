"""Wiki references: <ref> elements become superscript numbers, numbered by first occurrence within a group; a named
reference used again keeps its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REF = r"(?s)<ref\b[^>/]*/>|<ref\b[^>/]*>.*?</ref>"


def _attribute(x: Column, name: str) -> Column:
    found = F.regexp_extract(x, name + r"\s*=\s*\"?([^\"/>\s]+)", 1)
    return F.when(found != "", found)


def references(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ord, group_name, name, number, content, url, title): a row a use; content comes from the use that has it."""
    from pyspark.sql import Window

    uses = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_REF), F.lit(0))).alias("ord", "raw"))
    head = F.regexp_extract("raw", r"^(<ref\b[^>]*>)", 1)
    content = F.regexp_extract("raw", r"(?s)^<ref\b[^>/]*>(.*)</ref>$", 1)
    rows = uses.select("doc_id", "ord", F.coalesce(_attribute(head, "group"), F.lit("")).alias("group_name"), _attribute(head, "name").alias("name"), F.when(content != "", content).alias("content"))
    key = F.coalesce(F.concat(F.lit("n:"), "name"), F.concat(F.lit("o:"), F.col("ord").cast("string")))
    same = Window.partitionBy("doc_id", "group_name", "key")
    rows = rows.withColumn("key", key).withColumn("first", F.min("ord").over(same)).withColumn("content", F.coalesce("content", F.first("content", ignorenulls=True).over(same)))
    number = F.dense_rank().over(Window.partitionBy("doc_id", "group_name").orderBy("first"))
    field = lambda n: (lambda v: F.when(v != "", v))(F.trim(F.regexp_extract("content", rf"\|\s*{n}\s*=\s*([^|}}]*)", 1)))
    bare = F.regexp_extract("content", r"(https?://[^\s|\]}]+)", 1)
    return rows.select("doc_id", "ord", "group_name", "name", number.alias("number"), "content", F.coalesce(field("url"), F.when(bare != "", bare)).alias("url"), field("title").alias("title"))


def expand(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the references of the text replaced by [n]; a group's name stands before the number."""
    from pyspark.sql import functions as fn

    numbered = references(docs, text).withColumn("label", F.concat(F.lit("["), F.when(F.col("group_name") != "", F.concat("group_name", F.lit(" "))).otherwise(""), F.col("number").cast("string"), F.lit("]")))
    labels = numbered.groupBy("doc_id").agg(fn.array_sort(fn.collect_list(fn.struct("ord", "label"))).alias("__labels"))
    gaps = F.split(F.col(text), _REF, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(F.col("__labels"), i + 1)["label"], F.lit("")))), "")
    return docs.join(labels, "doc_id", "left").withColumn(text, F.when(F.col("__labels").isNull(), F.col(text)).otherwise(joined)).drop("__labels")
