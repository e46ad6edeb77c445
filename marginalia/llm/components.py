"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a DataFrame job on links only; between steps the links are written to the shared folder, so lineage stays
short and lost executors are survived. A node's links meet in aggregations with partial sums (its smallest neighbour)
and in a join that adaptive execution can split; no neighbour list is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(u, v), u > v. Large: every larger neighbour of a node points to the node's smallest neighbour.
    Small: the node and its smaller neighbours do."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
    met = both.join(least, both["u"] == least["k"])
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """links(a, b) of longs, any order, repeats and loops allowed -> (node, root): root is the smallest node reachable.
    Nodes in no link between two nodes do not appear. Raises if ``max_rounds`` rounds do not suffice (each round at
    least halves the depth, so 40 is beyond any input)."""
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(now, "links"), None
    for _ in range(max_rounds):
        last, now = now, stored(_star(_star(now, True), False), "links")
        dropped(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").distinct().toDF("node", "root"))
        before = state
    raise RuntimeError("links did not settle")
