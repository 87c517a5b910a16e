"""Connected components of an edge table, wholly on Spark: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars already: each a has one b, and no b is an a. Then b is the least of its component."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    per_node = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node's larger neighbours, linked to the least of that node and its neighbours; edges have a > b.

    A node without smaller neighbours is its own least, so its edges stay as they are. The leasts are written: a join
    of two plain tables is one that Spark can split where a node has very many neighbours.
    """
    least = scratch.put(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m"), "least")
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node's smaller neighbours and the node, linked to the least of those neighbours."""
    least = scratch.put(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): root is the smallest id that id reaches; ids that are their own root are left out.

    edges has integer columns a and b; loops, repeats and either direction are fine, nulls are ignored, and no
    edges give no rows. Each round is written to the shared folder, so no lineage builds up; the number of rounds
    is logarithmic in the longest chain.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        after = scratch.put(_small(_large(now, scratch), scratch), "edges")
        scratch.drop(now)
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
