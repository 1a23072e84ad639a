"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.scratch import discard, materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of the nodes in ``links`` (columns ``a``, ``b``): the smallest node reachable.

    A component's smallest node has no row of its own.

    Each round is two aggregations and two joins back on the node, both of which Spark can split for a
    node with very many links, and is written to the shared folder. The rounds are logarithmic in the
    longest path; no link is ever brought to the driver. It ends when the links are stars: every node has
    one link, and to a node that has none itself.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(edges, large)
        edges = new
        if _stars(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = edges.join(edges.select(F.col("u").alias("k")), F.col("v") == F.col("k"), "left_semi")
    return several.isEmpty() and chained.isEmpty()
