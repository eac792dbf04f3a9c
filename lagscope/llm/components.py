"""Connected components over links between values, without a driver copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagscope.llm.common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link, root being the smallest
    node reachable; links to itself are ignored.

    Alternates two steps until the links stop changing: every node's larger
    neighbours move to its smallest neighbour, then its smaller ones do. Both
    steps take a minimum per node (summed before the shuffle) and one
    equi-join, so a node with many neighbours is no single group, and the
    number of links never grows. Each round is written to the shared
    checkpoint folder."""
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.join(least, both["u"] == least["k"]).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (large.join(least, large["u"] == least["k"])
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        edges = settle(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v"), F.col("v")).distinct())
        before = state
