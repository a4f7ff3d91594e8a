"""Connected components of an edge table, by alternating large and small stars.

Each round points the neighbours of a node to the least node near it; a hub with very many neighbours is only ever aggregated
with partial sums and joined, and edges never grow in number beyond a constant. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from finality.llm.shared import stored


def _stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``: every component is a star around its least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    other = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)")
    return other.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (u, v: bigint); ``root`` is the least node of the component. No edges: no rows."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        # the least of each node and its neighbours
        least = now.select("u", F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("m"))).groupBy("u").agg(F.min("m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
        linked = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        smallest = linked.groupBy("u").agg(F.min("v").alias("m"))
        small = linked.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
