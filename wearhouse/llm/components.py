"""Connected components by alternating large-star and small-star rounds.

Every round is joins and aggregates over the edge table, written to the shared
checkpoint folder; no edge or label reaches the driver and no node's
neighbours are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearhouse.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); a component is named
    by its smallest node.  No edges: no rows.  Self-loops and repeats are ignored."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    while True:
        # done when every edge points from a node straight to a root
        inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        twice = edges.groupBy("a").count().where(F.col("count") > 1).limit(1).count() if not inner else 1
        up = edges.where("a < b").limit(1).count() if not twice else 1
        if not (inner or twice or up):
            break
        edges = materialize(_small_star(_large_star(edges)))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
