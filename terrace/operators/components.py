"""Connected components by alternating large and small stars.

No neighbourhood is collected: each star is a minimum per node and a join back, so a node with
very many edges costs partial aggregates, not a large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.session import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    moved = both.filter("v > u").join(least, F.col("u") == F.col("c"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("c").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node that has an edge to another."""
    now = cut(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)))
        at = mark(now)
        if at == seen:
            break
        seen = at
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
