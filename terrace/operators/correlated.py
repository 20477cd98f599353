"""Correlated lookups and ordered cuts as joins, windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_child(nodes: DataFrame, role: str, name: str) -> DataFrame:
    """owner, n, name: for each node its first child's value of that role, null where it has none."""
    first = nodes.filter(F.col("role") == role).groupBy("owner", F.col("parent").alias("n")).agg(F.min_by("value", "n").alias(name))
    return nodes.select("owner", "n").join(first, ["owner", "n"], "left")


def few_joined(df: DataFrame, key: str, order: list[str], text: str, most: int, name: str) -> DataFrame:
    """key, name: the first texts in order, at most so many, joined by a comma and a blank.

    The rank cuts before anything is gathered, so a key's list never grows past the bound.
    """
    w = Window.partitionBy(key).orderBy(*order)
    few = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    row = F.sort_array(F.collect_list(F.struct("_r", F.col(text).cast("string").alias("v"))))
    return few.groupBy(key).agg(F.array_join(F.transform(row, lambda x: x["v"]), ", ").alias(name))


def limited(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows in order and, in column more, how many the limit leaves out; 0 keeps all."""
    if most == 0:
        return df.orderBy(*order).withColumn("more", F.lit(0).cast("long"))
    left_out = df.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).cast("long").alias("more"))
    return df.orderBy(*order).limit(most).crossJoin(F.broadcast(left_out))


def ordered(df: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """Rows by several columns, each (name, asc or desc); a range-partitioned sort."""
    return df.orderBy(*(F.desc(c) if way == "desc" else F.asc(c) for c, way in order))


def biggest_first(df: DataFrame, amount: str, name: str) -> DataFrame:
    return ordered(df, [(amount, "desc"), (name, "asc")])


def groups_order(df: DataFrame) -> DataFrame:
    """Copied groups (places, size, text): most places first, then the largest, then by text."""
    return ordered(df, [("places", "desc"), ("size", "desc"), ("text", "asc")])


def pairs_order(df: DataFrame) -> DataFrame:
    """Near copies (score, shared, size, at): best score first, then most shared, then largest, then by place."""
    return ordered(df, [("score", "desc"), ("shared", "desc"), ("size", "desc"), ("at", "asc")])


def heaviest(edges: DataFrame, weight: str, most: int, order: list[str]) -> DataFrame:
    """The heaviest edges, ties by the order columns, and these sorted by the order columns again."""
    return edges.orderBy(F.desc(weight), *order).limit(most).orderBy(*order)
