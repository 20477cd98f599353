"""Which sets of values overlap, how much of that is chance, and whether rows agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_sets(columns: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """set_name, value: the distinct values of each column as text."""
    each = [df.select(F.lit(name).alias("set_name"), F.col(c).cast("string").alias("value")).filter("value IS NOT NULL").distinct() for df, c, name in columns]
    return reduce(DataFrame.unionAll, each)


def overlaps(sets: DataFrame, least: int = 2, part: int = 5) -> DataFrame:
    """a, b, hits, size_a, size_b: set pairs sharing at least `least` values and 1/part of the smaller set.

    A value's sets are gathered into one bounded list (there are as many sets as
    columns), and pairs come from that list, so the values are shuffled once.
    """
    sizes = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("size"))
    held = sets.groupBy("value").agg(F.sort_array(F.collect_set("set_name")).alias("s")).filter(F.size("s") > 1)
    pairs = held.select(F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    hits = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("hits"))
    of = lambda s: sizes.select(F.col("set_name").alias(s), F.col("size").alias(f"size_{s}"))
    both = hits.join(of("a"), "a").join(of("b"), "b")
    return both.filter((F.col("hits") >= least) & (F.col("hits") * part >= F.least("size_a", "size_b"))).select("a", "b", "hits", "size_a", "size_b")


def chance(doc: DataFrame, doc_col: str, code: DataFrame, code_col: str, name: str) -> DataFrame:
    """How many hits integers spread evenly over the document's range would give: n(doc) * n(code in range) / width."""
    d = doc.select(F.col(doc_col).alias("v")).distinct().agg(F.count("v").alias("n_doc"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("j", F.lit(1))
    inside = code.select(F.col(code_col).alias("v")).distinct().withColumn("j", F.lit(1)).join(F.broadcast(d), "j").filter("v BETWEEN lo AND hi")  # one row
    n = inside.agg(F.count("v").alias("n_code")).withColumn("j", F.lit(1))
    rate = F.when(F.col("n_doc") == 0, 0.0).otherwise(F.round(F.col("n_doc") * F.col("n_code") / (F.col("hi") - F.col("lo") + 1), 4))
    return d.join(n, "j").select(F.lit(name).alias("pair"), "n_doc", "n_code", rate.alias("chance_hits"))


def agreement(doc: DataFrame, code: DataFrame, on: Column, cells: list[tuple[str, str]]) -> DataFrame:
    """doc_col, code_col, agree: rows joined on a key whose other cells are equal, per pair of columns."""
    joined = doc.join(code, on).agg(*(F.count_if(F.col(a).cast("string") == F.col(b).cast("string")).alias(f"{a}|{b}") for a, b in cells))
    pairs = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in cells)
    return joined.select(F.expr(f"stack({len(cells)}, {pairs}) AS (doc_col, code_col, agree)"))


def best_both_ways(scored: DataFrame) -> DataFrame:
    """Of rows (group_name, set_name, score): each group's best and each set's best, once, ties by name."""
    g = Window.partitionBy("group_name").orderBy(F.desc("score"), "set_name")
    s = Window.partitionBy("set_name").orderBy(F.desc("score"), "group_name")
    return scored.withColumn("_g", F.row_number().over(g)).withColumn("_s", F.row_number().over(s)).filter("_g = 1 OR _s = 1").drop("_g", "_s")
