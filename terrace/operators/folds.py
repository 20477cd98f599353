"""Folds over sets: what holds always and what may hold, and restrictions of finite domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def always_maybe(ways: DataFrame, key: str, way: str, item: str) -> DataFrame:
    """key, always, maybe: items of all ways and of any way, from rows (key, way, item).

    Counting beats folding lists: an item is always there when it occurs in as many
    distinct ways as its key has.
    """
    per = ways.select(key, way, item).distinct()
    n = per.groupBy(key).agg(F.countDistinct(way).alias("n"))
    hits = per.groupBy(key, item).agg(F.count(F.lit(1)).alias("k")).join(n, key)
    both = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("k") == F.col("n"), F.col(item)))).alias("a"), F.sort_array(F.collect_list(item)).alias("m"))
    return both.select(key, F.array_join("a", ",").alias("always"), F.array_join("m", ",").alias("maybe"))


def collapse(restrictions: DataFrame, domain: list[str], key: str) -> DataFrame:
    """key, side, members from rows (key, op, members): ins intersect, not_ins subtract.

    unknown wins; nothing removed gives no row; the smaller side is reported, `in` on a tie.
    """
    d = F.array(*(F.lit(x) for x in sorted(domain)))
    rows = restrictions.groupBy(key).agg(
        F.max(F.col("op") == "unknown").alias("unknown"),
        F.collect_list(F.when(F.col("op") == "in", F.col("members"))).alias("ins"), F.collect_list(F.when(F.col("op") == "not_in", F.col("members"))).alias("outs"),
    )
    allowed = F.array_except(F.aggregate("ins", d, lambda acc, x: F.array_intersect(acc, x)), F.flatten("outs"))
    r = rows.withColumn("allowed", F.sort_array(allowed)).withColumn("excluded", F.sort_array(F.array_except(d, F.col("allowed"))))
    smaller = F.size("allowed") <= F.size("excluded")
    side = F.when(F.col("unknown"), "unknown").when(smaller, "in").otherwise("not_in")
    members = F.when(F.col("unknown"), F.lit("")).when(smaller, F.array_join("allowed", ",")).otherwise(F.array_join("excluded", ","))
    return r.filter(F.col("unknown") | (F.size("excluded") > 0)).select(key, side.alias("side"), members.alias("members"))


def either(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """key, members: what one of two sides (key, member) permits; a key that a side says nothing of is not restricted and has no row."""
    both = left.select(key).distinct().join(right.select(key).distinct(), key)
    rows = left.select(key, member).unionByName(right.select(key, member)).distinct().join(both, key, "left_semi")
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("members"))
