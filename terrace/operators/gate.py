"""Limits, a baseline that may only shrink, and what is closest to the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ceiling(limit: int) -> int:
    return -(-limit * 9 // 10)


def line_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_lines: lines that are not blank."""
    return df.select(F.col(key).alias("item"), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"))


def over_ceiling(counts: DataFrame, limit: int) -> DataFrame:
    verdict = F.when(F.col("n_lines") > limit, "over").otherwise("near")
    return counts.filter(F.col("n_lines") >= ceiling(limit)).select("item", "n_lines", verdict.alias("verdict"))


def ratchet(counts: DataFrame, baseline: DataFrame, limit: int) -> DataFrame:
    """item, now, was, verdict: NEW, GREW, REMOVE or NEAR; entries in order are left out.

    counts and baseline are (item, n). An item missing from the counts counts as 0.
    """
    low = ceiling(limit)
    both = counts.select("item", F.col("n").alias("now")).join(baseline.select("item", F.col("n").alias("was")), "item", "full")
    both = both.withColumn("now", F.coalesce("now", F.lit(0).cast("long")))
    listed = F.col("was").isNotNull()
    verdict = (
        F.when(~listed & (F.col("now") > limit), "NEW").when(listed & (F.col("now") < low), "REMOVE")
        .when(listed & (F.col("now") > F.col("was")), "GREW").when(~listed & (F.col("now") >= low), "NEAR")
    )
    return both.select("item", "now", "was", verdict.alias("verdict")).filter("verdict IS NOT NULL")


def rebased(counts: DataFrame, limit: int) -> DataFrame:
    """The new baseline: items at the ceiling or above, largest first."""
    return counts.filter(F.col("n") >= ceiling(limit)).orderBy(F.desc("n"), "item")


def worst(counts: DataFrame, limit: int, k: int = 15) -> DataFrame:
    """The k items closest to or furthest over the limit, ties by item."""
    ratio = F.round(F.col("n_lines") / limit, 4)
    return counts.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "item").limit(k)
