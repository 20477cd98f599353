"""Statistics per group that need an order: exact medians without gathering a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upper_median(df: DataFrame, group: str, value: str, bins: int = 1024) -> DataFrame:
    """group, median: the element at half the count of each group's sorted non-null numbers, not an average.

    Values are counted in equal bins between the group's ends (partial before the shuffle); only the
    values of the one bin that the middle falls into are then counted one by one.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    ends = rows.groupBy(F.col("_g").alias("_k")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    same = F.col("_g").eqNullSafe(F.col("_k"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(ends, same).select("_g", "_v", "_n", at.alias("_b"))
    by_bin = binned.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    up = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most `bins` rows a group
    middle = F.floor(F.col("_n") / 2) + 1
    held = by_bin.withColumn("_to", F.sum("_c").over(up)).filter((F.col("_to") >= middle) & (F.col("_to") - F.col("_c") < middle))
    held = held.select(F.col("_g").alias("_k"), F.col("_b").alias("_kb"), (F.col("_to") - F.col("_c")).alias("_before"))
    values = binned.join(held, same & (F.col("_b") == F.col("_kb"))).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"), F.max("_before").alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    return values.withColumn("_to", upto).filter(F.col("_to") >= middle).groupBy(F.col("_g").alias(group)).agg(F.min("_v").alias("median"))


def stage_stats(df: DataFrame, stage: str, value: str) -> DataFrame:
    """stage, runs, median, max and total of a trace's values."""
    sums = df.groupBy(F.col(stage).alias("_s")).agg(F.count(F.lit(1)).alias("runs"), F.max(value).alias("max"), F.round(F.sum(value), 4).alias("total"))
    return sums.join(upper_median(df, stage, value), F.col("_s").eqNullSafe(F.col(stage)), "left").select(F.col("_s").alias(stage), "runs", "median", "max", "total")


def tally(df: DataFrame, by: str, value: str, *name: str) -> DataFrame:
    """by, n, total, most, slowest: counts and sums per group and the name of its largest row, the greater name on ties."""
    slowest = F.max(F.struct(F.col(value).alias("v"), F.concat_ws(":", *name).alias("name"))).getField("name")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"), F.max(value).alias("most"), slowest.alias("slowest"))
