"""Refreshing a stored map: whole halves, the invariant of its hashes with one retry, and whether it is stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_half(stored: DataFrame, fresh: DataFrame, half: str) -> DataFrame:
    """Stored rows but those stamped with the half, and the fresh rows under that stamp; unstamped rows stay."""
    kept = stored.filter(~F.col("half").eqNullSafe(F.lit(half)))
    return kept.unionByName(fresh.withColumn("half", F.lit(half)), allowMissingColumns=True)


def broken_files(stored: DataFrame, tree: DataFrame) -> DataFrame:
    """path, stored_hash, tree_hash of files (path, hash) whose stored hash is not the tree's; a file the tree lacks has a null there."""
    s = stored.select("path", F.col("hash").alias("stored_hash"))
    rows = s.join(tree.select("path", F.col("hash").alias("tree_hash")), "path", "left")
    return rows.filter(~F.col("stored_hash").eqNullSafe(F.col("tree_hash")))


def checked(read: Callable[[], DataFrame], tree: DataFrame, retries: int = 1) -> DataFrame:
    """What read gives, if its hashes are the tree's; read again up to so many times, then refused."""
    for _ in range(retries + 1):
        rows = read()
        if broken_files(rows, tree).isEmpty():
            return rows
    raise RuntimeError("stored hashes differ from the tree after reading again")


def set_hash(files: DataFrame) -> DataFrame:
    """key: an order-free digest of the set of paths, two sums of 60-bit hashes and the count."""
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(F.md5("path"), at, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string")
    return files.select("path").distinct().agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), part(1), part(16)).alias("key"))


def stale(recorded: DataFrame, files: DataFrame, tool: DataFrame) -> DataFrame:
    """map, reasons of each recorded map (map, built, file_set): why it is not current, '' where it is.

    files (map, path, mtime); tool (map, tool_mtime, baseline_mtime). Reasons, in this order: a source is
    newer than the map, the file set changed, the tool is newer, the baseline is newer.
    """
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(F.md5("path"), at, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string")
    now = files.groupBy("map").agg(F.max("mtime").alias("_m"), F.concat_ws("-", F.count(F.lit(1)).cast("string"), part(1), part(16)).alias("_k"))
    rows = recorded.join(now, "map", "left").join(tool, "map", "left")
    reasons = F.concat_ws(
        ",", F.when(F.col("_m") > F.col("built"), "source"), F.when(~F.col("_k").eqNullSafe(F.col("file_set")), "files"),
        F.when(F.col("tool_mtime") > F.col("built"), "tool"), F.when(F.col("baseline_mtime") > F.col("built"), "baseline"),
    )
    return rows.select("map", reasons.alias("reasons"))
