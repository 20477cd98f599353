"""Snapshots of keyed, hashed entries: diff, rename pairing, hash trees, pruning, incremental state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.session import cut


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, old_hash, new_hash of entries (path, kind, hash) that differ."""
    o = old.select("path", F.col("kind").alias("ok"), F.col("hash").alias("old_hash"))
    n = new.select("path", F.col("kind").alias("nk"), F.col("hash").alias("new_hash"))
    change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "deleted").when(F.col("ok") != F.col("nk"), "type-changed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return o.join(n, "path", "full").select("path", change.alias("change"), "old_hash", "new_hash").filter("change IS NOT NULL")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_path, new_path: added and deleted entries of one kind, hash and size, paired in path order, each once."""
    gone = old.join(new.select("path"), "path", "left_anti")
    came = new.join(old.select("path"), "path", "left_anti")
    w = Window.partitionBy("kind", "hash", "size").orderBy("path")
    rank = lambda df, name: df.select("kind", "hash", "size", F.col("path").alias(name), F.row_number().over(w).alias("r"))
    return rank(gone, "old_path").join(rank(came, "new_path"), ["kind", "hash", "size", "r"]).select("old_path", "new_path")


def changed_paths(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    return changes.select("path").union(pairs.select("old_path")).union(pairs.select("new_path")).distinct()


def rolled_hash(children: DataFrame, parent: str, name: str, digest: str) -> DataFrame:
    """parent, hash: the hash of `dir:` and its children's name and hash in name order."""
    row = F.struct(F.col(name).alias("n"), F.col(digest).alias("h"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.concat(x["n"], F.lit("="), x["h"])), ";")
    return children.groupBy(parent).agg(F.sha2(F.concat(F.lit("dir:"), text), 256).alias("hash"))


def keep_newest(df: DataFrame, root: str, order: list[str], keep: int) -> DataFrame:
    w = Window.partitionBy(root).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def state_diff(stored: DataFrame, now: DataFrame) -> DataFrame:
    """path, state: new, changed or gone against recorded hashes (path, hash)."""
    s = stored.select("path", F.col("hash").alias("a"))
    n = now.select("path", F.col("hash").alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return s.join(n, "path", "full").select("path", state.alias("state")).filter("state IS NOT NULL")


def delta(stored: DataFrame, emitted: DataFrame) -> DataFrame:
    """Multiset difference both ways: rows to delete and rows to insert."""
    gone = stored.exceptAll(emitted).withColumn("op", F.lit("delete"))
    return gone.unionByName(emitted.exceptAll(stored).withColumn("op", F.lit("insert")))


def replace_files(stored: DataFrame, fresh: DataFrame, moved: DataFrame, file: str = "path") -> DataFrame:
    """Stored rows without those of moved files, and the fresh rows of these."""
    return stored.join(moved.select(file), file, "left_anti").unionByName(fresh.join(moved.select(file), file, "left_semi"))


def pass_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, key: an order-free digest of the columns a pass reads: two sums of 60-bit hashes, so that no rows are collected."""
    cells = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(F.md5(cells), at, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", part(1), part(16)).alias("key"))


def reuse_hash(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """path, hash: the stored hash where size and mtime are equal and mtime is older than the snapshot; else null, to be computed."""
    s = stored.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("hash").alias("_h"), F.col("created").alias("_c"))
    keep = (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")) & (F.col("mtime") < F.col("_c"))
    return entries.join(s, "path", "left").select("path", F.when(keep, F.col("_h")).alias("hash"))


def merkle(files: DataFrame) -> DataFrame:
    """path, hash of every folder of a tree of files (path, hash), '' for the root: each from its children, deepest first.

    One aggregation per level of folders; only the depth of the tree reaches the driver.
    """
    rows = files.select("path", "hash", F.size(F.split("path", "/")).alias("_d"))
    deepest = rows.agg(F.max("_d")).first()[0] or 0
    parent, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.substring_index("path", "/", -1)
    folders: list[DataFrame] = []
    for depth in range(deepest, 0, -1):
        here = rows.filter(F.col("_d") == depth).select("path", "hash")
        here = here.unionByName(folders[-1]) if folders else here
        rolled = rolled_hash(here.select(parent.alias("up"), name.alias("name"), "hash"), "up", "name", "hash")
        folders.append(cut(rolled.select(F.col("up").alias("path"), "hash")))
    return reduce(DataFrame.unionByName, folders) if folders else rows.select("path", "hash").limit(0)


def to_reread(moved: DataFrame, deps: DataFrame) -> DataFrame:
    """node: the moved nodes and what depends on them directly (deps: src depends on dst)."""
    hit = deps.join(moved.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return hit.union(moved.select("node")).distinct()


def freshness(changes: DataFrame) -> DataFrame:
    """state, n, first: how many paths (path, state) are in each state and the first of them."""
    return changes.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
