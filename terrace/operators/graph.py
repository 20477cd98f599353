"""Reachability over edge tables (src, dst): closures, hops, cycles, roots, paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.session import cut


#: Rounds whose rows are kept as parts of their own before they are written as one.
PARTS = 8


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Semi-naive iteration: rows of step(new rows) whose keys are unseen, until none are left.

    Each round writes its new rows only, to the shared checkpoint folder; what was seen is the
    union of the rounds, written as one now and then so that its plan stays short.
    """
    delta = cut(seed.dropDuplicates(keys))
    parts = [delta]
    while not delta.isEmpty():
        seen = reduce(DataFrame.unionByName, parts)
        delta = cut(step(delta).dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti"))
        parts.append(delta)
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) with a path of one edge or more."""
    edges = cut(edges.select("src", "dst").distinct())
    step = lambda new: new.select("src", F.col("dst").alias("_m")).join(edges.withColumnRenamed("src", "_m"), "_m").select("src", "dst")
    return fixpoint(edges, step, ["src", "dst"])


def hops(edges: DataFrame, start: DataFrame, k: int, direction: str = "out") -> DataFrame:
    """node, dist: nodes within k hops of the start nodes (dist 0), by out, in or both directions."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    way = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    seen = front = start.select("node").distinct().withColumn("dist", F.lit(0).cast("long"))
    for d in range(1, k + 1):
        front = front.join(way, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(d).cast("long"))
        front = cut(front)
        seen = seen.unionByName(front)
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each strongly connected component of two nodes or more.

    Forward-backward colouring. Nodes without an edge in or out are trimmed first. Then every node takes
    the least node that reaches it as its colour, and those of a colour that reach that node are its component.
    No pairs of nodes are made: state is one colour per node and the edges still open.
    """
    open_ = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    found = None
    while True:
        while True:  # trim
            kept = cut(open_.join(open_.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(open_.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if kept.count() == open_.count():
                break
            open_ = kept
        if open_.isEmpty():
            break
        colour = cut(open_.select(F.col("src").alias("node"), F.col("src").alias("c")).distinct())
        while True:
            offered = open_.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("_o"))
            nxt = cut(colour.join(offered, "node", "left").select("node", F.least("c", "_o").alias("c"), (F.col("_o") < F.col("c")).alias("_moved")))
            moved = not nxt.filter("_moved").isEmpty()
            colour = nxt.select("node", "c")
            if not moved:
                break
        inside = cut(
            open_.join(colour.select(F.col("node").alias("src"), F.col("c").alias("_a")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("c").alias("_b")), "dst").filter("_a = _b").select("src", "dst")
        )
        back = lambda new: new.join(inside, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "component")
        settled = fixpoint(colour.filter("node = c").select("node", F.col("c").alias("component")), back, ["node"])
        found = settled if found is None else cut(found.unionByName(settled))
        gone = settled.select("node")
        open_ = cut(open_.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("node", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """node, component: nodes on a cycle and the smallest node of their strongly connected component; an edge to itself is a cycle."""
    large = strong_components(edges)
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().join(large, "node", "left_anti")
    return large.unionByName(loops.select("node", F.col("node").alias("component")))


def reach_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth: every node a root reaches and its least depth (the root itself at 0)."""
    out = edges.select("src", "dst").distinct()
    seed = roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth"))
    step = lambda new: new.join(out, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(seed, step, ["root", "node"])


def simple_paths(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """node, hops: every cycle-free path of at most so many nodes (any number without a bound) from a start, as its list of nodes.

    Each round adds one edge, so no path beyond the bound is ever made.
    """
    front = cut(starts.select("node", F.array("node").alias("hops")))
    every, nodes = front, 1
    while (most is None or nodes < most) and not front.isEmpty():
        nodes += 1
        front = cut(front.join(edges, F.col("node") == F.col("src")).filter(~F.array_contains("hops", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("hops", F.array("dst")).alias("hops")))
        every = every.unionByName(front)
    return every


def unreached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """dst, sources: who points at each node, sorted."""
    return edges.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("sources"))


def weighted(rows: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """src, dst and one count per kind."""
    return rows.groupBy("src", "dst").agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds))


def rollup(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Edges between groups (group: node, folder) with their weight; edges inside a group are left out."""
    a = group.select(F.col("node").alias("src"), F.col("folder").alias("from_folder"))
    b = group.select(F.col("node").alias("dst"), F.col("folder").alias("to_folder"))
    return edges.join(a, "src").join(b, "dst").filter("from_folder <> to_folder").groupBy("from_folder", "to_folder").agg(F.count(F.lit(1)).alias("weight"))


def dirty(targets: DataFrame, deps: DataFrame) -> DataFrame:
    """All targets that depend, directly or not, on the given ones (deps: src depends on dst)."""
    back = deps.select(F.col("dst").alias("_on"), F.col("src").alias("target"))
    step = lambda new: new.select(F.col("target").alias("_on")).join(back, "_on").select("target")
    return fixpoint(targets.select("target"), step, ["target"])
