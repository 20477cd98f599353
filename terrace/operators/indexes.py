"""Further lenses and inverted views over fact rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.semantics import fragment
from terrace.operators.graph import fixpoint, strong_components
from terrace.operators.lenses import union_all
from terrace.session import cut


def magic_numbers(rows: DataFrame, value: str, use: str) -> DataFrame:
    """Number literals that are neither 0, 1, -1 or 2 nor declared, default or format uses: value, uses."""
    plain = ~F.col(value).isin(0, 1, -1, 2) & ~F.col(use).isin("declared", "default", "format")
    return rows.filter(plain).groupBy(F.col(value).alias("number")).agg(F.count(F.lit(1)).alias("uses"))


def readers(tables: list[tuple[str, DataFrame, str, str]], text: str) -> DataFrame:
    """table_name, row_key of rows whose list column holds an item with the fragment."""
    return union_all([df.filter(F.exists(items, lambda x: fragment(x, text))).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key")) for name, df, key, items in tables])


def key_sections(literals: DataFrame, text: str) -> DataFrame:
    """Three sections for a key: where it is spelled, names built from it, readers of these names.

    literals (place, name, value, reads): value spells a literal, name is what it is assigned to,
    reads the name that the place reads.
    """
    spelled = literals.filter(F.col("value") == text).select(F.lit("spelled").alias("section"), "place", "name")
    built = literals.filter(F.col("value").startswith(text + ".")).select(F.lit("built").alias("section"), "place", "name")
    names = spelled.union(built).select(F.col("name").alias("reads")).filter("reads IS NOT NULL").distinct()
    read = literals.filter("reads IS NOT NULL").join(names, "reads", "left_semi").select(F.lit("read").alias("section"), "place", F.col("reads").alias("name"))
    return spelled.unionByName(built).unionByName(read)


def inverted(rows: DataFrame, item: str, holder: str) -> DataFrame:
    """item, n, holders: who holds each item, sorted."""
    g = rows.select(item, holder).distinct().groupBy(item).agg(F.sort_array(F.collect_list(F.col(holder).cast("string"))).alias("h"))
    return g.select(item, F.size("h").cast("long").alias("n"), F.array_join("h", ",").alias("holders"))


def topological_level(edges: DataFrame) -> DataFrame:
    """node, level: longest chain of components below each node; nodes of one cycle share a level.

    The condensed graph is peeled: a round settles the components that point at nothing open any more,
    so the rounds are the levels and every edge is read until its lower end is settled.
    """
    edges = cut(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    comp = cut(nodes.join(strong_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("c")))
    of = lambda end, name: comp.select(F.col("node").alias(end), F.col("c").alias(name))
    between = cut(edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct())
    open_, levels, level = comp.select("c").distinct(), [], 0
    while True:
        low = cut(open_.join(between.select(F.col("a").alias("c")).distinct(), "c", "left_anti").withColumn("level", F.lit(level).cast("long")))
        if low.isEmpty():
            break
        levels.append(low)
        open_ = cut(open_.join(low.select("c"), "c", "left_anti"))
        between = cut(between.join(low.select(F.col("c").alias("b")), "b", "left_anti"))
        level += 1
    if not levels:
        return comp.select("node", F.lit(0).cast("long").alias("level"))
    return comp.join(reduce(DataFrame.unionByName, levels), "c").select("node", "level")


def atlas(rows: DataFrame, project: str, route: str, boundary: str) -> DataFrame:
    """One row per project: how many rows, distinct routes and boundaries it has."""
    return rows.groupBy(project).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(route).alias("routes"), F.countDistinct(boundary).alias("boundaries"))


def longest_sections(rows: DataFrame, doc: str, section: str, lines: str, k: int) -> DataFrame:
    """The k longest sections of each document, ties by name."""
    w = Window.partitionBy(doc).orderBy(F.desc(lines), section)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(doc, section, lines, "rank")


def spread(base: DataFrame, extends: DataFrame) -> DataFrame:
    """node, property: own properties and those of every ancestor (extends: src extends dst), handed down level by level."""
    down = extends.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    step = lambda new: new.join(down, F.col("node") == F.col("_d")).select(F.col("_s").alias("node"), "property")
    return fixpoint(base.select("node", "property"), step, ["node", "property"])
