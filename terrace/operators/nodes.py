"""Nested values as node rows in preorder, and the questions a preorder answers by range."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "owner string, n long, parent long, role string, ord long, node string, value string, last long, depth long"


def walk(owner: str, value: object) -> list[list]:
    """Node rows of one JSON value. A list item repeats its list's role; iterative, so depth is unbounded."""
    rows: list[list] = []
    stack: list[tuple] = [(value, None, None, None, 0)]
    while stack:
        item = stack.pop()
        if item[0] is _close:
            rows[item[1]][7] = len(rows) - 1
            continue
        v, parent, role, ord_, depth = item
        n = len(rows)
        kind = "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "null" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
        text = None if kind in ("object", "list", "null") else str(int(v)) if kind == "bool" else v if kind == "string" else json.dumps(v)
        rows.append([owner, n, parent, role, ord_, kind, text, n, depth])
        children = [(x, n, k, None, depth + 1) for k, x in v.items()] if kind == "object" else [(x, n, role, i, depth + 1) for i, x in enumerate(v)] if kind == "list" else []
        if children:
            stack.append((_close, n))
            stack.extend(reversed(children))
    return rows


_close = object()


def rebuild(rows: list[list]) -> object:
    """The value that walk() numbered."""
    made: dict[int, object] = {}
    for _, n, parent, role, ord_, kind, text, _, _ in rows:
        v = {} if kind == "object" else [] if kind == "list" else None if kind == "null" else text == "1" if kind == "bool" else text if kind == "string" else json.loads(text)
        made[n] = v
        if parent is not None:
            up = made[parent]
            if isinstance(up, list):
                up.append(v)
            else:
                up[role] = v
    return made[0]


def flatten(df: DataFrame, owner: str, column: str) -> DataFrame:
    """Node rows of a JSON text column; a null cell gives no rows, broken JSON one string node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[list] = []
            for o, text in zip(pdf["owner"], pdf["cell"], strict=True):
                if text is None:
                    continue
                try:
                    value = json.loads(text)
                except ValueError:
                    value = text
                rows += walk(o, value)
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
            for c in ("parent", "ord"):
                out[c] = out[c].astype("Int64")
            yield out

    return df.select(F.col(owner).cast("string").alias("owner"), F.col(column).cast("string").alias("cell")).mapInPandas(run, SCHEMA)


def number(paths: DataFrame, order: list[str]) -> DataFrame:
    """Preorder numbers for rows (owner, sort keys, depth, ...) given in an order where a parent's keys are a prefix.

    Adds n, and last from the next row at the same or a smaller depth.
    """
    w = Window.partitionBy("owner").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return paths.withColumn("n", F.row_number().over(w) - 1)


def _start(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """Rows joined with the start row of their owner: s_n, s_last, s_depth, s_parent."""
    s = nodes.join(at, ["owner", "n"]).select("owner", F.col("n").alias("s_n"), F.col("last").alias("s_last"), F.col("depth").alias("s_depth"), F.col("parent").alias("s_parent"))
    return nodes.join(s, "owner")


def subtree(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return _start(nodes, at).filter("n BETWEEN s_n AND s_last").select(nodes.columns)


def ancestors(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return _start(nodes, at).filter("n <= s_n AND last >= s_n").select(nodes.columns)


def children(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return _start(nodes, at).filter("n BETWEEN s_n + 1 AND s_last AND parent = s_n").select(nodes.columns)


def siblings(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return _start(nodes, at).filter("parent = s_parent").select(nodes.columns)


def leaves(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return _start(nodes, at).filter("n BETWEEN s_n AND s_last AND last = n").select(nodes.columns)


def depth_range(nodes: DataFrame, at: DataFrame, a: int, b: int) -> DataFrame:
    return _start(nodes, at).filter(f"n BETWEEN s_n AND s_last AND depth BETWEEN s_depth + {a} AND s_depth + {b}").select(nodes.columns)


def of_kind(nodes: DataFrame, at: DataFrame, kind: str) -> DataFrame:
    """Nodes strictly below the start whose kind member has the value."""
    marks = _start(nodes, at).filter((F.col("role").isin("k", "kind")) & (F.col("value") == kind) & F.expr("n BETWEEN s_n + 1 AND s_last AND parent > s_n"))
    owners = marks.select("owner", F.col("parent").alias("n")).distinct()
    return nodes.join(owners, ["owner", "n"]).select(nodes.columns)


def path_to(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """owner, path: the accessor text from node f down to node t of each owner (columns owner, f, t)."""
    on = nodes.join(ends, "owner").filter("n > f AND n <= t AND last >= t")
    step = F.when(F.col("ord").isNotNull(), F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]"))).otherwise(F.col("role"))
    steps = on.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("n", step.alias("s")))).alias("p"))  # at most one row a level
    return steps.select("owner", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["s"]), "."), r"\.\[", "[").alias("path"))


def lca(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The deepest node over both a and b of each owner (columns owner, a, b)."""
    over = nodes.join(pairs, "owner").filter("n <= least(a, b) AND last >= greatest(a, b)")
    top = over.groupBy("owner").agg(F.max("n").alias("n"))
    return nodes.join(top, ["owner", "n"]).select(nodes.columns)


def nth_child(nodes: DataFrame, at: DataFrame, i: int) -> DataFrame:
    below = children(nodes, at)
    w = Window.partitionBy("owner", "parent").orderBy(F.asc("n") if i >= 0 else F.desc("n"))
    return below.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == (i + 1 if i >= 0 else -i)).select(nodes.columns)


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, lo: str, hi: str, name: str) -> DataFrame:
    """Each point with the name of the shortest span of its key that holds it, ties by name."""
    joined = points.join(spans, key).filter((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi)))
    best = F.min(F.struct((F.unix_micros(hi) - F.unix_micros(lo)).alias("w"), F.col(name).alias("s")))
    return joined.groupBy(*points.columns).agg(best.alias("_b")).select(*points.columns, F.col("_b.s").alias("innermost"))
