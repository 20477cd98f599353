"""Mixing sources to target weights by entropy balancing.

Each document gets the rate exp(lambda_s * size / mean), at most cap, where lambda_s solves
the convex dual of the source's token constraint. The dual's derivatives are sums over
(source, size) cells, so a Newton step is one distributed aggregation over the cells, not over
documents. Rates then become copies: cell by cell in falling size, the rounding error carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.session import cut


@dataclass(frozen=True)
class MixParams:
    """weights: repeat over the sources in code point order, null last. cap: copies of a
    document, and times of its own size that a source may give. cell_rows: larger cells are
    ranked in parts of about this many documents. steps: most Newton steps; a source not
    within tolerance by then keeps its bracketed best, which the rounding still corrects."""

    weights: tuple[int, ...] = (5, 2, 1)
    cap: int = 3
    cell_rows: int = 20_000
    steps: int = 40
    tolerance: float = 1e-6


def targets(cells: DataFrame, p: MixParams) -> DataFrame:
    """source, source_size, target: weights share all sizes, no target above cap * source_size.

    The resharing of what is cut off ends where target = min(cap * size, level * weight) with
    one level for all. Sources fill up in the order of cap * size / weight, so the level
    follows from running sums over the sources; documents are not touched.
    """
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(p.weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in p.weights)), turn.cast("int") + 1)
    s = sums.withColumn("_w", weight).withColumn("_full", F.col("source_size") * p.cap).withColumn("_at", F.col("_full") / F.col("_w"))
    by = Window.orderBy("_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_used": F.coalesce(F.sum("_full").over(before), F.lit(0)),
        "_rest": F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)),
    })
    # the level if exactly the sources before this one are full; the first that then stays below its cap decides
    s = s.withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_rest"))
    s = s.withColumn("_l", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(everything)["_level"])
    target = F.least(F.col("_full").cast("double"), F.coalesce(F.col("_l"), F.lit(0.0)) * F.col("_w"))
    return s.select("source", F.col("source_size").cast("long"), target.alias("target"))


def solve(cells: DataFrame, goal: DataFrame, p: MixParams) -> DataFrame:
    """source, lam, mean: the dual's solution per source, null lam where the target is the cap or zero.

    A step evaluates every source's dual derivatives in one aggregation over the cells;
    brackets guard the Newton step where the cap makes the dual's slope vanish.
    """
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(1))).alias("mean"))
    state = goal.join(mean, goal.source.eqNullSafe(mean.source)).select(goal.source, "source_size", "target", "mean").withColumns({
        "lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"),
        "done": (F.col("target") <= 0) | (F.col("target") >= p.cap * F.col("source_size") * (1 - 1e-12)),
    })
    state = cut(state)
    for _ in range(p.steps):
        now = state.filter(~F.col("done")).select(F.col("source").alias("_s"), "lam", "mean")
        x = F.col("size") / F.col("mean")
        r = F.exp(F.least(F.col("lam") * x, F.log(F.lit(float(p.cap)))))
        slope = F.when(F.col("lam") * x < F.log(F.lit(float(p.cap))), r * x * F.col("size") * F.col("n")).otherwise(0.0)
        sums = cells.join(now, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(r * F.col("size") * F.col("n")).alias("_f"), F.sum(slope).alias("_g"))
        gap = F.col("_f") - F.col("target")
        lo = F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.when(F.col("_g") > 0, gap / F.col("_g"))
        inside = step.isNotNull() & (F.col("_lo").isNull() | (step > F.col("_lo"))) & (F.col("_hi").isNull() | (step < F.col("_hi")))
        widen = F.when(F.col("_lo").isNull(), F.col("lam") - F.greatest(F.lit(1.0), 2 * F.abs("lam"))).when(F.col("_hi").isNull(), F.col("lam") + F.greatest(F.lit(1.0), 2 * F.abs("lam"))).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        met = F.abs(gap) <= p.tolerance * F.col("target")
        far = F.abs(step - F.col("lam")) > 4 * F.greatest(F.lit(1.0), F.abs("lam"))
        state = cut(
            state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumns({"_lo": lo, "_hi": hi})
            .select(
                "source", "source_size", "target", "mean",
                F.when(F.col("done") | F.col("_f").isNull() | met, F.col("lam")).otherwise(F.when(inside & ~far, step).otherwise(widen)).alias("lam"),
                F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("done") | F.col("_f").isNull() | met).alias("done"),
            )
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def plan(cells: DataFrame, solved: DataFrame, p: MixParams) -> DataFrame:
    """source, size, part, copies: whole copies for each part of a cell.

    Parts of a source are taken in falling size; each gets the whole number of copies
    that brings the running total of tokens nearest to the running target, so the error never
    exceeds half of the last size and ends at that of the smallest documents. A source's parts are
    its distinct sizes, more only where a size has over cell_rows documents.
    """
    cap = float(p.cap)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), cap).otherwise(
        F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(cap))))
    )
    parts = cells.withColumn("parts", F.ceil(F.col("n") / p.cell_rows)).join(
        solved.select(F.col("source").alias("_s"), "source_size", "target", "mean", "lam"), F.col("source").eqNullSafe(F.col("_s"))
    ).select("source", "size", "n", "parts", rate.alias("rate"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "part"], ascending=[False, True])
        due, out = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            if size == 0:
                out.append(0)
                continue
            due += n * rate * size
            c = min(max(int(due / size + 0.5), 0), p.cap * n)
            due -= c * size
            out.append(c)
        return pdf.assign(copies=pd.array(out, "int64"))[["source", "size", "part", "n", "copies"]]

    # Rows of a large cell are dealt to its parts by hash, so a part's count is known only after the dealing.
    return parts, carry


def mix(docs: DataFrame, *carry_columns: str, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, carried columns, size, source_size, target, taken, copies; a row per input row.

    size is the number of words, 0 for a null text; such documents get no copies. A null
    source is a source of its own, last in order. Repeated rows are documents of their own
    and are ranked by the hash of their id and size, ties in any order among equal rows, so that
    reruns agree. An empty table gives no rows.
    """
    p = params
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", *carry_columns, size.alias("size"), F.xxhash64("doc_id").alias("_h")))
    cells = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = solve(cells, targets(cells, p), p)
    rated, carry = plan(cells, solved, p)
    rated = cut(rated)
    # the sources' sums come from the cells: the second copy of the keys is what documents join
    keyed = rated.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "parts", "rate")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    dealt = sized.join(keyed, same).withColumn("part", F.pmod("_h", F.col("parts"))).drop("_s", "_z")
    counted = dealt.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"), F.first("rate").alias("rate"))
    copies = cut(counted.groupBy("source").applyInPandas(carry, "source string, size long, part long, n long, copies long"))
    within = Window.partitionBy("source", "size", "part").orderBy("_h", "doc_id")
    ranked = dealt.drop("parts", "rate").withColumn("_rank", F.row_number().over(within) - 1)
    given = copies.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("part").alias("_p"), "n", "copies")
    share = F.floor(F.col("copies") / F.col("n")) + (F.col("_rank") < F.col("copies") % F.col("n")).cast("long")
    out = ranked.join(given, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("part") == F.col("_p"))).withColumn("_copies", share.cast("long"))
    sums = solved.select(F.col("source").alias("_s2"), "source_size", "target")
    return out.join(sums, F.col("source").eqNullSafe(F.col("_s2"))).select(
        "doc_id", "source", *carry_columns, "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies")
    )
