"""Lenses: canned questions over any set of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.catalog import Catalog
from terrace.functions.semantics import filled, fragment, tokens


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def inventory(cat: Catalog, names: tuple[str, ...]) -> DataFrame:
    """Rows and columns of each table, and a TOTAL row."""
    each = union_all([cat[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.lit(len(cat[n].columns)).cast("long").alias("n_columns")) for n in names])
    total = each.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_columns").alias("n_columns")).select(F.lit("TOTAL").alias("table_name"), "n_rows", "n_columns")
    return each.unionByName(total)


def fill_profile(df: DataFrame, name: str) -> DataFrame:
    """Filled cells and their rate per column, in one pass over the table."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(filled(c)).alias(c) for c in df.columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = row.select("n_rows", F.expr(f"stack({len(df.columns)}, {pairs}) AS (column_name, filled)"))
    rate = F.when(F.col("n_rows") > 0, F.round(100.0 * F.col("filled") / F.col("n_rows"), 1))
    return long.select(F.lit(name).alias("table_name"), "column_name", "filled", "n_rows", rate.alias("rate"))


def search_cells(cat: Catalog, places: list[tuple[str, str, str]], text: str) -> DataFrame:
    """Cells that contain the fragment: table, column, key, cell; columns the table lacks are skipped."""
    hits = [
        cat[t].filter(fragment(c, text)).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(k).cast("string").alias("row_key"), F.col(c).alias("cell"))
        for t, k, c in places
        if cat.has(t, c)
    ]
    return union_all(hits)


def line_range(df: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """Lines first to last (from 1) of each text."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    return lines.filter((F.col("p") >= first - 1) & (F.col("p") <= last - 1)).select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def literal_stats(df: DataFrame, key: str, text: str, width: int, least: int) -> DataFrame:
    """Short single words: uses, rows that hold them and the first place as text."""
    words = df.select(key, F.posexplode(F.split(text, " ")).alias("p", "literal"))
    words = words.filter((F.char_length("literal") > 0) & (F.char_length("literal") <= width) & ~F.col("literal").rlike(r"[\n\t]"))
    return (
        words.groupBy("literal")
        .agg(F.count(F.lit(1)).alias("uses"), F.countDistinct(key).alias("places"), F.min(F.concat_ws(":", F.col(key).cast("string"), F.col("p").cast("string"))).alias("first_place"))
        .filter(F.col("uses") >= least)
    )


def separator_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of up to four other characters between two ASCII letters or digits."""
    seps = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9]([^A-Za-z0-9]{1,4})[A-Za-z0-9]"), F.lit(1))).alias("separator"))
    return seps.groupBy("separator").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct(key).alias("places"))


def repeat_flag(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the count of their key and whether it repeats."""
    return df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("repeated", F.col("n") > 1)


def findings(rules: dict[str, tuple[str, DataFrame]], levels: dict[str, str] | None = None) -> DataFrame:
    """Rows (rule, level, subject) of all rules; levels override and `off` leaves a rule out."""
    levels = levels or {}
    if unknown := set(levels) - set(rules):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    on = [(r, levels.get(r, level), df) for r, (level, df) in rules.items() if levels.get(r, level) != "off"]
    return union_all([df.select(F.lit(r).alias("rule_id"), F.lit(level).alias("level"), F.col(df.columns[0]).cast("string").alias("subject")) for r, level, df in on])


def best_match(df: DataFrame, path: str, wanted: str) -> DataFrame:
    """Exact, else tail at a folder, else unique substring; no rows where the best level is ambiguous."""
    p = F.col(path)
    level = F.when(p == wanted, 0).when(p.endswith("/" + wanted), 1).when(p.contains(wanted), 2)
    ranked = df.select(level.alias("_level"), F.struct(*df.columns).alias("_row")).filter("_level IS NOT NULL")
    levels = ranked.groupBy("_level").agg(F.count(F.lit(1)).alias("_n"), F.first("_row").alias("_row"))  # three rows at most
    return levels.orderBy("_level").limit(1).filter("_n = 1").select(*(F.col("_row")[c].alias(c) for c in df.columns))


def top_with_rest(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k largest by value (ties by key) and one row `rest` for all others.

    The k rows come from a distributed top-k; the rest is the difference of two sums, so
    no window runs over all rows.
    """
    top = df.orderBy(F.desc(value), F.asc(key)).limit(k).select(F.col(key).cast("string").alias("item"), F.col(value).cast("double").alias("amount"), F.lit(1).cast("long").alias("n"))
    all_ = df.agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c")).withColumn("j", F.lit(1))
    got = top.agg(F.sum("amount").alias("t"), F.count(F.lit(1)).alias("d")).withColumn("j", F.lit(1))
    rest = all_.join(got, "j").select(F.lit("rest").alias("item"), F.round(F.col("s") - F.coalesce("t", F.lit(0.0)), 2).alias("amount"), (F.col("c") - F.col("d")).alias("n"))
    return top.unionByName(rest)


def plugin_findings(plugins: dict[str, Callable[[Catalog], DataFrame]], cat: Catalog) -> DataFrame:
    """plugin, subject: what each plug-in finds, the first column of its rows; one that fails to plan is a finding itself."""
    frames = []
    for name, plugin in plugins.items():
        try:
            df = plugin(cat)
            frames.append(df.select(F.lit(name).alias("plugin"), F.col(df.columns[0]).cast("string").alias("subject")))
        except Exception as problem:  # noqa: BLE001 - any failure of a plug-in is its answer
            frames.append(cat.spark.range(1).select(F.lit(name).alias("plugin"), F.lit(f"failed: {type(problem).__name__}").alias("subject")))
    return union_all(frames)


def rows_per_file(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """file, tbl, n: how many rows each file has in each table (rows, file column)."""
    tagged = [df.select(F.col(file).cast("long").alias("file"), F.lit(name).alias("tbl")) for name, (df, file) in tables.items()]
    return union_all(tagged).groupBy("file", "tbl").agg(F.count(F.lit(1)).alias("n"))


def filled_cells(df: DataFrame, where: Column, columns: tuple[str, ...]) -> DataFrame:
    """column_name, cell of the rows that a test picks, one row per filled cell; only the named columns are read."""
    pairs = ", ".join(f"'{c}', string(`{c}`)" for c in columns)
    return df.filter(where).select(F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, cell)")).filter(filled("cell"))


def word_hits(cat: Catalog, places: list[tuple[str, str, str]], words: tuple[str, ...]) -> DataFrame:
    """table_name, row_key, hits: rows of the places (table, key, column) that hold one of the words, and how often; each text is cut into words once."""
    cells = union_all([cat[n].select(F.lit(n).alias("table_name"), F.col(k).alias("row_key"), F.explode(tokens(c)).alias("token")) for n, k, c in places])
    return cells.filter(F.col("token").isin(*words)).groupBy("table_name", "row_key").agg(F.count(F.lit(1)).alias("hits"))


def run_totals(files: DataFrame, mapped: Column, error: Column) -> DataFrame:
    """files, mapped, unmapped, exit_code of a run: the exit code is the largest error of any file, 0 without one."""
    worst = F.coalesce(F.max(F.coalesce(error, F.lit(0))), F.lit(0)).cast("long")
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"), worst.alias("exit_code"))
