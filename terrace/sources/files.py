"""File sources and sinks: trees, record lines, traces, sorted JSON, sliced copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.semantics import glob_match


def tree(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), size, mtime, hash, content of every file that no skip glob matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace("path", r"^\w+:/*", "/")
    below = F.regexp_replace(base, "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    rows = files.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "content")
    return reduce(lambda df, g: df.filter(~glob_match("path", g)), skip, rows)


def unmatched(spark: SparkSession, files: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """Globs that match no file; one pass with a flag per glob."""
    flags = files.agg(*(F.coalesce(F.max(glob_match("path", g)), F.lit(False)).alias(f"g{i}") for i, g in enumerate(globs)))
    pairs = ", ".join(f"'{g}', g{i}" for i, g in enumerate(globs))
    return flags.select(F.expr(f"stack({len(globs)}, {pairs}) AS (glob, hit)")).filter("NOT hit").select("glob")


#: The record kinds of the line protocol.
RECORDS = ("ARTIFACT", "STEP", "PRODUCES", "READS", "FINDING", "DONE")


def record_lines(lines: DataFrame) -> DataFrame:
    """kind and up to five fields of `MAP-<kind>|...` lines in a column value; other lines are dropped."""
    parts = F.split("value", r"\|", 6)
    kind = F.regexp_extract(parts[0], "^MAP-([A-Z]+)$", 1)
    rows = lines.filter(F.col("value").startswith("MAP-")).select(kind.alias("kind"), *(F.get(parts, F.lit(i)).alias(f"f{i}") for i in range(1, 6)))
    return rows.filter(F.col("kind").isin(*RECORDS))


def unfinished(records: DataFrame) -> DataFrame:
    """One finding if a plug-in's output has no DONE record."""
    return records.agg(F.count_if(F.col("kind") == "DONE").alias("n")).filter("n = 0").select(F.lit("half-finished output").alias("finding"))


_SPAN = T.StructType([
    T.StructField("traceId", T.StringType()), T.StructField("spanId", T.StringType()), T.StructField("parentSpanId", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("startTimeUnixNano", T.StringType()), T.StructField("endTimeUnixNano", T.StringType()),
])
TRACE = T.StructType([
    T.StructField("resourceSpans", T.ArrayType(T.StructType([T.StructField("scopeSpans", T.ArrayType(T.StructType([T.StructField("spans", T.ArrayType(_SPAN))])))]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def spans(lines: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_id, name, ms from trace export lines (column value); torn lines give none.

    Nanoseconds are too large for a double: the difference is taken in decimals.
    """
    parsed = lines.select(F.from_json("value", TRACE, {"mode": "PERMISSIVE"}).alias("j"))
    each = parsed.select(F.explode("j.resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x")).select("x.*")
    ms = (F.col("endTimeUnixNano").cast("decimal(38,0)") - F.col("startTimeUnixNano").cast("decimal(38,0)")) / 1_000_000
    return each.select(F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.col("parentSpanId").alias("parent_id"), "name", ms.cast("double").alias("ms"))


def torn_lines(lines: DataFrame) -> DataFrame:
    """How many lines are runs and how many are torn."""
    ok = F.get_json_object("value", "$.resourceSpans").isNotNull()
    return lines.filter(F.trim("value") != "").agg(F.count_if(ok).alias("runs"), F.count_if(~ok).alias("skipped"))


def untraced(found: DataFrame) -> DataFrame:
    """span_id, name, untraced_ms: a span's time that its children do not account for, at least 0."""
    kids = found.filter("parent_id IS NOT NULL AND parent_id <> ''").groupBy(F.col("parent_id").alias("span_id")).agg(F.sum("ms").alias("kids"))
    return found.join(kids, "span_id").select("span_id", "name", F.greatest(F.col("ms") - F.col("kids"), F.lit(0.0)).alias("untraced_ms"))


def sorted_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text per row with the columns in name order, rows in key order: the same bytes for the same rows."""
    return df.orderBy(*keys).select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def slim(tables: dict[str, DataFrame], keep: dict[str, str | None]) -> dict[str, DataFrame]:
    """The named tables, each with its row filter; a name that is not there is refused."""
    if missing := set(keep) - set(tables):
        raise ValueError(f"no such tables: {sorted(missing)}")
    return {name: tables[name].filter(where) if where else tables[name] for name, where in keep.items()}


def sliced(tables: dict[str, DataFrame], files: DataFrame, file: str = "file") -> dict[str, DataFrame]:
    """All tables cut down to the rows of the given files."""
    return {name: df.join(files.select(file).distinct(), file, "left_semi") if file in df.columns else df for name, df in tables.items()}


def write_runs(lines: DataFrame, folder: str, mode: str = "append") -> None:
    """Trace lines (column value) to a folder of text files: `append` keeps earlier runs, `replace` does not."""
    lines.select("value").write.mode({"append": "append", "replace": "overwrite"}[mode]).text(folder)


def view_model(edges: DataFrame, weight: str, most: int) -> DataFrame:
    """One JSON text per edge (src, dst) of the heaviest, in edge order, for a page that draws them."""
    heavy = edges.orderBy(F.desc(weight), "src", "dst").limit(most)
    return heavy.orderBy("src", "dst").select(F.to_json(F.struct("dst", "src", F.col(weight).alias("weight"))).alias("value"))


def source_state(files: DataFrame) -> DataFrame:
    """branch, commit of a tree from its version-control files (path, text): HEAD names a branch or holds a commit itself."""
    head = files.filter("path = '.git/HEAD'").select(F.trim(F.regexp_replace("text", "\n", "")).alias("h"))
    head = head.select("h", F.regexp_extract("h", "^ref: refs/heads/(.*)$", 1).alias("branch"))
    refs = files.filter("path LIKE '.git/refs/heads/%'").select(F.regexp_replace("path", "^.git/refs/heads/", "").alias("branch"), F.trim(F.regexp_replace("text", "\n", "")).alias("c"))
    return head.join(refs, "branch", "left").select(F.nullif("branch", F.lit("")).alias("branch"), F.when(F.col("branch") == "", F.col("h")).otherwise(F.col("c")).alias("commit"))
