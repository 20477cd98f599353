"""Markdown and SQL text as rows: sections, links, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.semantics import normal_path


def sections(docs: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, line, level, heading path joined by ` > ` and text of each non-heading line; level 0 before any heading.

    Fenced blocks are text. The open headings of a line follow from running last values per
    level, so a document is a window, not a Python loop.
    """
    rows = docs.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("line", "t"))
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("fenced", F.sum(F.col("t").rlike(r"^\s*(```|~~~)").cast("int")).over(w) % 2 == 1)
    level = F.when(~F.col("fenced") & F.col("t").rlike("^#{1,6} "), F.length(F.regexp_extract("t", "^(#+) ", 1)))
    rows = rows.withColumn("h", level).withColumn("title", F.when(F.col("h").isNotNull(), F.trim(F.regexp_replace("t", "^#+ ", ""))))
    last_at = lambda k: F.max(F.when(F.col("h") == k, F.struct("line", "title"))).over(w)
    rows = rows.withColumns({f"l{k}": last_at(k) for k in range(1, 7)})
    parts, since = [], F.lit(-1)
    for k in range(1, 7):
        alive = F.col(f"l{k}").isNotNull() & (F.col(f"l{k}.line") > since)
        parts.append(F.when(alive, F.col(f"l{k}.title")))
        since = F.when(alive, F.col(f"l{k}.line")).otherwise(since)
    held = F.array_compact(F.array(*parts))
    return rows.filter("h IS NULL AND trim(t) <> ''").select("path", (F.col("line") + 1).cast("long").alias("line"), F.size(held).cast("long").alias("level"), F.array_join(held, " > ").alias("section"), F.col("t").alias("text"))


def links(docs: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, target of local Markdown links, fragment cut, resolved against the document's folder."""
    found = docs.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(r"\]\(([^)\s#]+)[^)]*\)"), F.lit(1))).alias("target"))
    local = found.filter(~F.col("target").rlike(r"^[a-z]+:"))
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    return local.withColumn("target", normal_path(F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(folder, "target"))))


def link_status(found: DataFrame, files: DataFrame) -> DataFrame:
    """path, target, status: bound where the target is a known file or folder, else missing."""
    known = files.select(F.col("path").alias("target")).union(files.select(F.regexp_replace("path", "/[^/]*$", "").alias("target"))).distinct().withColumn("k", F.lit(1))
    return found.join(known, "target", "left").select("path", "target", F.when(F.col("k") == 1, "bound").otherwise("missing").alias("status"))


def sql_operators(spark: SparkSession, statements: list[tuple[str, str]]) -> DataFrame:
    """id, depth, operator rows of each SQL text through Catalyst's own parser; what does not parse is `unparsed`."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    rows: list[tuple[str, int, str]] = []
    for key, text in statements:
        try:
            shown = parser.parsePlan(text).treeString()
        except Exception:  # noqa: BLE001 - the JVM's parse error is the answer
            rows.append((key, 0, "unparsed"))
            continue
        for line in shown.strip().split("\n"):
            body = line.lstrip(" :+-'")
            rows.append((key, (len(line) - len(line.lstrip(" :+-"))) // 3, body.split(" ")[0].split("[")[0]))
    return spark.createDataFrame(rows, "id string, depth long, operator string")


def broken_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """path, target of the local links that reach no known file or folder."""
    return link_status(links(docs), files).filter("status = 'missing'").select("path", "target").distinct()


def code_lines(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, n_lines: lines of a C-style source with more than blanks and comments; block comments may span lines or stay open.

    A block comment over several lines leaves a line break, so that code before and after it stays two lines. Comment marks
    inside string literals are taken for comments.
    """
    body = F.regexp_replace(F.col(text).cast("string"), r"/\*(?:(?!\*/)[^\n])*\*/", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)/\*.*?(?:\*/|\z)", "\n"), r"//[^\n]*", "")
    return files.select(path, F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S"))).cast("long").alias("n_lines"))


#: A statement: anything up to a semicolon outside quotes, comments and brackets of identifiers.
STATEMENT = r"(?s)(?:--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|\[[^\]]*\]|[^;'\"\[])+"


def statements(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, statement: the statements of SQL texts, cut at semicolons outside quotes and comments, blank ones left out."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(0)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return texts.select(key, F.posexplode(found).alias("ord", "statement")).withColumn("ord", F.col("ord").cast("long"))
