"""Slash paths: test code, fragments below a root, paths spelled from two roots, waivers, tracked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.semantics import fragment, glob_match

#: What marks a lower-cased path, with a slash before it, as test code.
TEST_PATH = r"/tests?/|\.tests/|_test\.|/test_|\.spec\.|\.test\.|tests\.cs$"


def not_test(path: str) -> Column:
    """The path is no test code; null for a null path."""
    return ~F.concat(F.lit("/"), F.lower(path)).rlike(TEST_PATH)


def below_roots(wanted: str, roots: list[tuple[str, str]]) -> list[str]:
    """The fragment without the leading folders that a root (prefix, folder) ends with, longest cut first within a root."""
    parts = wanted.replace("\\", "/").split("/")
    found = []
    for prefix, folder in roots:
        ending = folder.replace("\\", "/").rstrip("/").lower()
        for k in range(len(parts) - 1, 0, -1):
            cut = "/".join(parts[:k]).lower()
            if cut and ending.endswith("/" + cut):
                found.append(prefix + "/".join(parts[k:]))
    return found


def under_root(df: DataFrame, path: str, wanted: str, roots: list[tuple[str, str]]) -> DataFrame:
    """Rows whose path holds the fragment, with read_as; where none does, those of the first spelling below a root that finds any.

    All spellings are tried in one pass: a row keeps the first it holds, and the least of these answers.
    """
    spellings = list(dict.fromkeys([wanted, *below_roots(wanted, roots)]))
    first = F.coalesce(*(F.when(fragment(path, s), F.lit(i)) for i, s in enumerate(spellings)))
    hits = df.withColumn("_s", first).filter("_s IS NOT NULL")
    least = hits.agg(F.min("_s").alias("_s")).filter("_s IS NOT NULL")
    return hits.join(F.broadcast(least), "_s").withColumn("read_as", F.get(F.array(*map(F.lit, spellings)), F.col("_s"))).drop("_s")


def either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_path, right_path: equal, or one ends with a slash and the other; from column path of both sides.

    Both share their last segment, so the join is on that and the ending is tested on what is left.
    """
    side = lambda df, name: df.select(F.col("path").alias(name), F.substring_index("path", "/", -1).alias("_l")).distinct()
    a, b = F.col("left_path"), F.col("right_path")
    same = (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))
    return side(left, "left_path").join(side(right, "right_path"), "_l").filter(same).select("left_path", "right_path")


def unwaived(found: DataFrame, lines: DataFrame, marker: str) -> DataFrame:
    """Findings (path, line) but those whose line, or the line above, holds the marker; lines are (path, line, text).

    Only marked lines are joined, each under its own number and the next.
    """
    marked = lines.filter(F.col("text").contains(marker)).select("path", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"))
    return found.join(marked.distinct(), ["path", "line"], "left_anti")


def tracked(listed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """path, state: a listed path is `tracked`, or `deleted` where the disk lacks it; a path only on disk is `untracked`."""
    a = listed.select("path").distinct().withColumn("_a", F.lit(1))
    b = on_disk.select("path").distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_b").isNull(), "deleted").when(F.col("_a").isNull(), "untracked").otherwise("tracked")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def path_claims(texts: DataFrame, key: str, text: str, files: DataFrame) -> DataFrame:
    """key, claim, exists: relative paths with an extension that a text names between backticks, and whether a file is there.

    A claim is met by a file of that path or one that ends with it at a slash.
    """
    claims = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"`([\w.-]+(?:/[\w.-]+)*\.\w+)`"), F.lit(1)))).alias("claim"))
    met = either_way(claims.select(F.col("claim").alias("path")), files.select("path")).filter(F.char_length("right_path") >= F.char_length("left_path"))
    return claims.join(met.select(F.col("left_path").alias("claim"), F.lit(True).alias("exists")).distinct(), "claim", "left").select(key, "claim", F.coalesce("exists", F.lit(False)).alias("exists"))


def module_files(uses: DataFrame, files: DataFrame) -> DataFrame:
    """file, used, target: the source file a qualified module path (crate::a::b::Item) reaches, null where none does.

    crate is the source root, self the using module, super the one above. A module a::b is src/a/b.rs or
    src/a/b/mod.rs; the longest prefix that is a file answers, so items need no list of their own.
    """
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\.rs$", ""), "/(mod|lib|main)$", ""), "^src/?", "")
    own = F.filter(F.split(module, "/"), lambda s: s != "")
    segs = F.split("used", "::")
    first, rest = segs[0], F.slice(segs, F.lit(2), F.size(segs))
    start = F.when(first == "crate", rest).when(first == "self", F.concat(own, rest)).when(first == "super", F.concat(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), rest))
    walk = uses.select("file", "used", start.alias("_s")).distinct()
    tries = F.transform(F.sequence(F.lit(1), F.size("_s")), lambda i: F.struct(i.alias("n"), F.array_join(F.slice("_s", F.lit(1), i), "/").alias("m")))
    cand = walk.filter("size(_s) > 0").select("file", "used", F.explode(tries).alias("t")).select("file", "used", "t.*")
    known = files.filter("path LIKE 'src/%.rs'").select("path", F.regexp_replace(F.regexp_replace("path", r"(/mod)?\.rs$", ""), "^src/", "").alias("m"))
    best = cand.join(known, "m").groupBy("file", "used").agg(F.max_by("path", "n").alias("target"))
    return uses.select("file", "used").distinct().join(best, ["file", "used"], "left")


def unclaimed(df: DataFrame, path: str, globs: tuple[str, ...]) -> DataFrame:
    """Rows whose path no glob matches; few globs are one test in place."""
    return reduce(lambda rows, g: rows.filter(~glob_match(path, g)), globs, df)
