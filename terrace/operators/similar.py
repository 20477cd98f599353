"""Duplication: identical texts, near copies and copied lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identical(df: DataFrame, key: str, text: str) -> DataFrame:
    """digest, n, size, place: a row for each place of the texts that occur at least twice, n times in all.

    No group is gathered: a text that a third of all rows share is counted by partial sums.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.md5(text).alias("digest"), F.char_length(text).cast("long").alias("size"), F.col(key).alias("place"))
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return rows.join(groups, "digest").select("digest", "n", "size", "place")


def shingle_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, hs: the distinct five-word windows of the lower-cased text, split at single spaces, as 64-bit hashes."""
    words = df.select(F.col(key).alias("doc"), F.split(F.lower(text), " ").alias("w"))
    hashed = F.expr("CASE WHEN size(w) < 5 THEN array() ELSE transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END")
    return words.select("doc", F.array_distinct(hashed).alias("hs"))


def near_copies(df: DataFrame, key: str, text: str, least_shared: int = 3, percent: int = 75, most_owners: int = 50) -> DataFrame:
    """a, b, shared, score: pairs that share shingles with 2 to most_owners owners.

    Shingles with more owners count as vocabulary: they stay in the set sizes but link
    nothing. The owners' limit is applied by an aggregate (partial before its shuffle) ahead of the join,
    so a row of the self-join meets at most most_owners others.
    """
    sets = shingle_sets(df, key, text)
    # the outer form: the inner one adds a filter on size(hs) that would repeat the windows' expression below it
    rows = sets.select("doc", F.explode_outer("hs").alias("h")).filter("h IS NOT NULL")
    usable = rows.groupBy("h").agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners").between(2, most_owners)).select("h")
    left = rows.join(usable, "h")
    pairs = left.select("h", F.col("doc").alias("a")).join(left.select("h", F.col("doc").alias("b")), "h").filter("a < b")
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least_shared)
    # sizes are counted from the rows: a filter on size(hs) would be pushed down and repeat the windows' expression
    sizes = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("size"))
    digests = df.select(F.col(key).alias("doc"), F.md5(text).alias("digest")).join(sizes, "doc")
    of = lambda s: digests.select(F.col("doc").alias(s), F.col("digest").alias(f"d_{s}"), F.col("size").alias(f"s_{s}"))
    both = shared.join(of("a"), "a").join(of("b"), "b").filter("d_a <> d_b")
    scored = both.withColumn("score", F.expr("shared * 100 div (s_a + s_b - shared)"))
    return scored.filter(F.col("score") >= percent).select("a", "b", "shared", "score")


def copied_lines(df: DataFrame, key: str, text: str, width: int = 20) -> DataFrame:
    """line, n_places, place: a row for each place of the lines of at least width characters in two places or more.

    Of lines with the same places the widest stays; sets of places are compared by their count and
    two sums of hashes, never gathered.
    """
    lines = df.select(F.col(key).alias("doc"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    wide = lines.filter(F.char_length(F.trim("line")) >= width)
    sums = [F.sum(F.xxhash64("doc", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    groups = wide.groupBy("line").agg(F.count(F.lit(1)).alias("n_places"), *sums).filter("n_places >= 2")
    widest = F.min(F.struct((-F.char_length("line")).alias("w"), F.col("line").alias("line")))
    best = groups.groupBy("n_places", "s1", "s2").agg(widest.alias("b")).select(F.col("b.line").alias("line"), "n_places")
    return wide.join(best, "line").select("line", "n_places", F.col("doc").alias("place"))
