"""Full text over token postings (doc, token, pos)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.semantics import tokens


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc"), F.posexplode(tokens(text)).alias("pos", "token"))


def match_all(posted: DataFrame, words: list[str]) -> DataFrame:
    """Documents that hold every word; one aggregate, no join per word."""
    got = posted.filter(F.col("token").isin(words)).groupBy("doc").agg(F.countDistinct("token").alias("k"))
    return got.filter(F.col("k") == len(set(words))).select("doc")


def match_any(posted: DataFrame, words: list[str]) -> DataFrame:
    return posted.filter(F.col("token").isin(words)).select("doc").distinct()


def match_not(posted: DataFrame, words: list[str], without: list[str]) -> DataFrame:
    return match_all(posted, words).join(match_any(posted, without), "doc", "left_anti")


def match_phrase(posted: DataFrame, words: list[str]) -> DataFrame:
    """Documents and how often the words stand side by side: each hit votes for the position the phrase would start at."""
    votes = None
    for i, word in enumerate(words):
        v = posted.filter(F.col("token") == word).select("doc", (F.col("pos") - i).alias("at"))
        votes = v if votes is None else votes.unionAll(v)
    starts = votes.groupBy("doc", "at").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(words))
    return starts.groupBy("doc").agg(F.count(F.lit(1)).alias("hits"))


def match_prefix(posted: DataFrame, prefix: str) -> DataFrame:
    return posted.filter(F.col("token").startswith(prefix)).groupBy("doc").agg(F.count(F.lit(1)).alias("hits"))


def search(posted: DataFrame, query: str) -> DataFrame:
    """Bare words (all), `a OR b`, `a NOT b`, `"a phrase"` and `pre*`; what does not parse is taken as a phrase."""
    q = query.strip()
    if m := re.fullmatch(r'"([^"]+)"', q):
        return match_phrase(posted, re.findall("[a-z0-9]+", m[1].lower())).select("doc")
    if m := re.fullmatch(r"([A-Za-z0-9]+)\*", q):
        return match_prefix(posted, m[1].lower()).select("doc")
    if m := re.fullmatch(r"(\w+) NOT (\w+)", q):
        return match_not(posted, [m[1].lower()], [m[2].lower()])
    if re.fullmatch(r"\w+( OR \w+)+", q):
        return match_any(posted, [w.lower() for w in q.split(" OR ")])
    if re.fullmatch(r"\w+(( AND)? \w+)*", q):
        return match_all(posted, [w.lower() for w in q.split() if w != "AND"])
    return match_phrase(posted, re.findall("[a-z0-9]+", q.lower())).select("doc")


def snippet(df: DataFrame, key: str, text: str, word: str, width: int = 12) -> DataFrame:
    """key and the window of width tokens that starts half a window before the first hit, the hit in >> <<."""
    t = df.select(F.col(key).alias("doc"), tokens(text).alias("t")).withColumn("at", F.array_position("t", word)).filter("at > 0")
    first = F.greatest(F.lit(1), (F.col("at") - width // 2).cast("int"))
    marked = F.transform(F.slice("t", first, F.lit(width)), lambda x, i: F.when(i + first == F.col("at"), F.concat(F.lit(">>"), x, F.lit("<<"))).otherwise(x))
    return t.select("doc", F.array_join(marked, " ").alias("snippet"))
