"""The corpus pipeline: five of the corpus operators in a row, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm import line_dedup, mixing, ngram_join, packing, quality
from terrace.session import cut, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_rows(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows.

    All columns stay, whatever their names: those beside doc_id and text travel as one struct.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("_row")) if rest else docs
    kept = line_dedup.LineIndex.build(docs).apply(rows, *(["_row"] if rest else []))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col(f"_row.c{rest.index(c)}").alias(c) for c in docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; documents without id stay.

    Rows that repeat an id are documents of their own: each stays or goes by its own text, and of
    those with the same text one stays. They are told apart by a 64-bit hash of id and text.
    """
    rows, columns = docs, docs.columns
    ids = F.col("doc_id").isNotNull()
    repeated = cut(docs.filter(ids).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id")))
    if repeated.isEmpty():
        placed = ngram_join.components(docs)
        dropped = placed.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
        return _without(docs, cut(dropped))
    whole = docs.select(F.struct(*columns).alias("_row"))
    flagged = whole.join(repeated, F.col("_row.doc_id") == F.col("_id"), "left")
    key = F.when(F.col("_id").isNotNull(), F.xxhash64("_row.doc_id", "_row.text")).otherwise(F.col("_row.doc_id"))
    rows = stored(flagged.select(key.cast("long").alias("doc_id"), F.col("_row.text").alias("text"), "_row"))
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("_row"))
    same = rows.filter(ids).withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r").unionByName(rows.filter(~ids))
    same = stored(same)
    placed = cut(ngram_join.components(same.select("doc_id", "text")))
    named = same.select("doc_id", F.col("_row.doc_id").alias("_own"))
    first = placed.filter(ids).join(named, "doc_id").groupBy("component_id").agg(F.min(F.struct("_own", "doc_id")).getField("doc_id").alias("_first"))
    dropped = placed.filter(ids).join(first, "component_id").filter("doc_id <> _first").select(F.col("doc_id").alias("_id"))
    return _without(same, cut(dropped)).select(*(F.col("_row")[c].alias(c) for c in columns))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among _id; the list is shipped while it is short."""
    small = dropped.count() <= ngram_join.JoinParams().broadcast_ids
    ids = dropped.select(F.col("_id").alias("doc_id"))
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows without an id of their own (null, or repeated) are told apart by source, id, text and their
    rank among equal ones, so that each gets the copies of one of them. All columns stay.
    """
    columns = docs.columns
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("_key"), "text", F.struct(*columns).alias("_row"))
    mixed = cut(mixing.mix(keyed.select("doc_id", "source", "_key", "text"), "_key").select("doc_id", "source", "_key", F.col("copies").cast("int").alias("_copies")))
    per = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.max("_copies").alias("_copies"))
    single = per.filter("_rows = 1 AND _id IS NOT NULL AND _copies > 0")
    taken = keyed.join(single, F.col("doc_id") == F.col("_id")).select("_row", "_copies")
    many = cut(per.filter("_rows > 1 OR _id IS NULL").select("_id"))
    if not many.isEmpty():
        equal = Window.partitionBy("source", "doc_id", "_key")
        shared = F.col("doc_id").eqNullSafe(F.col("_id"))
        rows = keyed.join(many, shared, "left_semi").withColumn("_rank", F.row_number().over(equal.orderBy(F.xxhash64("_row"))))
        ranked = mixed.join(many, shared, "left_semi").withColumn("_r", F.row_number().over(equal.orderBy(F.desc("_copies")))).filter("_copies > 0")
        given = ranked.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_r", "_copies")
        same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")) & (F.col("_rank") == F.col("_r"))
        taken = taken.unionByName(rows.join(given, same).select("_row", "_copies"))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), "_copies"))).select(*(F.col("_row")[c].alias(c) for c in columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Quantile sketches, the convex dual and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
