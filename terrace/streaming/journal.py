"""Change journals as streams: incremental refresh of stored rows, keyed by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: A journal entry: which file, what its content hash is now (null: gone), in which order it happened.
ENTRY = "seq long, path string, hash string"


def read_journal(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Journal files as a stream; the source's own offsets say what was read."""
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).json(folder)


def newest(entries: DataFrame) -> DataFrame:
    """The last entry of each path."""
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    return entries.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def moved(entries: DataFrame, state: DataFrame) -> DataFrame:
    """path, hash of entries that differ from the stored state (path, hash); a repeated hash moves nothing."""
    old = state.select("path", F.col("hash").alias("_h"))
    return newest(entries).join(old, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("_h"))).select("path", "hash")


def refresh(stream: DataFrame, state_folder: str, checkpoint: str, on_moved: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that keeps the state of all paths under state_folder, a version per micro-batch.

    A batch that is run again after a failure writes the same version again, so the state is
    exact. on_moved gets the moved paths of each batch, for passes that follow them.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{state_folder}/v{number - 1}") if number else spark.createDataFrame([], "path string, hash string")
        change = moved(batch, state)
        kept = state.join(newest(batch).select("path"), "path", "left_anti")
        now = newest(batch).filter("hash IS NOT NULL").select("path", "hash")
        kept.unionByName(now).write.mode("overwrite").parquet(f"{state_folder}/v{number}")
        if on_moved:
            on_moved(change, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
