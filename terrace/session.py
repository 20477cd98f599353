"""Session factory and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "terrace", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects of a cluster."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there.

    The folder is the one the cluster names in spark.checkpoint.dir, which every executor
    sees, so the rows outlive any executor. Only a session without that setting (a local
    test) gets a folder of its own.
    """
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it from there; for wide rows."""
    path = f"{_shared_dir(df.sparkSession)}/terrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables written by stored() that are deleted together when the block ends.

    What leaves the block must not read them any more: cut() it, or store it outside.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._folder = spark, f"{_shared_dir(spark)}/terrace-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrace-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors the package, once per application; they need not share the driver's folders."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="terrace-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
