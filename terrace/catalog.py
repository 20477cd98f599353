"""Tables by name, with the tolerance that lenses need: a missing column reads as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Catalog:
    """Parquet tables of one folder, read lazily so that scans stay pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def has(self, table: str, column: str) -> bool:
        return column in self[table].columns

    def column(self, table: str, column: str) -> Column:
        """The column, or a null of that name where the table lacks it."""
        return F.col(column) if self.has(table, column) else F.lit(None).cast("string").alias(column)

    def register(self, names: tuple[str, ...] = TABLES) -> None:
        """Temp views for the raw SQL surface."""
        for name in names:
            self[name].createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        """A read-only statement over the registered tables; anything but a query is refused."""
        parsed = text.lstrip().split(None, 1)
        if not parsed or parsed[0].lower() not in ("select", "with", "values", "from", "table", "("):
            raise ValueError("only queries are accepted")
        self.register()
        return self.spark.sql(text)
