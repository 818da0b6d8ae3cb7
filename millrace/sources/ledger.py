"""An append-only ledger as a table: records get offsets that go on from the last, a branch at a time; readers by offset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordered import numbered


class Ledger:
    """Parquet under `path`, one folder a branch. One writer at a time; a failed append leaves nothing, as Spark commits whole writes."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"ledger_offset long, batch string, {schema}"

    def table(self, branch: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/branch={branch}")

    def next_offset(self, branch: str) -> int:
        try:
            last = self.table(branch).agg(F.max("ledger_offset")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return 0 if last is None else last + 1

    def append(self, branch: str, rows: DataFrame, order: list[str]) -> int:
        """Adds rows in the order of `order` (its first column numeric); returns the offset of the first."""
        first = self.next_offset(branch)
        placed = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order, "ledger_offset").drop("_all")
        names = [c.split(" ")[0] for c in self.schema.split(", ")]
        placed = placed.withColumn("ledger_offset", F.col("ledger_offset") - 1 + first).withColumn("batch", F.lit(uuid.uuid4().hex))
        placed.select(*names).write.mode("append").parquet(f"{self.path}/branch={branch}")
        return first

    def read_range(self, branch: str, lo: int, hi: int) -> DataFrame:
        """Offsets [lo, hi): the filter reaches the scan."""
        return self.table(branch).where((F.col("ledger_offset") >= lo) & (F.col("ledger_offset") < hi)).drop("batch")

    def read_from(self, branch: str, lo: int) -> DataFrame:
        return self.table(branch).where(F.col("ledger_offset") >= lo).drop("batch")

    def at(self, branch: str, offset: int) -> DataFrame:
        return self.read_range(branch, offset, offset + 1)
