"""Report bundle: a folder of tables written by the executors.

Tables that others are derived from are written first and read back, so no
stage is computed twice. Rows are counted while they are written. Slices of a written
table by status are views on it: the table is partitioned by that column and Spark
prunes to that folder. A table that is looked up by other columns is clustered by
them: each value lies in one file or a few next to each other, whose statistics
let a reader skip all others.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def safe_name(value: str, blank: str = "seller") -> str:
    """A report name part fit for a folder name."""
    return re.sub("[^A-Za-z0-9_-]+", "_", value).strip("_") or blank


def month_label(month: str) -> str:
    """``yyyymm`` of a month given as date text; other text is only made safe."""
    try:
        return date.fromisoformat(f"{month}-01"[:10]).strftime("%Y%m")
    except ValueError:
        return safe_name(month, "month")


class Bundle:
    def __init__(self, spark: SparkSession, folder: str, kind: str, csv: bool = False):
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        self.spark, self.csv = spark, csv
        self.path = f"{folder.rstrip('/')}/{kind}_{stamp}_{uuid.uuid4().hex[:12]}"
        self._tables: dict[str, Callable[[], DataFrame]] = {}
        self._counts: dict[str, Observation] = {}

    def write(
        self, name: str, df: DataFrame, partition_by: str | None = None, cluster_by: Sequence[str] = ()
    ) -> DataFrame:
        """Write a table and return it as read back, with its size known."""
        path = f"{self.path}/{name}"
        if cluster_by:
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        self._counts[name] = Observation()
        counted = df.observe(self._counts[name], F.count(F.lit(1)).alias("n"))
        writer = counted.write.partitionBy(partition_by) if partition_by else counted.write
        writer.parquet(path)
        self._tables[name] = lambda: self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        written = self.table(name)
        if self.csv:
            plain = written.select(*(F.col(c).cast("string") for c in df.columns))
            plain.write.option("header", True).csv(f"{self.path}/csv/{name}")
        return written

    def view(self, name: str, make: Callable[[], DataFrame]) -> None:
        """A report table that is a filter or second name of a written one."""
        self._tables[name] = make

    def counters(self, **tables: str) -> None:
        """A table with the number of rows of some written ones, each under a name of its own."""
        rows = [(name, self._counts[table].get["n"]) for name, table in tables.items()]
        self.write("Counters", self.spark.createDataFrame(rows, "counter string, value long"))

    def params(self, **values: str) -> DataFrame:
        row = [tuple("" if v is None else str(v) for v in values.values())]
        schema = ", ".join(f"{name} string" for name in values)
        return self.write("Params", self.spark.createDataFrame(row, schema))

    def table(self, name: str) -> DataFrame:
        return self._tables[name]()

    @property
    def names(self) -> list[str]:
        return list(self._tables)

    def manifest(self) -> DataFrame:
        """Row count per report table."""
        counts = [
            self.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("row_count"))
            for n in self.names
        ]
        out = counts[0]
        for extra in counts[1:]:
            out = out.unionByName(extra)
        return out
