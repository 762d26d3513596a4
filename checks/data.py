"""Spark side of the check data: driver tables and the views on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.scratch import settle
from tallyframe.sources.warehouse import Warehouse

from .views import SPARK_VIEWS, VIEWS, inputs

# Views that join or sum are derived once per session and written out, as a warehouse would hold
# them. Those in _INLINE are their inputs row by row: they stay part of the plan and are not written.
_KEPT: dict[tuple[str, str, str], DataFrame] = {}
_WAREHOUSES: dict[tuple[str, str], Warehouse] = {}
_INLINE = {"lines", "collected", "ecommerce_item", "ecommerce_export_sku_sales", "ecommerce_export_sku_traffic"}
# Two tables of sums by the same keys: both are columns of one table, which is shuffled and written once.
_SELLER_DAYS = "collected_by_seller"
_SUMMED = {
    "ecommerce_export_seller_sales": lambda days: days.select(F.col("seller_full").alias("seller"), "day", "source", "quantity", "revenue"),
    "ecommerce_export_seller_traffic": lambda days: days.select(
        F.concat_ws(".", "seller_full", F.lit("shop")).alias("fk_seller_used_id"), "day", "source", "page_view"
    ),
}
# The large table all views start from, and those of its columns that any of them reads. While it is
# small it may be a single file that only one task can read, so it is dealt out once, as narrow as it
# is. A table that Spark reads in parts for every core anyway is read where it lies.
_DEALT = {"lineitem": (
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
)}


# A table of so many parts for each core is not dealt out.
_PARTS_PER_CORE = 2


def _dealt(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """In as many files as there are cores, as a warehouse table would be."""
    narrow, cores = table.select(*columns), table.sparkSession.sparkContext.defaultParallelism
    if narrow.rdd.getNumPartitions() >= _PARTS_PER_CORE * cores:
        return narrow
    return settle(narrow.repartition(cores), "dealt", lasting=True)


class CheckData:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in SPARK_VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _KEPT and name in _SUMMED:
            _KEPT[key] = _SUMMED[name](self._seller_days())
        elif key not in _KEPT:
            text = VIEWS[name]
            frames = {source: self._input(source) for source in inputs(text)}
            view = self.spark.sql(text, **frames)
            _KEPT[key] = view if name in _INLINE else settle(view, name, lasting=True)
        return _KEPT[key]

    def _seller_days(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, _SELLER_DAYS)
        if key not in _KEPT:
            sums = {"quantity": "quantity", "revenue": "s_onsite_selling", "page_view": "page_view"}
            days = self.table("collected").groupBy("seller_full", "day", "source")
            _KEPT[key] = settle(days.agg(*(F.sum(c).alias(m) for m, c in sums.items())), _SELLER_DAYS, lasting=True)
        return _KEPT[key]

    def _input(self, name: str) -> DataFrame:
        """What views read ``name`` from."""
        if name not in _DEALT:
            return self.table(name)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _KEPT:
            _KEPT[key] = _dealt(self.table(name), _DEALT[name])
        return _KEPT[key]

    @property
    def warehouse(self) -> Warehouse:
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _WAREHOUSES:
            _WAREHOUSES[key] = Warehouse(self.table)
        return _WAREHOUSES[key]

    @property
    def sellers(self) -> DataFrame:
        return self.table("ecommerce_seller").select(F.col("used_id").alias("seller_id"))

    @property
    def grid(self) -> DataFrame:
        cells = F.array(*(f"c{i}" for i in range(6)))
        return self.table("export_grid").select(
            "file", "sheet", F.col("row_idx").cast("bigint").alias("row_idx"), cells.alias("cells"),
            F.lit(False).alias("has_header"),
        )

    @property
    def db_grid(self) -> DataFrame:
        cells = F.array(*(f"c{i}" for i in range(6)))
        return self.table("db_grid").select(
            "file", "sheet", F.col("row_idx").cast("bigint").alias("row_idx"), cells.alias("cells"),
            F.lit(True).alias("has_header"),
        )

    @property
    def specs(self) -> DataFrame:
        return self.table("export_specs")
