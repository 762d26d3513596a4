"""Session settings the plans of this package are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan on real sizes: broadcast what turns out small, split skewed partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Aggregate in sort order where a sort-merge join has just sorted by the same keys.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # The same for aggregates that collect lists: by hash they start to sort after 128 keys anyway.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # A task's share of a table, and so the memory of its sums, stays the same however large the table is.
    "spark.sql.files.maxRecordsPerFile": "500000",
    "spark.sql.files.maxPartitionBytes": "16m",
    # Scratch tables and reports are written once and read a few times at most: small files are worth more than fast ones.
    "spark.sql.parquet.compression.codec": "zstd",
    # Cells laid out from sums by (seller, period) are joined where these lie, not shuffled again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
