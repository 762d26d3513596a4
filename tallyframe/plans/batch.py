"""Batch check: many exports against the warehouse, by source."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MetricConfig
from ..operators import audit as au
from ..operators import facts as fa
from ..operators import investigate as iv
from ..operators import sheets as sh
from ..operators import slices as sl
from ..operators.compare import status_summary
from ..sources.scratch import job_tables
from ..sources.warehouse import Warehouse
from .bundle import Bundle
from .ingest import ingest


def write_source_report(
    bundle: Bundle,
    platform: DataFrame,
    flows: Sequence[DataFrame],
    metrics: list[str],
    granularity: str = "day",
    level: str | None = "both",
    expected: DataFrame | None = None,
    config: MetricConfig = DEFAULT,
) -> None:
    """All tables of the by-source comparison.

    ``platform`` is written first; the rest starts from it and from the ``flows`` as they were
    written. These have one row for a seller, day and source each, so that by day they are not
    summed again.
    """
    platform = bundle.write("Raw_Platform_Normalized", platform)
    facts = iv.at_level(reduce(DataFrame.unionByName, flows), level)
    bundle.write("Raw_DB_By_Source", iv.with_period(facts, granularity))
    each = [iv.db_by_source(flow, granularity, level, summed=granularity == "day") for flow in flows]
    by_source = reduce(DataFrame.unionByName, each)
    cells = iv.platform_cells(platform, metrics, level)
    # Not written: the status of a cell is summed in the order of this join, which would be lost.
    rows = iv.source_rows(cells, by_source)
    detail = bundle.write("Comparison", iv.compare_by_source(rows, expected, config), "status")
    for name in sl.SLICES:
        bundle.view(name, lambda name=name: sl.slice_of(detail, name))
    investigation = bundle.write("Source_Investigation", iv.source_check_detail(rows, config))
    bundle.view("Source_Check_Detail", lambda: investigation)
    bundle.write("Summary", status_summary(detail))
    bundle.write("Duplicate_Source", iv.duplicate_source(by_source))
    bundle.write("Missing_Order_Summary", iv.missing_order_summary(detail))
    bundle.write("Preview", sl.by_source_preview(detail))
    wrong = sl.per_seller_wrong(detail).withColumn("sheet", sl.sheet_name(F.col("seller_id")))
    bundle.write("Per_Seller", wrong, cluster_by=("seller_id", "status"))
    bundle.counters(source_rows="Source_Investigation", duplicate_source="Duplicate_Source", row_count="Comparison")


def run_batch(
    warehouse: Warehouse,
    grid: DataFrame,
    specs: DataFrame,
    start: str,
    end: str,
    folder: str,
    level: str | None = "both",
    granularity: str = "day",
    clip_to_range: bool = False,
    read_errors: DataFrame | None = None,
    config: MetricConfig = DEFAULT,
    csv: bool = False,
) -> Bundle:
    """Ingest the exports, query all their sellers, compare and write the report.

    Platform days outside the range stay in by default and show up as missing
    in the database; ``clip_to_range`` drops them.
    """
    bundle = Bundle(grid.sparkSession, folder, "dq_batch_report", csv)
    with job_tables(grid.sparkSession):
        _write_batch(
            bundle, warehouse, grid, specs, start, end, level, granularity, clip_to_range, read_errors, config
        )
    return bundle


def _write_batch(
    bundle: Bundle,
    warehouse: Warehouse,
    grid: DataFrame,
    specs: DataFrame,
    start: str,
    end: str,
    level: str | None,
    granularity: str,
    clip_to_range: bool,
    read_errors: DataFrame | None,
    config: MetricConfig,
) -> None:
    read = ingest(grid, specs, granularity, config).settled()
    metrics = read.metrics()
    platform = read.facts
    if clip_to_range:
        inside = F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        platform = sh.normalized(read.parsed.where(inside), config)
    jobs = specs.select(F.trim("seller_id").alias("seller_id"), "use_item_sales").where("seller_id <> ''").distinct()
    failed: dict[str, str] = {}
    flows = fa.settled_by_switch(warehouse, jobs, start, end, level, failed)
    write_source_report(
        bundle, platform, flows, metrics, granularity, level, iv.expected_tables(specs, level), config
    )
    bundle.write("Column_Mapping", read.mapping)
    problems = read.quarantine
    if read_errors is not None:
        problems = problems.unionByName(
            read_errors.select(
                "file", F.lit("").alias("sheet"), F.lit(None).cast("bigint").alias("row_idx"),
                F.col("error").alias("reason"),
            )
        )
    bundle.write("Errors", problems)
    names = fa.choose_flows(level) + [n for n in fa.choose_flows(level, True) if n in fa.ITEM_SALES]
    expected = au.expected_queries(jobs, names, failed)
    bundle.write("DB_Query_Debug", au.audit(expected, flows, start, end))
