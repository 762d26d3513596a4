"""Two-sided comparison of normalised facts per (seller, period)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MetricConfig
from ..functions.numbers import MEASURE, by_metric, ratio, within_tolerance, zero_if_null

KEY = ("seller_id", "period")
STATUSES = ("match", "mismatch", "missing_in_db", "missing_in_platform", "suspicious_extra_source")


def metric_sums(metrics: Sequence[str]) -> list[Column]:
    return [zero_if_null(F.sum(m)).alias(m) for m in metrics]


def aggregate(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Sums per (seller, period); null keys form a group, all-null sums are 0."""
    return rows.groupBy(*KEY).agg(*metric_sums(metrics))


def duplicate_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count("*").alias("row_count")).where("row_count > 1")


def tolerances(metric: Column, config: MetricConfig) -> tuple[Column, Column]:
    return by_metric(metric, config.tolerance_abs, MEASURE), by_metric(metric, config.tolerance_pct, "double")


def long_form(metrics: Sequence[str], **columns: str) -> Column:
    """One struct per metric: its name and, per column, the metric's value there."""
    return F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(m).alias("metric"),
                    *(F.col(pattern.format(m)).alias(name) for name, pattern in columns.items()),
                )
                for m in metrics
            )
        )
    )


def compare_two_sided(
    platform: DataFrame, db: DataFrame, metrics: Sequence[str], config: MetricConfig = DEFAULT
) -> DataFrame:
    """Status of every (seller, period, metric) found on either side.

    Both sides are stacked and summed by key in one aggregation instead of two
    aggregations and a full outer join: one shuffle with map-side combine, null
    keys meet each other, and no side has to be small.
    """
    metrics = sorted(metrics)

    def side(rows: DataFrame, name: str) -> DataFrame:
        def value(metric: str, owner: str) -> Column:
            cell = F.col(metric) if owner == name else F.lit(None)
            return cell.cast(MEASURE).alias(f"{owner}_{metric}")

        return rows.select(
            *KEY,
            F.lit(name == "platform").alias("on_platform"),
            *(value(m, owner) for owner in ("platform", "db") for m in metrics),
        )

    both = side(platform, "platform").unionByName(side(db, "db"))
    sums = both.groupBy(*KEY).agg(
        F.bool_or("on_platform").alias("on_platform"),
        F.bool_or(~F.col("on_platform")).alias("on_db"),
        *metric_sums([f"{owner}_{m}" for owner in ("platform", "db") for m in metrics]),
    )
    pair = long_form(metrics, platform_value="platform_{}", db_value="db_{}")
    rows = sums.select(*KEY, "on_platform", "on_db", pair.alias("pair")).select(
        *KEY, "on_platform", "on_db", "pair.*"
    )
    left, right = F.col("platform_value"), F.col("db_value")
    status = (
        F.when(~F.col("on_db"), "missing_in_db")
        .when(~F.col("on_platform"), "missing_in_platform")
        .when(within_tolerance(left, right, *tolerances(F.col("metric"), config)), "match")
        .otherwise("mismatch")
    )
    return rows.select(
        *KEY, "metric", "platform_value", "db_value",
        (right - left).alias("diff_db_minus_platform"),
        ratio(right - left, left, right).alias("diff_pct"),
        status.alias("status"),
    )


def status_summary(detail: DataFrame) -> DataFrame:
    return detail.groupBy("status").agg(F.count("*").alias("count"))
