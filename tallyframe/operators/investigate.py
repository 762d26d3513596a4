"""Platform against database by source: status per cell and the source check.

The platform decides which cells exist: every (seller, period) of it is laid
out as level x data type. Database facts are summed per source and
joined to these cells; the joined rows are the source check, and one more
aggregation in the order of that join gives the status of the cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LEVELS, MetricConfig, one_of
from ..functions.dates import period_label
from ..functions.numbers import MEASURE, ratio, within_tolerance, zero_if_null
from ..functions.text import joined
from .compare import KEY, aggregate, tolerances
from .facts import LAID_BY

METRICS = ("quantity", "revenue", "page_view")
ORDERS = "orders"
CELL = (*KEY, "data_level", "data_type")

# The cells expected per (seller, period) and the metrics they carry.
EXPECTED = (
    ("seller", "seller_sales", ("quantity", "revenue")),
    ("seller", "seller_traffic", ("page_view",)),
    ("sku", "sku_sales", ("quantity", "revenue")),
    ("sku", "sku_traffic", ("page_view",)),
)

RECOMMENDATIONS = {
    "match": "OK",
    "suspicious_extra_source": (
        "One source alone equals the platform but all sources together do not. "
        "Review and remove the remaining sources."
    ),
    "missing_in_db": "The database has no data for this metric. Rerun or check the transform.",
    "mismatch": "The database has data but no source equals the platform. Check collection and source logic.",
}


def expected_cells(level: str | None = "both"):
    level = one_of(level, LEVELS, "level", "both")
    return [cell for cell in EXPECTED if level in ("both", cell[0])]


def expected_types(level: str | None = "both") -> Column:
    return F.explode(
        F.array(
            *(
                F.struct(F.lit(lv).alias("data_level"), F.lit(dt).alias("data_type"))
                for lv, dt, _ in expected_cells(level)
            )
        )
    )


def expected_grid(platform: DataFrame, level: str | None = "both") -> DataFrame:
    """Distinct platform keys times the expected (level, type) rows."""
    keys = platform.select(*KEY).distinct()
    return keys.select(*KEY, expected_types(level).alias("cell")).select(*KEY, "cell.*")


def platform_cells(
    platform: DataFrame, metrics: Sequence[str], level: str | None = "both", laid: int | None = None
) -> DataFrame:
    """One row per (seller, period, level, type) with the platform values it carries.

    ``p_<metric>`` is null where the type does not carry the metric or the
    platform does not have it; such a cell does not exist. With ``laid`` the cells come in so
    many parts by seller: sources that lie in as many are joined without a shuffle.
    """
    if laid:
        platform = platform.repartition(laid, *LAID_BY)
    has_orders = ORDERS in metrics
    shown = [m for m in METRICS if m in metrics]
    sums = aggregate(platform, [*shown, *([ORDERS] if has_orders else [])])

    def value(metric: str, carried: Sequence[str]) -> Column:
        found = F.col(metric) if metric in shown and metric in carried else F.lit(None)
        return found.cast(MEASURE).alias(f"p_{metric}")

    cells = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(lv).alias("data_level"),
                    F.lit(dt).alias("data_type"),
                    *(value(m, carried) for m in METRICS),
                )
                for lv, dt, carried in expected_cells(level)
            )
        )
    )
    orders = F.col(ORDERS) if has_orders else F.lit(None)
    return sums.select(
        *KEY, orders.cast(MEASURE).alias("platform_orders"),
        F.lit(has_orders).alias("platform_orders_available"), cells.alias("cell"),
    ).select(*KEY, "cell.*", "platform_orders", "platform_orders_available")


def with_period(facts: DataFrame, granularity: str) -> DataFrame:
    """Facts with a period label; without a query table, the data type stands in."""
    if "query_source_table" not in facts.columns:
        facts = facts.withColumn("query_source_table", F.col("data_type"))
    return facts.withColumn("period", period_label(F.col("day").cast("date"), granularity))


def at_level(rows: DataFrame, level: str | None) -> DataFrame:
    level = one_of(level, LEVELS, "level", "both")
    return rows if level == "both" else rows.where(F.col("data_level") == level)


def db_by_source(facts: DataFrame, granularity: str, level: str | None = "both", summed: bool = False) -> DataFrame:
    """Sums per cell, query table and source; absent or non-numeric metrics are 0.

    ``summed`` says that the facts have one row for each of these already, as the flows
    have that were summed by periods of this length: then nothing is shuffled again.
    """
    rows = with_period(at_level(facts, level), granularity)
    for metric in METRICS:
        value = F.col(metric) if metric in facts.columns else F.lit(0)
        rows = rows.withColumn(metric, value.try_cast(MEASURE))
    if summed:
        return rows.select(*CELL, "query_source_table", "source", *(zero_if_null(F.col(m)).alias(m) for m in METRICS))
    sums = (zero_if_null(F.sum(m)).alias(m) for m in METRICS)
    return rows.groupBy(*CELL, "query_source_table", "source").agg(*sums)


def db_all_sources(by_source: DataFrame) -> DataFrame:
    return by_source.groupBy(*CELL).agg(*(zero_if_null(F.sum(m)).alias(m) for m in METRICS))


def query_table_label(by_source: DataFrame) -> DataFrame:
    """The query tables seen per cell, sorted and joined; blanks are left out."""
    shown = F.when(F.trim("query_source_table") != "", F.col("query_source_table"))
    return (
        by_source.dropna(subset=list(CELL))
        .groupBy(*CELL)
        .agg(joined(F.collect_set(shown)).alias("query_source_table"))
    )


def duplicate_source(by_source: DataFrame) -> DataFrame:
    """Keys served by more than one source. Sources are distinct already."""
    return (
        by_source.groupBy(*CELL, "query_source_table")
        .agg(F.count("source").alias("source_count"))
        .where("source_count > 1")
    )


def source_rows(cells: DataFrame, by_source: DataFrame) -> DataFrame:
    """Cells joined to their sources, all metrics side by side.

    A cell without any source keeps one row, with ``seen`` null. Metrics are
    only laid out as rows after the join, so each source is shuffled once.
    """
    sources = by_source.select(
        *CELL, "query_source_table", "source", *(F.col(m).alias(f"s_{m}") for m in METRICS),
        F.lit(True).alias("seen"),
    )
    return cells.join(sources, list(CELL), "left")


def _per_metric(**columns: Callable[[str], Column]) -> Column:
    """One struct per metric; those without a platform value are of metrics the cell does not have.

    These are filtered out afterwards: an array that leaves them out would need a loop that
    Spark does not compile.
    """
    return F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"p_{m}").alias("platform_value"),
                    *(make(m).alias(name) for name, make in columns.items()),
                )
                for m in METRICS
            )
        )
    )


def source_check_detail(rows: DataFrame, config: MetricConfig = DEFAULT) -> DataFrame:
    """Every source of every cell against the platform value."""
    pair = _per_metric(source_value=lambda m: F.col(f"s_{m}"))
    long = rows.where("seen").select(*CELL, "query_source_table", "source", pair.alias("pair")).select(
        *CELL, "query_source_table", "pair.metric", "source", "pair.source_value", "pair.platform_value"
    ).where("platform_value is not null")
    platform, source = F.col("platform_value"), F.col("source_value")
    match = within_tolerance(platform, source, *tolerances(F.col("metric"), config))
    note = F.when(F.col("source_match"), "MATCH_UI").when(source > platform, "OVER_UI").otherwise("UNDER_UI")
    accuracy = F.when(platform != 0, source.cast("double") / platform.cast("double")).otherwise(
        F.when(source == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return (
        long.withColumn("source_diff", source - platform)
        .withColumn("source_accuracy", accuracy)
        .withColumn("source_match", match)
        .withColumn("investigation_note", note)
    )


def expected_tables(specs: DataFrame, level: str | None = "both") -> DataFrame:
    """The query table each (seller, level, type) should come from; the last spec wins."""
    item = F.col("use_item_sales")
    sales = {
        dt: F.when(item, F.lit(f"item_{dt}")).otherwise(F.lit(dt)) for dt in ("seller_sales", "sku_sales")
    }
    cells = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(lv).alias("data_level"),
                    F.lit(dt).alias("data_type"),
                    sales.get(dt, F.lit(dt)).alias("query_source_table"),
                )
                for lv, dt, _ in expected_cells(level)
            )
        )
    )
    seller = F.trim("seller_id")
    rows = specs.where(F.coalesce(seller, F.lit("")) != "").select(
        seller.alias("seller_id"), "position", cells.alias("cell")
    )
    return rows.groupBy("seller_id", "cell.data_level", "cell.data_type").agg(
        F.max_by("cell.query_source_table", "position").alias("query_source_table")
    )


def _status(platform: Column, db: Column, matched: Column, config: MetricConfig, metric: str | None = None) -> Column:
    """Of a metric in a cell; ``matched`` says whether one source alone equals the platform."""
    limits = tolerances(F.lit(metric) if metric else F.col("metric"), config)
    return (
        F.when(within_tolerance(platform, db, *limits), "match")
        .when(matched, "suspicious_extra_source")
        .when((db == 0) & (platform != 0), "missing_in_db")
        .otherwise("mismatch")
    )


def _matches(metric: str, config: MetricConfig) -> Column:
    """Does the source of a joined row equal the platform on its own?"""
    limits = tolerances(F.lit(metric), config)
    return F.col("seen") & within_tolerance(F.col(f"p_{metric}"), F.col(f"s_{metric}"), *limits)


def cell_statuses(rows: DataFrame, config: MetricConfig = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Status per cell and metric from ``source_rows``, when no one asks which sources match.

    Nothing is collected: of a cell only sums and flags are kept, whatever the number of
    its sources. Columns in ``by`` belong to the cell and are carried along.
    """
    per_cell = rows.groupBy(*CELL).agg(
        *(F.first(c).alias(c) for c in by),
        *(F.first(f"p_{m}").alias(f"p_{m}") for m in METRICS),
        *(zero_if_null(F.sum(f"s_{m}")).alias(f"s_{m}") for m in METRICS),
        *(F.bool_or(_matches(m, config)).alias(f"m_{m}") for m in METRICS),
    )
    value = _per_metric(db_all_sources=lambda m: F.col(f"s_{m}"), matched=lambda m: F.col(f"m_{m}"))
    cells = per_cell.select(*CELL, *by, value.alias("value")).select(*CELL, *by, "value.*").where("platform_value is not null")
    platform, db = F.col("platform_value"), F.col("db_all_sources")
    matched = F.coalesce("matched", F.lit(False))
    return cells.withColumn("status", _status(platform, db, matched, config)).withColumn(
        "diff_db_minus_platform", db - platform
    ).drop("matched")


def missing_orders(rows: DataFrame, config: MetricConfig = DEFAULT) -> DataFrame:
    """``missing_order_summary`` from ``source_rows`` without the detail of all cells.

    The label of a cell is made of its query tables. Its sources are first summed per table, so
    only the few tables of a cell meet, and only where a metric is missing.
    """
    orders = ("platform_orders", "platform_orders_available")
    table = F.when(F.trim("query_source_table") != "", F.col("query_source_table"))
    per_table = rows.groupBy(*CELL, table.alias("label")).agg(
        F.bool_or("seen").alias("seen"),
        *(F.first(c).alias(c) for c in orders),
        *(F.first(f"p_{m}").alias(f"p_{m}") for m in METRICS),
        *(F.sum(f"s_{m}").alias(f"s_{m}") for m in METRICS),
        *(F.bool_or(_matches(m, config)).alias(f"m_{m}") for m in METRICS),
    )
    per_cell = per_table.groupBy(*CELL).agg(
        F.bool_or("seen").alias("seen"),
        *(F.first(c).alias(c) for c in orders),
        *(F.first(f"p_{m}").alias(f"p_{m}") for m in METRICS),
        *(zero_if_null(F.sum(f"s_{m}")).alias(f"s_{m}") for m in METRICS),
        *(F.coalesce(F.bool_or(f"m_{m}"), F.lit(False)).alias(f"m_{m}") for m in METRICS),
        F.expr("listagg(label, ', ') within group (order by label)").alias("label"),
    )
    missing = {
        m: (_status(F.col(f"p_{m}"), F.col(f"s_{m}"), F.col(f"m_{m}"), config, m) == "missing_in_db") & F.col(f"p_{m}").isNotNull()
        for m in METRICS
    }
    cells = per_cell.select(
        *KEY, *orders, F.coalesce(F.when(F.col("seen"), F.coalesce("label", F.lit(""))), F.col("data_type")).alias("label"),
        *(wrong.alias(f"no_{m}") for m, wrong in missing.items())
    )
    cells = cells.where(" or ".join(f"no_{m}" for m in METRICS))
    shown = [F.when(F.bool_or(f"no_{m}"), F.lit(m)) for m in sorted(METRICS)]
    return cells.groupBy(*KEY).agg(
        F.max("platform_orders").alias("platform_orders"),
        F.bool_or("platform_orders_available").alias("platform_orders_available"),
        F.sum(sum((F.col(f"no_{m}").cast("long") for m in METRICS), F.lit(0))).alias("missing_rows"),
        F.concat_ws(", ", *shown).alias("missing_metrics"),
        F.expr("listagg(distinct label, ', ') within group (order by label)").alias("missing_query_tables"),
    )


def compare_by_source(
    rows: DataFrame, expected: DataFrame | None = None, config: MetricConfig = DEFAULT
) -> DataFrame:
    """Status per cell and metric from ``source_rows``.

    The only lists built are those the report shows: the query tables of a
    cell and the sources that match on their own.
    """
    table = F.col("query_source_table")

    def matching(metric: str) -> Column:
        return F.sort_array(F.collect_list(F.when(_matches(metric, config), F.struct(table, F.col("source")))))

    per_cell = rows.groupBy(*CELL).agg(
        F.first("platform_orders").alias("platform_orders"),
        F.first("platform_orders_available").alias("platform_orders_available"),
        F.bool_or("seen").alias("any_source"),
        F.collect_set(F.when(F.trim(table) != "", table)).alias("tables"),
        *(F.first(f"p_{m}").alias(f"p_{m}") for m in METRICS),
        *(zero_if_null(F.sum(f"s_{m}")).alias(f"s_{m}") for m in METRICS),
        *(matching(m).alias(f"m_{m}") for m in METRICS),
    )
    label = F.when(F.col("any_source"), joined(F.col("tables")))
    if expected is not None:
        named = expected.withColumnRenamed("query_source_table", "expected_table")
        per_cell = per_cell.join(named, ["seller_id", "data_level", "data_type"], "left")
        label = F.coalesce(label, F.col("expected_table"))
    value = _per_metric(
        db_all_sources=lambda m: F.col(f"s_{m}"), matching=lambda m: F.col(f"m_{m}")
    )
    per_cell = per_cell.select(
        *CELL, F.coalesce(label, F.col("data_type")).alias("query_source_table"),
        "platform_orders", "platform_orders_available", value.alias("value"),
    ).select(*CELL, "query_source_table", "platform_orders", "platform_orders_available", "value.*").where("platform_value is not null")
    platform, db = F.col("platform_value"), F.col("db_all_sources")
    status = _status(platform, db, F.size("matching") > 0, config)
    advice = F.create_map(*(F.lit(text) for pair in RECOMMENDATIONS.items() for text in pair))
    return per_cell.withColumn("status", status).select(
        *CELL, "query_source_table", "metric", "platform_value", "platform_orders",
        "platform_orders_available", "db_all_sources",
        (db - platform).alias("diff_db_minus_platform"),
        ratio(db - platform, platform, db).alias("diff_pct"),
        "status",
        F.array_join("matching.source", ", ").alias("matching_source_alone"),
        F.lit(True).alias("checked_source"),
        F.element_at(advice, F.col("status")).alias("recommendation"),
    )


def missing_order_summary(detail: DataFrame) -> DataFrame:
    return (
        detail.where(F.col("status") == "missing_in_db")
        .groupBy(*KEY)
        .agg(
            F.max("platform_orders").alias("platform_orders"),
            F.bool_or("platform_orders_available").alias("platform_orders_available"),
            F.count("*").alias("missing_rows"),
            joined(F.collect_set("metric")).alias("missing_metrics"),
            joined(F.collect_set("query_source_table")).alias("missing_query_tables"),
        )
    )
