"""Monthly check: item, SKU sales and SKU traffic per seller and month."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.dates import month_start
from ..functions.numbers import MEASURE, zero_if_null
from ..functions.revenue import MONTHLY_CUTOVER, monthly_item_revenue
from ..sources import warehouse as wh
from ..sources.warehouse import Warehouse
from .facts import Sellers, with_unusual_owner

SOURCES = ("item", "export_sku_sale", "export_sku_traffic")
KEY = ("company", "country", "marketplace", "seller_id", "year_month")
MONTHLY_COLUMNS = (
    *KEY, "source", "mapping_check", "has_finace", "component_number", "cancel_not_cancel",
    "sum_quantity", "sum_revenue", "page_view", "product_impression",
)
MEASURES = ("sum_quantity", "sum_revenue", "page_view", "product_impression")


def in_months(rows: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Half-open window from the first day of ``first`` to the end of month ``last``."""
    end = F.add_months(F.to_date(F.lit(last or first)), 1)
    return rows.where((F.col("day") >= F.to_date(F.lit(first))) & (F.col("day") < end))


def _shape(sums: DataFrame, source: str, company: str) -> DataFrame:
    """The fixed column layout; measures a source lacks are typed nulls."""

    def measure(name: str, kind: str) -> Column:
        return (F.col(name) if name in sums.columns else F.lit(None)).cast(kind).alias(name)

    return sums.select(
        F.lit(company).alias("company"),
        ids.segment(F.col("seller_id"), 1).alias("country"),
        ids.segment(F.col("seller_id"), 2).alias("marketplace"),
        "seller_id", "year_month",
        F.lit(source).alias("source"),
        *(
            F.lit(None).cast("string").alias(name)
            for name in ("mapping_check", "has_finace", "component_number", "cancel_not_cancel")
        ),
        measure("sum_quantity", MEASURE),
        measure("sum_revenue", MEASURE),
        measure("page_view", "bigint"),
        measure("product_impression", "bigint"),
    )


def item_facts(
    warehouse: Warehouse,
    sellers: Sellers,
    first: str,
    last: str | None = None,
    company: str = "",
    cutover: date = MONTHLY_CUTOVER,
) -> DataFrame:
    """Item sales of registered sellers.

    The item row carries its seller, so months are summed before the inner
    join with the registry; the join only filters (and fans out duplicates).
    """
    rows = in_months(warehouse.table(wh.ITEM), first, last)
    revenue = monthly_item_revenue(ids.segment(F.col("seller_used_id"), 2), F.col("day"), cutover)
    sums = rows.groupBy(
        F.col("seller_used_id").alias("seller_id"), month_start(F.col("day")).alias("year_month")
    ).agg(F.sum("quantity").alias("sum_quantity"), F.sum(revenue).alias("sum_revenue"))
    registered = warehouse.table(wh.SELLER).select(F.col("used_id").alias("seller_id"))
    merged = sellers.keep(sums).join(registered, "seller_id").groupBy("seller_id", "year_month").agg(
        F.sum("sum_quantity").alias("sum_quantity"), F.sum("sum_revenue").alias("sum_revenue")
    )
    return _shape(merged, "item", company)


def _by_resolved_seller(
    warehouse: Warehouse, table: str, sellers: Sellers, first: str, last: str | None, sums: list[Column]
) -> DataFrame:
    # A usual owner is the seller prefix, which is what a missing owner resolves to.
    rows = with_unusual_owner(in_months(warehouse.table(table), first, last), warehouse)
    seller = ids.resolved_seller(F.col("registered_seller"), F.col("fk_sku_used_id"))
    return sellers.keep(
        rows.groupBy(seller.alias("seller_id"), month_start(F.col("day")).alias("year_month")).agg(*sums)
    )


def sku_sale_facts(
    warehouse: Warehouse, sellers: Sellers, first: str, last: str | None = None, company: str = ""
) -> DataFrame:
    sums = [F.sum("quantity").alias("sum_quantity"), F.sum("s_onsite_selling").alias("sum_revenue")]
    rows = _by_resolved_seller(warehouse, wh.SKU_SALES, sellers, first, last, sums)
    return _shape(rows, "export_sku_sale", company)


def sku_traffic_facts(
    warehouse: Warehouse, sellers: Sellers, first: str, last: str | None = None, company: str = ""
) -> DataFrame:
    sums = [F.sum("page_view").alias("page_view")]
    rows = _by_resolved_seller(warehouse, wh.SKU_TRAFFIC, sellers, first, last, sums)
    return _shape(rows, "export_sku_traffic", company)


def without_item(sku_sales: DataFrame, items: DataFrame) -> DataFrame:
    """SKU sales only where the item table has nothing for the seller and month."""
    return sku_sales.join(items.select(*KEY), list(KEY), "left_anti")


def prefer_items(rows: DataFrame) -> DataFrame:
    """The same precedence over the union of all sources, reading each fact once.

    A (seller, month) has at most one row per source here, so the window
    partitions hold three rows. A null key never counts as covered.
    """
    covered = F.max(F.when(F.col("source") == "item", 1)).over(Window.partitionBy(*KEY)).isNotNull()
    for name in KEY:
        covered = covered & F.col(name).isNotNull()
    marked = rows.withColumn("covered", covered)
    return marked.where(~((F.col("source") == "export_sku_sale") & F.col("covered"))).drop("covered")


def clean_sources(sources: Iterable[str] | None) -> list[str]:
    """Empty or ``all`` means every source; anything outside the list is an error."""
    wanted = [s.strip() for s in sources or [] if s.strip()]
    if not wanted or "all" in {s.lower() for s in wanted}:
        return list(SOURCES)
    unknown = sorted(set(wanted) - set(SOURCES))
    if unknown:
        raise ValueError(f"unknown source {', '.join(unknown)}; choose from: {', '.join(SOURCES)}")
    return [s for s in SOURCES if s in wanted]


def monthly_rows(
    warehouse: Warehouse,
    spark: SparkSession,
    sellers: DataFrame | Iterable[str],
    first: str,
    last: str | None = None,
    sources: Iterable[str] | None = None,
    company: str = "",
    cutover: date = MONTHLY_CUTOVER,
) -> DataFrame:
    """All wanted sources of all sellers, item data taking precedence over SKU sales."""
    wanted, chosen = Sellers(spark, sellers), clean_sources(sources)
    build = {
        "item": lambda: item_facts(warehouse, wanted, first, last, company, cutover),
        "export_sku_sale": lambda: sku_sale_facts(warehouse, wanted, first, last, company),
        "export_sku_traffic": lambda: sku_traffic_facts(warehouse, wanted, first, last, company),
    }
    rows = reduce(DataFrame.unionByName, [build[source]() for source in chosen])
    return prefer_items(rows) if {"item", "export_sku_sale"} <= set(chosen) else rows


def monthly_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("company", "seller_id", "year_month", "source").agg(
        *(zero_if_null(F.sum(m)).alias(m) for m in MEASURES)
    )


def summary_cards(summary: DataFrame, cards: int = 4) -> DataFrame:
    """The first cards of the summary; each shows its first non-zero measure."""
    value = F.coalesce(
        *(F.nullif(F.col(m).cast("double"), F.lit(0.0)) for m in ("sum_revenue", "page_view", "sum_quantity")),
        F.lit(0.0),
    )
    return (
        summary.orderBy("company", "seller_id", "year_month", "source")
        .limit(cards)
        .select("seller_id", "source", "year_month", value.alias("value"))
    )
