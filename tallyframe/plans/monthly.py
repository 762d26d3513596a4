"""Monthly check and user-supplied single-month checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import one_of, split_multi
from ..functions.revenue import MONTHLY_CUTOVER
from ..operators import monthly as mo
from ..sources.scratch import job_tables
from ..sources.warehouse import Warehouse
from .bundle import Bundle, month_label, safe_name

# The kinds of single-month check and the first day the media check reads.
CHECK_TYPES = ("content", "media")
MEDIA_START = date(2024, 1, 1)


def run_monthly(
    warehouse: Warehouse,
    spark: SparkSession,
    sellers: DataFrame | Iterable[str] | str,
    month: str,
    folder: str,
    sources: str = "all",
    company: str = "",
    last_month: str | None = None,
    cutover: date = MONTHLY_CUTOVER,
    csv: bool = False,
) -> Bundle:
    """Rows and summary of one month, or of the months up to ``last_month``."""
    if isinstance(sellers, str):
        sellers = split_multi(sellers)
    chosen = mo.clean_sources(split_multi(sources))
    bundle = Bundle(spark, folder, f"monthly_check_{month_label(month)}", csv)
    with job_tables(spark):
        rows = mo.monthly_rows(warehouse, spark, sellers, month, last_month, chosen, company, cutover)
        stamp = F.current_timestamp().cast("timestamp_ntz").alias("query_date")
        at = rows.columns.index("product_impression")
        written = bundle.write("Monthly_Check", rows.select(*rows.columns[:at], stamp, *rows.columns[at:]))
        bundle.write("Summary", mo.monthly_summary(written))
    listed = "" if isinstance(sellers, DataFrame) else ", ".join(sellers)
    bundle.params(
        target_month=month, last_month=last_month or month, seller_ids=listed,
        sources=", ".join(chosen), company=company,
    )
    return bundle


def check_params(sellers: DataFrame, check_type: str, month: str, company: str = "") -> DataFrame:
    """The ``params`` relation a single-month template reads, one row per seller.

    Content checks get the half-open window of the month; media checks get a
    fixed start and the tracking month.
    """
    kind = one_of(check_type, CHECK_TYPES, "check type")
    target = F.to_date(F.lit(month))
    if kind == "content":
        window = [target.alias("start_date"), F.add_months(target, 1).alias("end_date")]
    else:
        window = [F.lit(MEDIA_START).alias("start_date"), target.alias("tracking_month")]
    return sellers.select(*window, "seller_id", F.lit(company).alias("company"))


def single_month_rows(
    template: str, params: DataFrame, tables: Mapping[str, DataFrame], args: Mapping[str, object] | None = None
) -> DataFrame:
    """Run a user's SQL. ``{params}`` and ``{table}`` name relations, ``:name`` values."""
    spark = params.sparkSession
    return spark.sql(template, args=dict(args or {}), params=params, **tables)


def run_single_month(
    template: str,
    sellers: DataFrame,
    check_type: str,
    month: str,
    tables: Mapping[str, DataFrame],
    folder: str,
    company: str = "",
    csv: bool = False,
    client: str = "",
    args: Mapping[str, object] | None = None,
) -> Bundle:
    """The rows of a user's check of one month. ``company`` defaults to the client's name.

    The report carries the seller in its name if there is one, else their number.
    """
    company = company or client
    params = check_params(sellers, check_type, month, company)
    first = [r["seller_id"] for r in sellers.select("seller_id").distinct().limit(2).collect()]
    who = safe_name(first[0] or "") if len(first) == 1 else "sellers"
    bundle = Bundle(params.sparkSession, folder, f"{check_type}_check_{who}_{month_label(month)}", csv)
    bundle.write(f"Check_{check_type.title()}", single_month_rows(template, params, tables, args))
    bundle.params(
        check_type=check_type, target_month=month, seller_id=first[0] if len(first) == 1 else f"{sellers.count()} sellers",
        company=company,
    )
    return bundle
