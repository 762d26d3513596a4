"""Which revenue column counts, by marketplace and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: first day on which SHP revenue is read from s_net in the monthly check.
MONTHLY_CUTOVER = date(2026, 1, 22)


def daily_item_revenue(marketplace: Column) -> Column:
    """Item revenue in the daily flows."""
    fallback = F.coalesce("s_paid", "s_net", "s_onsite_selling", "s_seller_selling", F.lit(0))
    return (
        F.when(marketplace == "LAZ", F.col("s_net"))
        .when(marketplace.isin("SHP", "TTK"), F.col("s_paid"))
        .otherwise(fallback)
    )


def monthly_item_revenue(marketplace: Column, day: Column, cutover: date = MONTHLY_CUTOVER) -> Column:
    """Item revenue in the monthly check: SHP moves from paid to net at the cut-over."""
    after = day >= F.lit(cutover)
    net = (marketplace == "LAZ") | ((marketplace == "SHP") & after)
    paid = (marketplace == "TTK") | ((marketplace == "SHP") & ~after)
    return (
        F.when(day.isNull(), F.lit(0))
        .when(net, F.col("s_net"))
        .when(paid, F.col("s_paid"))
        .otherwise(F.lit(0))
    )
