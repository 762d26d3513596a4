"""Metric catalogue, header aliases and tolerances.

All of this is configuration: a few dozen short strings that become literals
in the plan. Users replace it with their own JSON through ``load_config``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from decimal import Decimal

# Canonical metric names, header aliases per marketplace and for
# database exports. Order matters, the first alias found in a header wins.
DEFAULT_CONFIG = {
    "canonical_metrics": {
        "quantity": {"tolerance_abs": 0, "tolerance_pct": 0},
        "revenue": {"tolerance_abs": 0, "tolerance_pct": 0},
        "page_view": {"tolerance_abs": 0, "tolerance_pct": 0},
        "product_impression": {"tolerance_abs": 0, "tolerance_pct": 0},
        "orders": {"tolerance_abs": 0, "tolerance_pct": 0},
    },
    "platform_aliases": {
        "SHP": {
            "date": ["Date"],
            "quantity": ["Gross Units Sold", "Units Sold"],
            "revenue": [
                "Gross Sales(Local Currency)",
                "Gross Sales (Local Currency)",
                "Gross Sales (Shopee Rebate applied)(Local Currency)",
                "Sales",
                "Gross Sales(USD)",
            ],
            "page_view": ["Product Views"],
            "orders": ["Gross Orders", "Orders"],
        },
        "TTK": {
            "date": ["Date"],
            "quantity": ["Items sold", "SKU orders"],
            "revenue": ["GMV", "Gross revenue"],
            "page_view": ["Page views"],
            "product_impression": ["Product impressions"],
            "orders": ["Orders"],
        },
        "LAZ": {
            "date": ["Date", "Day"],
            "quantity": ["Units Sold", "Items Sold", "Product Sold", "Quantity"],
            "revenue": ["Revenue", "GMV", "Sales", "Net Sales", "Revenue(Local Currency)"],
            "page_view": ["Page Views", "Product Views", "Visitors"],
            "orders": ["Orders"],
        },
        "AUTO": {
            "date": ["Date", "Day", "year_month"],
            "quantity": [
                "quantity", "total_quantity", "sum_quantity",
                "Units Sold", "Items sold", "Gross Units Sold",
            ],
            "revenue": [
                "revenue", "revenue_local", "sum_revenue", "GMV", "Gross revenue", "Sales",
            ],
            "page_view": ["page_view", "total_page_view", "Product Views", "Page views"],
            "product_impression": ["product_impression", "Product impressions"],
            "orders": ["orders", "Gross Orders", "Orders"],
        },
    },
    "db_aliases": {
        "seller_id": ["seller", "seller_id", "used_id"],
        "date": ["day", "date", "year_month"],
        "source": ["source"],
        "quantity": ["total_quantity", "sum_quantity", "quantity"],
        "revenue": ["revenue_local", "sum_revenue", "revenue", "s_onsite_selling"],
        "page_view": ["total_page_view", "page_view"],
        "product_impression": ["product_impression"],
        "orders": ["orders", "total_orders"],
    },
}

REGION_ALIASES = ("Region",)
AUTO = "AUTO"
DB = "DB"
GRANULARITIES = ("day", "week", "month")
LEVELS = ("seller", "sku", "both")


@dataclass(frozen=True)
class MetricConfig:
    """Aliases keyed by scope (a marketplace, ``AUTO`` or ``DB``) and tolerances."""

    metrics: tuple[str, ...]
    aliases: dict[str, dict[str, list[str]]]
    tolerance_abs: dict[str, Decimal] = field(default_factory=dict)
    tolerance_pct: dict[str, Decimal] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict) -> MetricConfig:
        canonical = raw["canonical_metrics"]
        return cls(
            metrics=tuple(canonical),
            aliases={**raw["platform_aliases"], DB: raw["db_aliases"]},
            tolerance_abs={m: Decimal(str(v.get("tolerance_abs", 0))) for m, v in canonical.items()},
            tolerance_pct={m: Decimal(str(v.get("tolerance_pct", 0))) for m, v in canonical.items()},
        )


DEFAULT = MetricConfig.from_dict(DEFAULT_CONFIG)


def load_config(path: str) -> MetricConfig:
    with open(path, encoding="utf-8") as handle:
        return MetricConfig.from_dict(json.load(handle))


def split_multi(value: str | None) -> list[str]:
    """``"a, b; c\\nd"`` to its parts; blanks are dropped."""
    return [part.strip() for part in re.split(r"[\n,;]+", value or "") if part.strip()]


def one_of(value: str | None, allowed, what: str, default: str | None = None) -> str:
    """Normalise a user option and reject anything outside the closed list."""
    key = (value or default or "").strip().lower()
    if key not in allowed:
        raise ValueError(f"unknown {what} {value!r}; choose one of: {', '.join(sorted(allowed))}")
    return key
