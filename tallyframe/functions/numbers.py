"""Numbers out of messy cells, coercion and the tolerance test.

Metrics are decimals throughout: their sums do not depend on how the rows are
partitioned, so equality at tolerance zero means what it says.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers have up to 18 digits before and 6 after the point; further decimals are rounded half up.
NUMBER = "decimal(24,6)"
MEASURE = "decimal(38,6)"


def parse_number(c: Column) -> Column:
    """Keep digits, dot and minus. Blank reads 0, malformed text reads null."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.\-]+", "")
    return F.regexp_replace(kept, r"^-?\.?$", "0").try_cast(NUMBER)


def parse_typed_number(c: Column) -> Column:
    """As ``parse_number``, but a number in exponent form keeps its exponent."""
    exponent = F.trim(c).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+$")
    return F.when(exponent, F.trim(c).try_cast(NUMBER)).otherwise(parse_number(c))


def coerce(c: Column) -> Column:
    """Anything that is no number counts as 0."""
    return F.coalesce(c.try_cast(NUMBER), F.lit(0).cast(NUMBER))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def ratio(part: Column, whole: Column, other: Column) -> Column:
    """``part / whole``; with a zero whole, 0 if ``other`` is 0 as well, else 1."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(
        F.when(other == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    )


def by_metric(metric: Column, values: dict[str, Decimal], kind: str) -> Column:
    """Look a per-metric constant up; a single shared value needs no lookup."""
    distinct = set(values.values())
    if len(distinct) <= 1:
        return F.lit(str(distinct.pop() if distinct else 0)).cast(kind)
    pairs = [F.lit(item) for name, value in values.items() for item in (name, str(value))]
    return F.element_at(F.create_map(*pairs), metric).cast(kind)


def within_tolerance(left: Column, right: Column, tol_abs: Column, tol_pct: Column) -> Column:
    """``|right-left|`` within the absolute or the relative tolerance of ``left``.

    Both sides are brought to one decimal type first: compared as they are, two
    very wide decimals of different scale would be rounded to whole numbers.
    """
    left, right = left.cast(MEASURE), right.cast(MEASURE)
    gap = right - left
    return (F.abs(gap) <= tol_abs.cast(MEASURE)) | (
        F.abs(ratio(gap, left, right)) <= tol_pct.cast("double")
    )
