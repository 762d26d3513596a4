"""Text clean-up, name keys and file-name guesses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seller id pattern inside a file name, marketplace inside a seller id.
SELLER_IN_FILE = r"(?i)[A-Z]{2}\.(SHP|LAZ|TTK)\.[A-Za-z0-9_-]+"
MARKETPLACE_IN_SELLER = r"\.(SHP|LAZ|TTK)\."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a costly value several times in ``body`` but compute it once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column) -> Column:
    """Null becomes ``''``; any run of whitespace, NBSP included, one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """Comparison key of a header name: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def split_values(c: Column) -> Column:
    """Split on newline, comma or semicolon; trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n,;]+"), clean)
    return F.filter(parts, lambda part: part != "")


def guess_seller(file_name: Column) -> Column:
    return F.upper(F.regexp_extract(file_name, SELLER_IN_FILE, 0))


def guess_marketplace(seller_id: Column) -> Column:
    hit = F.regexp_extract(F.coalesce(seller_id, F.lit("")), MARKETPLACE_IN_SELLER, 1)
    return F.coalesce(F.nullif(hit, F.lit("")), F.lit("AUTO"))


def safe_key(c: Column, blank: str = "seller") -> Column:
    """A name fit for a directory: odd characters to ``_``, none at the ends."""
    squeezed = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]+", "_")
    return F.coalesce(F.nullif(F.trim(squeezed, F.lit("_")), F.lit("")), F.lit(blank))


def joined(values: Column) -> Column:
    """A collected set of short labels as one sorted, comma-joined text."""
    return F.array_join(F.sort_array(values), ", ")
