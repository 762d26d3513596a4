"""Seller and SKU identifiers: ``COUNTRY.MARKETPLACE.NUMBER`` plus SKU segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment(c: Column, n: int) -> Column:
    return F.split_part(c, F.lit("."), F.lit(n))


def seller_prefix(c: Column) -> Column:
    """The first three segments; missing segments stay empty, as in ``'A.B.'``.

    Segments are only split apart where one of them is missing, which costs several times as much.
    """
    filled = F.concat_ws(".", *(F.coalesce(segment(c, n), F.lit("")) for n in (1, 2, 3)))
    return F.when(F.substring_index(c, ".", 2) != c, F.substring_index(c, ".", 3)).otherwise(filled)


def parent(c: Column) -> Column:
    """The id without its last segment; null when there is no dot."""
    tail = F.length(F.substring_index(c, ".", -1))
    return F.when(F.instr(c, ".") > 0, F.left(c, F.length(c) - tail - 1))


def with_ancestors(c: Column) -> Column:
    """The id and every proper dot prefix of it; null stays null.

    Up to three segments are spelled out: only longer ids need a loop over them.
    """
    short = F.array_distinct(F.array(*(F.substring_index(c, ".", n) for n in (1, 2, 3))))
    parts = F.split(c, "[.]", -1)
    long = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."),
    )
    return F.when(c.isNull(), F.lit(None)).when(F.substring_index(c, ".", 3) == c, short).otherwise(long)


def resolved_seller(registered: Column, sku_id: Column) -> Column:
    """The registered seller if the SKU is known, else the prefix of the SKU id."""
    return F.coalesce(registered, seller_prefix(sku_id))


def candidate_places(direct: Sequence[Column], sku_parent: Column) -> Column:
    """Numbers of the seller ids a fact row may be counted for: 0 and less for those of
    ``direct``, from 1 for the parent of the SKU and its ancestors, the shortest first."""
    dots = F.length(sku_parent) - F.length(F.replace(sku_parent, F.lit(".")))
    return F.sequence(F.lit(1 - len(direct)), F.coalesce(dots + 1, F.lit(0)))


def seller_candidate(place: Column, direct: Sequence[Column], sku_parent: Column) -> Column:
    """The seller id at a place; null where there is none or another place has it, so that
    a row is counted at most once for each.

    ``sku LIKE seller || '.%'`` holds exactly when the seller is a proper dot
    prefix of the SKU, i.e. the SKU's parent or one of the parent's ancestors.
    """
    found = F.when(place > 0, F.call_function("substring_index", sku_parent, F.lit("."), place))
    for n, own in enumerate(direct):
        others = [own.eqNullSafe(sku_parent), sku_parent.startswith(F.concat(own, F.lit("."))), *(own.eqNullSafe(d) for d in direct[:n])]
        known = reduce(lambda a, b: a | b, (F.coalesce(other, F.lit(False)) for other in others))
        found = found.when(place == -n, F.when(~known, own))
    return found
