"""Dates out of messy cells, and the period labels built from them.

Three plain numbers, by far the most common, are split and cast. Any other text is
told apart by its shape (numbers with more around them, a month's name, few
numbers) and goes through the anchored rewrites of that shape only: each turns one kind of
date into year, month and day in the preferred order and leaves other text alone. A
failed ``try_cast`` is just a null, so nothing throws.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, let

# Digits are matched possessively: a date is never cut short to make room for a second one.
DATE_LIKE = r"\d{1,4}+[./-]\d{1,2}+[./-]\d{1,4}+"
DATE_RANGE = rf"{DATE_LIKE}.*?{DATE_LIKE}"

_CLOCK = (
    r"(?:[T ]+(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d+)?)?"
    r"(?: ?[AaPp][Mm])?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?(?: -)?"
)
_MONTH = (
    r"((?i:jan(?=u|\b)|feb(?=r|\b)|mar(?=c|\b)|apr(?=i|\b)|may\b|jun(?=e|\b)|jul(?=y|\b)"
    r"|aug(?=u|\b)|sep(?=t|\b)|oct(?=o|\b)|nov(?=e|\b)|dec(?=e|\b)))[A-Za-z]*\.?"
)
# Shape and its rewrite, in order. With slashes month and day may be swapped if
# the preferred order is no date; with dashes the order is certain. Two-digit
# years up to 75 are 20xx, later ones 19xx.
_FIRST_OF_RANGE = (rf"^.*?({DATE_LIKE}).*?{DATE_LIKE}.*$", "$1")
_THREE_NUMBERS = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3/$2/$1"),
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_CLOCK}$", "$1/$2/$3"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_CLOCK}$", "$3/$1/$2"),
    (r"^([0-6]\d|7[0-5])/(\d{1,2}/\d{1,2})$", "20$1/$2"),
    (r"^(\d\d)/(\d{1,2}/\d{1,2})$", "19$1/$2"),
)
_MONTH_NAME = (
    (rf"^(\d{{1,2}})[ -]{_MONTH}[ ,-]+(\d{{4}}){_CLOCK}$", "$3-$2-$1"),
    (rf"^{_MONTH} (\d{{1,2}}),? (\d{{4}}){_CLOCK}$", "$3-$1-$2"),
    (rf"^{_MONTH}[ -](\d{{4}})$", "$2-$1-1"),
)
_FEW_NUMBERS = (
    (r"^(\d{4})(\d{2})(\d{2})$", "$1/$2/$3"),
    (r"^(\d{4})[-/.](\d{1,2})$", "$1-$2-1"),
    (r"^(\d{1,2})[-/.](\d{4})$", "$2-$1-1"),
    (r"^(\d{4})$", "$1-1-1"),
)
_ORDERED = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"
_PLAIN = r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"


def is_date_range(c: Column) -> Column:
    """True when a cell holds two or more dates, such as ``01/05/2026 - 07/05/2026``."""
    return clean(c).rlike(DATE_RANGE)


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day).try_cast("date")


def _plain_date(text: Column) -> Column:
    """Three numbers with a four-digit year: no rewriting, just their order."""

    def ordered(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        year_first, day_first = F.length(a) == 4, F.contains(text, F.lit("/"))
        year, last = F.when(year_first, a).otherwise(c), F.when(year_first, c).otherwise(a)
        # b and the other number: with the year first, or in d/m/yyyy, b is the month.
        return F.when(
            year_first | day_first, F.coalesce(_iso(year, b, last), _iso(year, last, b))
        ).otherwise(F.coalesce(_iso(year, last, b), _iso(year, b, last)))

    return let(F.split(text, "[-/.]"), ordered)


def _rewritten(text: Column) -> Column:
    def through(rules: tuple[tuple[str, str], ...]) -> Column:
        return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)

    return (
        F.when(text.rlike(r"^\d+[-/.]\d+[-/.]\d"), through(_THREE_NUMBERS))
        .when(text.rlike("[A-Za-z]{3}"), through(_MONTH_NAME))
        .otherwise(through(_FEW_NUMBERS))
    )


def _other_date(text: Column) -> Column:
    """Every other shape, through the rewrites it can match."""

    def read(ordered: Column) -> Column:
        def part(n: int) -> Column:
            return F.split_part(F.translate(ordered, "/", "-"), F.lit("-"), F.lit(n))

        swapped = F.when(F.contains(ordered, F.lit("/")), _iso(part(1), part(3), part(2)))
        named = F.try_to_date(F.initcap(ordered), "yyyy-MMM-d")
        return F.when(
            ordered.rlike(_ORDERED), F.coalesce(_iso(part(1), part(2), part(3)), swapped)
        ).otherwise(F.when(ordered.rlike("-[A-Za-z]{3}-"), named))

    first = F.when(text.rlike(DATE_RANGE), F.regexp_replace(text, *_FIRST_OF_RANGE)).otherwise(text)
    return let(let(first, _rewritten), read)


def parse_day(c: Column) -> Column:
    """The calendar day in a text cell, or null.

    A bare ``d/d/yyyy`` reads day first, then month first; every other shape
    reads month first, then day first. A range reads as its first date.
    """
    return let(clean(c), lambda t: F.when(t.rlike(_PLAIN), _plain_date(t)).otherwise(_other_date(t)))


def period_label(day: Column, granularity: str) -> Column:
    """``yyyy-MM-dd``, ``yyyy-MM``, or a Tuesday-to-Monday week ``start/end``."""
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    if granularity == "week":
        monday = F.next_day(F.date_sub(day, 1), "MON")
        return F.concat_ws(
            "/",
            F.when(day.isNotNull(), F.date_format(F.date_sub(monday, 6), "yyyy-MM-dd")),
            F.date_format(monday, "yyyy-MM-dd"),
        )
    if granularity == "day":
        return F.date_format(day, "yyyy-MM-dd")
    raise ValueError(f"unknown granularity {granularity!r}; choose day, week or month")


def period_start(day: Column, granularity: str) -> Column:
    """The first day of the period, which has the same label as all of its days."""
    if granularity == "month":
        return F.trunc(day, "MM")
    if granularity == "week":
        return F.date_sub(F.next_day(F.date_sub(day, 1), "MON"), 6)
    if granularity == "day":
        return day
    raise ValueError(f"unknown granularity {granularity!r}; choose day, week or month")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_tag(text: Column) -> Column:
    """``yyyyMM`` for report names; text that is no date is only made safe."""
    safe = F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_")
    return F.coalesce(F.date_format(parse_day(text), "yyyyMM"), safe)


def last_days(end: Column, days: int) -> tuple[Column, Column]:
    """The closed range of the last ``days`` days up to ``end``."""
    return F.date_sub(end, days - 1), end
