"""From a raw cell grid to normalised facts.

A grid has one row per sheet row: ``file, sheet, row_idx, cells`` and, for
delimited files, ``has_header`` (row 0 is the header) and, if known, ``is_header``. A file is known by its full
path. Each spec that names a file reads its sheets on its own, so a sheet is keyed by
the position of the spec as well. Everything known about a
sheet (header row, column positions, row flags) sits in one small table with a
row per sheet. That table is written to the shared scratch folder, so Spark
knows its size: it is broadcast to the grid scan while it is small and
joined by shuffle, with skewed files split, once it is not.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AUTO, DB, DEFAULT, REGION_ALIASES, MetricConfig
from ..functions.dates import is_date_range, parse_day, period_label
from ..functions.numbers import parse_number, parse_typed_number
from ..functions.text import clean, is_blank, name_key
from ..sources.paths import base_name, names_file
from ..sources.scratch import settle

SHEET = ("file", "sheet")
SHEET_OF_SPEC = ("position", *SHEET)
HEADER_SEARCH_ROWS = 80
ROLLUP_REGION = "ALL"

# Header row score per alias hit, and the penalty for having no date.
STRONG_HIT, WEAK_HIT, NO_DATE = 3, 1, -2
STRONG = ("date", "seller_id")


def _key(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def alias_map(config: MetricConfig = DEFAULT) -> Column:
    """Literal map: scope to its metrics, each with its alias keys in order."""
    entries = []
    for scope, metrics in config.aliases.items():
        rows = [
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(STRONG_HIT if metric in STRONG else WEAK_HIT).alias("weight"),
                F.array(*(F.lit(_key(name)) for name in names)).alias("keys"),
            )
            for metric, names in metrics.items()
        ]
        entries += [F.lit(scope), F.array(*rows)]
    return F.create_map(*entries)


def scope_of(marketplace: Column, config: MetricConfig = DEFAULT) -> Column:
    """Alias scope of a marketplace; unknown ones use the automatic aliases."""
    name = F.upper(F.coalesce(F.nullif(F.trim(marketplace), F.lit("")), F.lit(AUTO)))
    return F.when(name.isin(*config.aliases), name).otherwise(F.lit(AUTO))


def header_score(cells: Column, aliases: Column) -> Column:
    keys = F.filter(F.transform(cells, name_key), lambda k: k != "")
    hits = F.filter(aliases, lambda a: F.arrays_overlap(a["keys"], keys))
    score = F.aggregate(hits, F.lit(0), lambda total, a: total + a["weight"])
    no_date = F.exists(aliases, lambda a: a["metric"] == "date") & ~F.exists(
        hits, lambda a: a["metric"] == "date"
    )
    return score + F.when(no_date, NO_DATE).otherwise(0)


def with_specs(rows: DataFrame, specs: DataFrame, config: MetricConfig = DEFAULT) -> DataFrame:
    """Rows once for every spec of their file that wants their sheet. Rows of a file
    without any spec are kept with nulls, to be reported."""
    wanted = F.coalesce(F.trim("platform_sheet"), F.lit(""))
    marketplace = F.upper(F.coalesce(F.nullif(F.trim("marketplace"), F.lit("")), F.lit(AUTO)))
    named = specs.select(
        F.col("file").alias("spec_file"), base_name(F.col("file")).alias("base"), "position", "seller_id",
        "marketplace", "platform_sheet",
    )
    condition = (base_name(rows["file"]) == named["base"]) & names_file(named["spec_file"], rows["file"])
    return (
        rows.join(named, condition, "left").drop("spec_file", "base")
        .where(F.col("position").isNull() | (wanted == "") | F.col("has_header") | (wanted == F.col("sheet")))
        .withColumn("scope", scope_of(F.col("marketplace"), config))
        .withColumn("marketplace", marketplace)
        .drop("platform_sheet")
    )


def detect_headers(
    grid: DataFrame, specs: DataFrame, config: MetricConfig = DEFAULT, search_rows: int = HEADER_SEARCH_ROWS
) -> DataFrame:
    """Header row per sheet: best score among the first rows, the earliest of equals.

    Without any row that scores 0 or more, the first row is taken; as it has no date
    column then, ``quarantine`` reports the sheet.
    """
    # Headers of delimited files are a part of the grid of their own: with the mark for them, which
    # is a constant in each part, Spark leaves the files' other rows unread.
    first = F.col("is_header") if "is_header" in grid.columns else F.col("has_header") & (F.col("row_idx") == 0)
    top = grid.where(first | (~F.col("has_header") & (F.col("row_idx") < search_rows)))
    score = header_score(F.col("cells"), F.element_at(alias_map(config), F.col("scope")))
    rank = F.struct(F.greatest(score, F.lit(-1)), -F.col("row_idx"))
    found = F.struct("row_idx", "cells", "seller_id", "marketplace", "scope", "has_header")
    best = with_specs(top, specs, config).groupBy(*SHEET_OF_SPEC).agg(F.max_by(found, rank).alias("found"))
    return best.select(
        *SHEET_OF_SPEC, "found.has_header", F.col("found.row_idx").alias("header_idx"), F.col("found.cells").alias("headers"),
        "found.seller_id", "found.marketplace", "found.scope",
    )


def _position(keys: Column, wanted: Column) -> Column:
    """0-based position of the first wanted key found; of equal keys the first in
    delimited files, where later ones count as renamed, and the last in workbooks."""
    hit = F.get(F.filter(wanted, lambda k: F.array_contains(keys, k)), F.lit(0))
    last = F.size(keys) - F.array_position(F.reverse(keys), hit)
    return F.when(hit.isNotNull(), F.when(F.col("has_header"), F.array_position(keys, hit) - 1).otherwise(last))


def map_columns(headers: DataFrame, config: MetricConfig = DEFAULT) -> DataFrame:
    """Add ``positions``: metric to column position, for the metrics found."""
    keys = F.transform("headers", name_key)
    aliases = F.element_at(alias_map(config), F.col("scope"))
    region = F.struct(
        F.lit("region").alias("metric"),
        _position(keys, F.array(*(F.lit(_key(n)) for n in REGION_ALIASES))).alias("position"),
    )
    found = F.transform(
        aliases,
        lambda a: F.struct(a["metric"].alias("metric"), _position(keys, a["keys"]).alias("position")),
    )
    entries = F.filter(F.concat(found, F.array(region)), lambda e: e["position"].isNotNull())
    return headers.withColumn("positions", F.map_from_entries(entries))


def _has(metric: str) -> Column:
    return F.map_contains_key("positions", metric)


def _cell(name: str) -> Column:
    return F.get(F.col("cells"), F.element_at("positions", F.lit(name)))


def data_rows(grid: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows below the header with at least one filled cell, for every spec of their sheet."""
    filled = ~is_blank(F.concat_ws("", "cells"))
    return (
        grid.select(*SHEET, "row_idx", "cells")
        .join(sheets, list(SHEET))
        .where((F.col("row_idx") > F.col("header_idx")) & filled)
    )


def _is_rollup_region() -> Column:
    return _has("region") & (F.upper(clean(_cell("region"))) == ROLLUP_REGION)


def row_flags(grid: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per sheet: are there range rows, and rows of a real region on either side."""
    ranged, real = is_date_range(_cell("date")), ~_is_rollup_region()
    flagged = data_rows(grid, mapped.where("position is not null")).select(
        *SHEET_OF_SPEC, ranged.alias("ranged"), real.alias("real")
    )
    return flagged.groupBy(*SHEET_OF_SPEC).agg(
        F.bool_or("ranged").alias("has_range"),
        F.bool_or(~F.col("ranged")).alias("has_plain"),
        F.bool_or(F.col("ranged") & F.col("real")).alias("range_real_region"),
        F.bool_or(~F.col("ranged") & F.col("real")).alias("plain_real_region"),
    )


def sheet_table(
    grid: DataFrame, specs: DataFrame, config: MetricConfig = DEFAULT, search_rows: int = HEADER_SEARCH_ROWS
) -> DataFrame:
    """Everything known per sheet and spec, written out so that its size is known.
    Sheets without data rows are left out."""
    mapped = settle(map_columns(detect_headers(grid, specs, config, search_rows), config), "mapped-sheets")
    flagged = mapped.join(row_flags(grid, mapped), list(SHEET_OF_SPEC), "left")
    return settle(flagged.where("position is null or has_plain is not null"), "sheets")


def kept_rows(rows: DataFrame, granularity: str) -> DataFrame:
    """Drop range rows or roll-up regions where the sheet has rows that replace them.

    Month keeps only range rows if there are any, day drops them, week keeps
    all. Region ``ALL`` goes if any other region is left in the sheet.
    """
    ranged = is_date_range(_cell("date"))
    range_real, plain_real = F.col("range_real_region"), F.col("plain_real_region")
    if granularity == "month":
        keep = ~F.col("has_range") | ranged
        others = F.when(F.col("has_range"), range_real).otherwise(plain_real)
    elif granularity == "day":
        keep, others = ~ranged, plain_real
    else:
        keep, others = F.lit(True), range_real | plain_real
    return rows.where(keep & ~(_is_rollup_region() & others))


def usable(config: MetricConfig = DEFAULT) -> Column:
    """A sheet can be read if a spec wants it and it has a date column and a metric."""
    return F.col("position").isNotNull() & _has("date") & reduce(lambda a, b: a | b, [_has(m) for m in config.metrics])


def parsed_rows(
    grid: DataFrame, sheets: DataFrame, granularity: str, config: MetricConfig = DEFAULT
) -> DataFrame:
    """Typed rows of the usable sheets, including those that failed to parse."""

    def number(cell: Column) -> Column:
        # Numbers of delimited files are typed by the reader, others are text.
        return F.when(F.col("has_header"), parse_typed_number(cell)).otherwise(parse_number(cell))

    given = F.trim(F.coalesce("seller_id", F.lit("")))
    seller = F.when(given != "", given).otherwise(clean(_cell("seller_id")))
    parsed = F.struct(
        seller.alias("seller_id"),
        parse_day(_cell("date")).alias("day"),
        clean(_cell("date")).alias("date_text"),
        *(F.when(_has(m), number(_cell(m))).alias(m) for m in config.metrics),
    )
    delimited = F.col("has_header")
    absent = [F.when(F.element_at("positions", F.lit(m)) >= F.size("cells"), F.lit(m)) for m in config.metrics]
    beyond = F.concat_ws("", F.slice("cells", F.size("headers") + 1, F.greatest(F.size("cells"), F.lit(1))))
    width = F.when(delimited & F.coalesce(*absent).isNotNull(), "short_row").when(
        delimited & ~is_blank(beyond), "cells_beyond_header"
    )
    # As a generator the parsed values are computed once: filters on them are not
    # pushed below it, where they would repeat the whole parser.
    rows = kept_rows(data_rows(grid, sheets.where(usable(config))), granularity).select(
        "file", base_name(F.col("file")).alias("file_name"), "marketplace", F.col("sheet").alias("source_sheet"),
        "row_idx", "positions", width.alias("width"), F.explode(F.array(parsed)).alias("parsed"),
    )
    malformed = F.coalesce(
        *(F.when(_has(m) & F.col(f"parsed.{m}").isNull(), F.lit(m)) for m in config.metrics)
    )
    return rows.select(
        "file", "file_name", "marketplace", "source_sheet", "row_idx", "width", "parsed.*",
        malformed.alias("malformed"),
        period_label(F.col("parsed.day"), granularity).alias("period"),
    )


def normalized(parsed: DataFrame, config: MetricConfig = DEFAULT) -> DataFrame:
    """Canonical facts; a metric the sheet does not have is null."""
    return parsed.where(F.col("day").isNotNull() & F.col("malformed").isNull()).select(
        "file_name", "marketplace", "source_sheet", "seller_id", "period", *config.metrics
    )


def column_mapping(sheets: DataFrame, config: MetricConfig = DEFAULT) -> DataFrame:
    """The header text each metric was read from, one row per usable sheet."""

    def header(metric: str) -> Column:
        return clean(F.get("headers", F.element_at("positions", F.lit(metric))))

    def shown(metric: str) -> Column:
        return F.when(_has(metric), header(metric))

    return sheets.where(usable(config)).select(
        base_name(F.col("file")).alias("file_name"),
        F.coalesce(shown("seller_id"), F.col("seller_id")).alias("seller_id"),
        "marketplace", "sheet", shown("date").alias("date"),
        *(shown(m).alias(m) for m in config.metrics),
    )


def mapped_metrics(sheets: DataFrame, config: MetricConfig = DEFAULT) -> list[str]:
    """Metrics any usable sheet has: one row of flags, whatever the sheet count."""
    flags = sheets.where(usable(config)).agg(
        *(F.bool_or(_has(m)).alias(m) for m in config.metrics)
    ).first()
    return [m for m in config.metrics if flags[m]]


def quarantine(
    parsed: DataFrame,
    sheets: DataFrame,
    specs: DataFrame,
    granularity: str,
    config: MetricConfig = DEFAULT,
) -> DataFrame:
    """What was not read and why: rows, whole sheets, files without a sheet or a spec.

    Also rows with fewer cells than the header, whose missing numbers read 0, and with
    more, whose last cells are not read.
    """
    row_reason = F.when(
        F.col("malformed").isNotNull(), F.concat(F.lit("malformed_number:"), F.col("malformed"))
    ).when(F.col("day").isNull() & (F.col("date_text") != ""), F.lit("unreadable_date")).otherwise(F.col("width"))
    rows = parsed.select(
        "file", F.col("source_sheet").alias("sheet"), "row_idx",
        row_reason.alias("reason"),
    ).where("reason is not null")
    sheet_reason = (
        F.when(F.col("position").isNull(), "no_spec_for_file")
        .when(~_has("date"), "no_date_column")
        .when(~usable(config), "no_metric_column")
        .when(~F.col("has_plain") & F.lit(granularity == "day"), "only_date_ranges")
    )
    no_row = F.lit(None).cast("bigint").alias("row_idx")
    whole = sheets.select(*SHEET, no_row, sheet_reason.alias("reason")).where("reason is not null")
    unread = (
        specs.select("position", "file", F.coalesce("platform_sheet", F.lit("")).alias("sheet"))
        .join(sheets.select("position"), "position", "left_anti")
        .select(*SHEET, no_row, F.lit("no_readable_sheet").alias("reason"))
    )
    return rows.unionByName(whole).unionByName(unread)


def db_specs(specs: DataFrame) -> DataFrame:
    """Specs of database exports: same files, read with the database aliases."""
    return specs.withColumn("marketplace", F.lit(DB))
