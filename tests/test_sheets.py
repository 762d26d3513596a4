from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.operators import sheets as sh
from tallyframe.plans.ingest import ingest
from tallyframe.sources.files import FileSpec, spec_table

GRID = "file string, sheet string, row_idx bigint, cells array<string>, has_header boolean"


def grid_of(spark, rows, file="f.xlsx", sheet="S"):
    return spark.createDataFrame([(file, sheet, i, cells, False) for i, cells in rows], GRID)


def read(spark, rows, marketplace="AUTO", granularity="day", seller="TH.SHP.1"):
    specs = spec_table(spark, [FileSpec("f.xlsx", seller, marketplace)])
    return ingest(grid_of(spark, rows), specs, granularity)


def header_of(spark, rows, marketplace="AUTO"):
    specs = spec_table(spark, [FileSpec("f.xlsx", "x", marketplace)])
    return sh.detect_headers(grid_of(spark, rows), specs).first()


def test_best_header_row_wins_and_ties_go_to_the_earliest(spark):
    rows = [
        (0, ["Report", "Date", None]), (3, ["Date", "Units Sold", "Sales"]),
        (4, ["DATE", " units  sold", "GMV"]), (5, ["2026-05-01", "1", "2"]),
    ]
    assert header_of(spark, rows).header_idx == 3


def test_no_header_falls_back_to_the_first_row(spark):
    assert header_of(spark, [(0, ["a", "b"]), (1, ["Orders", "c"])]).header_idx == 0


def test_rows_beyond_the_search_depth_are_ignored(spark):
    rows = [(0, ["x", "y"]), (79, ["Date", "GMV"]), (80, ["Date", "GMV", ])]
    assert header_of(spark, rows).header_idx == 79
    assert header_of(spark, [(0, ["x"]), (80, ["Date", "GMV"])]).header_idx == 0


def test_alias_order_and_last_of_equal_columns(spark):
    rows = [(0, ["Date", "Units Sold", "Gross Units Sold", "date"]), (1, ["bad", "1", "2", "2026-05-01"])]
    got = read(spark, rows, "SHP").facts.first()
    assert (got.quantity, got.period) == (2, "2026-05-01")


def test_unknown_marketplace_uses_automatic_aliases_but_keeps_its_name(spark):
    rows = [(0, ["year_month", "sum_quantity"]), (1, ["2026-05", "7"])]
    got = read(spark, rows, "amz").facts.first()
    assert (got.marketplace, got.quantity, got.period) == ("AMZ", 7, "2026-05-01")


RANGED = [
    (0, ["Date", "Region", "Orders"]), (1, ["01/05/2026 - 31/05/2026", "All", "30"]),
    (2, ["01/05/2026 - 31/05/2026", "Metro", "20"]), (3, ["01/05/2026", "ALL", "5"]), (4, ["02/05/2026", "Metro", "3"]),
]


def orders(spark, rows, granularity):
    return sorted((r.period, int(r.orders)) for r in read(spark, rows, "SHP", granularity).facts.collect())


def test_range_rows_and_region_rollups(spark):
    assert orders(spark, RANGED, "day") == [("2026-05-02", 3)]
    assert orders(spark, RANGED, "month") == [("2026-05", 20)]
    assert orders(spark, RANGED, "week") == [("2026-04-28/2026-05-04", 3), ("2026-04-28/2026-05-04", 20)]


def test_only_rollup_rows_are_kept_when_nothing_replaces_them(spark):
    rows = [RANGED[0], RANGED[1], RANGED[3]]
    assert orders(spark, rows, "day") == [("2026-05-01", 5)]
    assert orders(spark, rows, "month") == [("2026-05", 30)]
    assert orders(spark, [RANGED[0], RANGED[3]], "month") == [("2026-05", 5)]


def reasons(frame):
    return sorted((r.row_idx, r.reason) for r in frame.quarantine.collect())


def test_quarantine(spark):
    rows = [
        (0, ["Date", "Orders", "GMV"]), (1, ["2026-05-01", "1", "1.2.3"]), (2, ["soon", "2", "3"]),
        (3, ["", "", "9"]), (4, ["2026-05-02", "", "n/a"]), (5, [None, None, None]),
    ]
    got = read(spark, rows, "TTK")
    assert reasons(got) == [(1, "malformed_number:revenue"), (2, "unreadable_date")]
    assert [(r.period, r.orders, r.revenue) for r in got.facts.collect()] == [("2026-05-02", 0, 0)]


def test_sheet_without_metric_or_with_ranges_only(spark):
    assert reasons(read(spark, [(0, ["Date", "x"]), (1, ["2026-05-01", "1"])])) == [(None, "no_metric_column")]
    ranged = [RANGED[0], RANGED[2]]
    assert reasons(read(spark, ranged, "SHP")) == [(None, "only_date_ranges")]


def test_seller_column_unless_given(spark):
    rows = [(0, ["Seller", "day", "orders"]), (1, [" TH.SHP.9 ", "2026-05-01", "1"])]
    grid = grid_of(spark, rows)
    for given, expected in (("", "TH.SHP.9"), (" ID.LAZ.1 ", "ID.LAZ.1")):
        specs = sh.db_specs(spec_table(spark, [FileSpec("f.xlsx", given)]))
        assert ingest(grid, specs).facts.first().seller_id == expected


def test_missing_metric_is_null_and_not_zero(spark):
    got = read(spark, [(0, ["Date", "GMV"]), (1, ["2026-05-01", "1.25"])], "TTK")
    row = got.facts.first()
    assert row.quantity is None and row.revenue == Decimal("1.25")
    assert got.metrics() == ["revenue"]


def test_filters_on_parsed_rows_do_not_repeat_the_parser(spark):
    frame = read(spark, [(0, ["Date", "GMV"]), (1, ["2026-05-01", "1"])], "TTK")
    plan = frame.facts.where(F.col("period") > "2026")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyy-MMM-d") == 1
