"""Comparison semantics on small frames, and properties on generated ones."""

import random
from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT, MetricConfig, load_config
from tallyframe.operators import compare as cp
from tallyframe.operators import direct as dr
from tallyframe.operators import facts as fa
from tallyframe.operators import investigate as iv
from tallyframe.operators import slices as sl

SIDE = "seller_id string, period string, quantity decimal(18,2), revenue decimal(18,2)"
LEVELS = {"seller_sales": "seller", "seller_traffic": "seller", "sku_sales": "sku", "sku_traffic": "sku"}


def side(spark, rows):
    return spark.createDataFrame([(s, p, Decimal(q), None if r is None else Decimal(r)) for s, p, q, r in rows], SIDE)


def statuses(frame):
    return {(r.seller_id, r.period, r.metric): r.status for r in frame.collect()}


def test_two_sided_statuses_and_null_keys(spark):
    left = side(spark, [("a", "1", 2, 3), ("a", "1", 3, None), ("b", "1", 1, 1), (None, "1", 4, 4)])
    right = side(spark, [("a", "1", 5, 4), ("c", "1", 0, 0), (None, "1", 4, 5)])
    got = cp.compare_two_sided(left, right, ["quantity", "revenue"])
    assert statuses(got) == {
        ("a", "1", "quantity"): "match", ("a", "1", "revenue"): "mismatch",
        ("b", "1", "quantity"): "missing_in_db", ("b", "1", "revenue"): "missing_in_db",
        ("c", "1", "quantity"): "missing_in_platform", ("c", "1", "revenue"): "missing_in_platform",
        (None, "1", "quantity"): "match", (None, "1", "revenue"): "mismatch",
    }
    pct = {(r.seller_id, r.metric): r.diff_pct for r in got.collect()}
    assert pct["c", "quantity"] == 0.0 and pct["b", "quantity"] == -1.0


def test_swapping_sides_mirrors_the_result(spark):
    rng = random.Random(7)

    def some():
        return side(spark, [
            (rng.choice("abc"), str(rng.randint(1, 9)), rng.randint(0, 2), rng.randint(0, 2)) for _ in range(30)
        ])

    left, right = some(), some()
    one, other = (
        {(r.seller_id, r.period, r.metric): r for r in cp.compare_two_sided(x, y, ["quantity", "revenue"]).collect()}
        for x, y in ((left, right), (right, left))
    )
    mirror = {"missing_in_db": "missing_in_platform", "missing_in_platform": "missing_in_db"}
    assert one.keys() == other.keys()
    for key, row in one.items():
        assert mirror.get(row.status, row.status) == other[key].status
        assert row.diff_db_minus_platform == -other[key].diff_db_minus_platform


def test_tolerance_per_metric(spark):
    loose = replace(
        DEFAULT,
        tolerance_abs={**DEFAULT.tolerance_abs, "quantity": Decimal("0.5")},
        tolerance_pct={**DEFAULT.tolerance_pct, "revenue": Decimal("0.1")},
    )
    left = side(spark, [("a", "1", 10, 10)])
    right = side(spark, [("a", "1", "10.5", "9")])
    got = cp.compare_two_sided(left, right, ["quantity", "revenue"], loose)
    assert set(statuses(got).values()) == {"match"}
    assert set(statuses(cp.compare_two_sided(left, right, ["quantity", "revenue"])).values()) == {"mismatch"}


def test_duplicates(spark):
    rows = side(spark, [("a", "1", 1, 1), ("a", "1", 2, 2), ("b", "1", 1, 1), (None, "2", 1, 1), (None, "2", 1, 1)])
    assert {(r.seller_id, r.row_count) for r in cp.duplicate_keys(rows).collect()} == {("a", 2), (None, 2)}


DAY = date(2026, 5, 1)


def facts(spark, rows):
    full = []
    for seller, kind, table, source, q, r, v in rows:
        values = (None if x is None else Decimal(x) for x in (q, r, v))
        full.append((kind, LEVELS[kind], table, seller, DAY, source, *values))
    return spark.createDataFrame(full, fa.FACT_SCHEMA)


def platform(spark, rows):
    schema = "seller_id string, period string, quantity decimal(18,2), revenue decimal(18,2), page_view decimal(18,2), orders bigint"
    return spark.createDataFrame([(s, "2026-05-01", Decimal(q), Decimal(r), Decimal(v), o) for s, q, r, v, o in rows], schema)


METRICS = ["quantity", "revenue", "page_view", "orders"]


def cells(spark, platform_rows, fact_rows, level="both", metrics=METRICS, expected=None):
    by_source = iv.db_by_source(facts(spark, fact_rows), "day", level)
    rows = iv.source_rows(iv.platform_cells(platform(spark, platform_rows), metrics, level), by_source)
    return rows, iv.compare_by_source(rows, expected), by_source


def test_by_source_statuses(spark):
    rows, detail, by_source = cells(
        spark,
        [("a", 10, 5, 7, 3), ("b", 0, 0, 0, 0)],
        [
            ("a", "seller_sales", "seller_sales", "api", 10, 2, None),
            ("a", "seller_sales", "seller_sales", "crawl", 4, 4, None),
            ("a", "seller_traffic", "seller_traffic", "api", None, None, 7),
            ("a", "sku_sales", "item_sku_sales", "crawl", 10, 5, None),
            ("a", "sku_sales", "sku_sales", "api", 10, 0, None),
            ("z", "sku_sales", "sku_sales", "api", 1, 1, None),
        ],
    )
    got = {(r.seller_id, r.data_type, r.metric): r for r in detail.collect()}
    assert {k: r.status for k, r in got.items() if k[0] == "a"} == {
        ("a", "seller_sales", "quantity"): "suspicious_extra_source",
        ("a", "seller_sales", "revenue"): "mismatch",
        ("a", "seller_traffic", "page_view"): "match",
        ("a", "sku_sales", "quantity"): "suspicious_extra_source",
        ("a", "sku_sales", "revenue"): "match",
        ("a", "sku_traffic", "page_view"): "missing_in_db",
    }
    assert {r.status for k, r in got.items() if k[0] == "b"} == {"match"}
    assert not any(k[0] == "z" for k in got)
    sku = got["a", "sku_sales", "quantity"]
    assert sku.query_source_table == "item_sku_sales, sku_sales"
    assert sku.matching_source_alone == "crawl, api"
    assert (sku.platform_orders, sku.platform_orders_available, sku.checked_source) == (3, True, True)
    notes = {
        (r.metric, r.query_source_table, r.source): (r.investigation_note, r.source_accuracy)
        for r in iv.source_check_detail(rows).where("seller_id = 'a' and data_level = 'seller'").collect()
    }
    assert notes["quantity", "seller_sales", "api"] == ("MATCH_UI", 1.0)
    assert notes["quantity", "seller_sales", "crawl"] == ("UNDER_UI", 0.4)
    assert notes["revenue", "seller_sales", "crawl"][0] == "UNDER_UI"
    doubled = {(r.data_type, r.query_source_table): r.source_count for r in iv.duplicate_source(by_source).collect()}
    assert doubled == {("seller_sales", "seller_sales"): 2}
    missing = iv.missing_order_summary(detail).collect()
    assert [(r.seller_id, r.platform_orders, r.missing_rows, r.missing_metrics, r.missing_query_tables) for r in missing] == [
        ("a", 3, 1, "page_view", "sku_traffic")
    ]


def test_statuses_without_lists_equal_the_detail(spark):
    """Also where a cell has several query tables, blank ones, sources that cancel out, or none."""
    rng = random.Random(8)
    sellers = [f"s{i}" for i in range(40)]
    types = [(dt, table) for dt in ("seller_sales", "seller_traffic", "sku_sales", "sku_traffic") for table in (dt, f"item_{dt}", " ", "x")]
    fact_rows = [
        (s, dt, table, source, *(rng.choice([None, -2, 0, 0, 2, 3]) for _ in range(3)))
        for s in sellers for dt, table in rng.sample(types, rng.randrange(6)) for source in rng.sample(["api", "crawl", None], rng.randrange(1, 4))
    ]
    platform_rows = [(s, *(rng.choice([0, 2, 3]) for _ in range(3)), rng.randrange(5)) for s in sellers]
    rows, detail, _ = cells(spark, platform_rows, fact_rows)
    key = ["seller_id", "data_type", "metric", "status", "diff_db_minus_platform"]
    found = sorted(map(tuple, iv.cell_statuses(rows).select(*key).collect()))
    assert found == sorted(map(tuple, detail.select(*key).collect())) and {r[3] for r in found} >= {
        "match", "mismatch", "missing_in_db", "suspicious_extra_source"}
    summary = iv.missing_order_summary(detail)
    direct = iv.missing_orders(rows).select(*summary.columns)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, summary.collect())) and summary.count() > 5
    plan = iv.cell_statuses(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "collect_" not in iv.missing_orders(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_level_expected_tables_and_absent_orders(spark):
    specs = spark.createDataFrame(
        [("a", False, 0), ("a", True, 1), (" ", True, 2)], "seller_id string, use_item_sales boolean, position bigint"
    )
    expected = iv.expected_tables(specs, "sku")
    assert {(r.data_type, r.query_source_table) for r in expected.collect()} == {
        ("sku_sales", "item_sku_sales"), ("sku_traffic", "sku_traffic"),
    }
    _, detail, _ = cells(
        spark, [("a", 1, 1, 1, 1)], [("a", "seller_sales", "seller_sales", "api", 1, 1, None)],
        "sku", ["quantity", "page_view"], expected,
    )
    got = {(r.data_type, r.metric): r for r in detail.collect()}
    assert set(got) == {("sku_sales", "quantity"), ("sku_traffic", "page_view")}
    row = got["sku_sales", "quantity"]
    assert row.query_source_table == "item_sku_sales" and row.status == "missing_in_db"
    assert row.platform_orders is None and row.platform_orders_available is False


def test_generated_cells_are_consistent(spark):
    rng = random.Random(11)
    fact_rows = [
        (rng.choice("abcd"), kind, kind, rng.choice(["x", "y", "z"]), rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 2))
        for kind in LEVELS
        for _ in range(20)
    ]
    rows, detail, by_source = cells(spark, [(s, rng.randint(0, 6), rng.randint(0, 6), rng.randint(0, 6), 1) for s in "abcde"], fact_rows)
    detail_rows = detail.collect()
    assert len(detail_rows) == 5 * 6
    assert sum(r["count"] for r in cp.status_summary(detail).collect()) == len(detail_rows)
    sums = {(r.seller_id, r.data_type): r for r in iv.db_all_sources(by_source).collect()}
    for row in detail_rows:
        total = sums.get((row.seller_id, row.data_type))
        assert row.db_all_sources == (total[row.metric] if total else 0)
        assert row.status in cp.STATUSES
    per_source = iv.source_check_detail(rows).groupBy("seller_id", "data_type", "metric").agg(F.sum("source_value").alias("v"))
    by_key = {(r.seller_id, r.data_type, r.metric): r.db_all_sources for r in detail_rows}
    for row in per_source.collect():
        assert row.v == by_key[row.seller_id, row.data_type, row.metric]


def test_facts_without_query_table_or_metric(spark):
    rows = facts(spark, [("a", "seller_sales", "x", "api", 1, 1, None)]).drop("query_source_table", "page_view")
    got = iv.db_by_source(rows, "month").first()
    assert (got.query_source_table, got.page_view, got.period) == ("seller_sales", 0, "2026-05")


def test_filters_and_slices(spark):
    _, detail, _ = cells(spark, [("a", 1, 1, 1, 1)], [("a", "seller_sales", "seller_sales", "api", 1, 2, None)])
    assert sl.filter_comparison(detail, "quantity", "match", "seller_sales").count() == 1
    assert sl.filter_comparison(detail).count() == 6
    assert sl.slice_of(detail, "Wrong_Data_Detail").count() == 5
    options = {(r.filter, r.value) for r in sl.filter_options(detail).collect()}
    assert {("metric", "all"), ("status", "missing_in_db"), ("table", "sku_traffic")} <= options
    names = spark.createDataFrame([("TH.SHP.1:x/y",), ("",), ("a" * 40,)], "s string")
    assert [r[0] for r in names.select(sl.sheet_name(F.col("s"))).collect()] == [
        "S_TH.SHP.1_x_y", "S_blank", "S_" + "a" * 40,
    ]


def test_metric_and_flow_choices():
    assert dr.metric_columns("Sales") == ["quantity", "revenue"] and dr.metric_columns(None) == list(iv.METRICS)
    assert dr.flow_names("sku_trafic") == ["sku_traffic"]
    for check in (dr.metric_columns, dr.flow_names):
        with pytest.raises(ValueError):
            check("nope")


def test_config_file(folder):
    with open(f"{folder}/m.json", "w") as handle:
        handle.write('{"canonical_metrics": {"quantity": {"tolerance_abs": 2}}, "platform_aliases": {"AUTO": {"date": ["D"]}}, "db_aliases": {}}')
    config = load_config(f"{folder}/m.json")
    assert isinstance(config, MetricConfig) and config.tolerance_abs["quantity"] == 2 and config.aliases["DB"] == {}


def test_cells_are_joined_where_their_sums_lie(spark):
    """Cells are four times the sums they are laid out from: only the sums and the sources are shuffled."""
    from tallyframe.session import SETTINGS, apply_settings

    keys = [*SETTINGS, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        apply_settings(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        number = "decimal(38,6)"
        platform = spark.createDataFrame([("A.B.1", "2026-05-01", 1)], "seller_id string, period string, quantity int")
        sources = spark.createDataFrame(
            [("A.B.1", "2026-05-01", "sku", "sku_sales", "sku_sales", "api", 1)],
            "seller_id string, period string, data_level string, data_type string, query_source_table string, source string, quantity int",
        ).selectExpr("*", f"cast(0 as {number}) as revenue", f"cast(0 as {number}) as page_view")
        platform = platform.withColumn("quantity", F.col("quantity").cast(number))
        rows = iv.source_rows(iv.platform_cells(platform, ["quantity"]), sources)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert sorted((r.data_type, r.seen) for r in rows.collect()) == [
            ("seller_sales", None), ("seller_traffic", None), ("sku_sales", True), ("sku_traffic", None)]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_laid_cells_meet_laid_sources_without_a_shuffle(spark):
    """Cells and sources that both come by seller are joined and compared as they lie; the rows are the same."""
    from tallyframe.session import SETTINGS, apply_settings

    keys = [*SETTINGS, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        apply_settings(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        shown = platform(spark, [("a", 10, 5, 7, 3), ("b", 0, 0, 0, 0), (None, 1, 1, 1, 1), ("b", 1, 2, 3, 1)])
        found = facts(spark, [("a", "seller_sales", "seller_sales", "api", 10, 2, None), ("b", "sku_sales", "x", None, 1, 2, None),
                              ("b", "sku_sales", "y", "api", 1, 0, None), (None, "sku_sales", "x", "api", 1, 1, None)])
        plain = iv.source_rows(iv.platform_cells(shown, METRICS), iv.db_by_source(found, "day", summed=True))
        sources = iv.db_by_source(found.repartition(3, "seller_id"), "day", summed=True)
        rows = iv.source_rows(iv.platform_cells(shown, METRICS, laid=3), sources)
        for made in (iv.cell_statuses, iv.compare_by_source, iv.source_check_detail, iv.missing_orders):
            plan = made(rows)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2, made
            assert sorted(map(str, made(rows).collect())) == sorted(map(str, made(plain).collect()))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_report_tables_start_from_the_flows(spark, folder):
    """Sums by source of several flows are those of all facts, by day and by month, and a day's are not summed again."""
    from tallyframe.plans.batch import write_source_report
    from tallyframe.plans.bundle import Bundle

    flows = [facts(spark, [("a", "seller_sales", "seller_sales", "api", 10, 2, None), ("a", "seller_sales", "seller_sales", "x", 0, 3, None)]),
             facts(spark, [("a", "sku_sales", "sku_sales", "api", 1, None, None), ("b", "sku_sales", "sku_sales", "x", 0, 1, None)])]
    flows[0] = flows[0].unionByName(flows[0].withColumn("day", F.date_add("day", 1)))
    for granularity in ("day", "month"):
        shown = platform(spark, [("a", 10, 5, 7, 3), ("b", 0, 1, 0, 0)]).withColumn("period", F.substring("period", 1, 7 if granularity == "month" else 10))
        bundle = Bundle(spark, folder, "test")
        write_source_report(bundle, shown, flows, METRICS, granularity)
        by_source = iv.db_by_source(flows[0].unionByName(flows[1]), granularity)
        wanted = iv.compare_by_source(iv.source_rows(iv.platform_cells(shown, METRICS), by_source))
        assert sorted(map(str, bundle.table("Comparison").select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
        assert bundle.table("Duplicate_Source").count() == iv.duplicate_source(by_source).count() > 0
        assert bundle.table("Raw_DB_By_Source").count() == 6
