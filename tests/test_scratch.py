"""Scratch tables: where they go, and that jobs leave none behind."""

import os
from types import SimpleNamespace

import pytest

from tallyframe.operators import facts as fa
from tallyframe.plans.batch import run_batch
from tallyframe.plans.direct import run_direct
from tallyframe.plans.monthly import run_monthly
from tallyframe.sources import scratch
from tallyframe.sources.files import FileSpec, read_files, spec_table
from tallyframe.sources.warehouse import JDBC_FETCH_ROWS, jdbc_predicates, jdbc_table

from test_jobs import EXPORT, SELLER, warehouse, write  # noqa: F401


def session(master="local[2]", conf=None, context=None):
    return SimpleNamespace(
        sparkContext=SimpleNamespace(master=master, applicationId="app-x", getCheckpointDir=lambda: context),
        conf=SimpleNamespace(get=lambda name, default: conf),
    )


def test_root_is_taken_from_argument_session_or_context():
    assert scratch.scratch_root(session(conf="/shared/"), "/mine/") == "/mine"
    assert scratch.scratch_root(session(conf="/shared/", context="/other")) == "/shared"
    assert scratch.scratch_root(session(context="hdfs://x/y")) == "hdfs://x/y"


def test_root_of_a_session_without_any():
    own = scratch.scratch_root(session())
    assert os.path.isdir(own) and scratch.scratch_root(session("local")) == own
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.scratch_root(session(master))


def scratch_tables(spark):
    root = f"{scratch.scratch_root(spark)}/tallyframe".removeprefix("file:").replace("//", "/")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_jobs_leave_no_scratch_tables(spark, warehouse, folder):  # noqa: F811
    fa.unusual_owners(warehouse)
    before = scratch_tables(spark)
    sellers = spark.createDataFrame([(SELLER,)], "seller_id string")
    bundle = run_direct(warehouse, spark, sellers, "2026-05-01", "2026-05-31", folder)
    run_monthly(warehouse, spark, sellers, "2026-05-01", folder)
    assert scratch_tables(spark) == before
    assert bundle.table("By_Day_Preview").count() > 0
    assert {r.counter: r.value for r in bundle.table("Counters").collect()} == {"row_count": bundle.table("Raw_By_Source").count()}


def test_a_flow_that_fails_while_reading_is_an_error_row(spark, warehouse, folder):  # noqa: F811
    bad = warehouse.table("ecommerce_export_sku_traffic").selectExpr(
        "fk_sku_used_id", "day", "source", "cast(raise_error('no such block') as bigint) as page_view"
    )
    frames = {name: warehouse.table(name) for name in (
        "ecommerce_export_seller_sales", "ecommerce_export_seller_traffic", "ecommerce_export_sku_sales", "ecommerce_item",
        "ecommerce_sku", "ecommerce_seller")} | {"ecommerce_export_sku_traffic": bad}
    bundle = run_direct(type(warehouse).from_frames(frames), spark, [SELLER], "2026-05-01", "2026-05-31", folder)
    audit = {r.query_source_table: r for r in bundle.table("DB_Query_Debug").collect()}
    assert audit["sku_traffic"].status == "error" and audit["sku_traffic"].error
    assert audit["sku_sales"].status == "ok" and audit["sku_sales"].row_count == 3


def plan_shape(df):
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.strip(" :+-").split(" ")[0].split("(")[0] for line in tree.splitlines()]


def test_one_plan_for_any_number_of_sellers(spark, warehouse):  # noqa: F811
    def plan(sellers):
        return plan_shape(fa.flow_sums(warehouse, "sku_sales", fa.Sellers(spark, sellers), "2026-05-01", "2026-05-31"))

    few, many = plan([f"S{i}" for i in range(3)]), plan([f"S{i}" for i in range(300)])
    table = plan(spark.createDataFrame([(f"S{i}",) for i in range(3)], "seller_id string"))
    assert few == many == table
    # The sellers cut the rows below the aggregation, that is before the shuffle.
    assert few.index("Aggregate") < few.index("Join")


def test_jdbc_dimensions_are_read_in_many_tasks():
    parts = jdbc_table({"fetchsize": str(JDBC_FETCH_ROWS)}, "ecommerce_sku", "2026-01-01", "2026-02-01", 4)
    assert "partitionColumn" not in parts and parts["dbtable"] == "public.ecommerce_sku"
    conditions = jdbc_predicates("ecommerce_sku", 4)
    assert len(set(conditions)) == 4 and all("used_id" in c and c.endswith(f"= {i}") for i, c in enumerate(conditions))


def counted(spark, frame, seen):
    def count(row):
        seen.add(1)
        return row

    return spark.createDataFrame(frame.rdd.map(count), frame.schema)


@pytest.mark.parametrize("job", ["direct", "batch"])
def test_jobs_read_every_fact_row_once(spark, warehouse, folder, job):  # noqa: F811
    facts = ("ecommerce_export_seller_sales", "ecommerce_export_seller_traffic", "ecommerce_export_sku_sales",
             "ecommerce_export_sku_traffic")
    seen = {name: spark.sparkContext.accumulator(0) for name in facts}
    frames = {name: counted(spark, warehouse.table(name), seen[name]) for name in facts}
    frames |= {name: warehouse.table(name) for name in ("ecommerce_item", "ecommerce_sku", "ecommerce_seller")}
    own = type(warehouse).from_frames(frames)
    if job == "direct":
        run_direct(own, spark, [SELLER], "2026-05-01", "2026-05-31", folder, csv=True)
    else:
        write(folder, "a.csv", EXPORT)
        grid, _ = read_files(spark, [folder])
        run_batch(own, grid, spec_table(spark, [FileSpec("a.csv", SELLER, "SHP")]), "2026-05-01", "2026-05-31", f"{folder}/out")
    assert {name: n.value for name, n in seen.items()} == {name: warehouse.table(name).count() for name in facts}
