"""Daily and monthly facts against per-seller brute force on small tables."""

import itertools
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import audit as au
from tallyframe.operators import direct as dr
from tallyframe.operators import facts as fa
from tallyframe.operators import investigate as iv
from tallyframe.operators import monthly as mo
from tallyframe.sources.scratch import job_tables
from tallyframe.sources.warehouse import Warehouse, jdbc_options, jdbc_table

SKUS = [
    "TH.SHP.1.a", "TH.SHP.1.b.red", "TH.SHP.1", "TH.SHP", "TH", None, "TH.LAZ.2.c", "TH.LAZ.2.d.x.y",
    "ID.TTK.3.e", "ID.TTK.3.f", "ID.TTK.33.g", "PH.LAZ.4.h", "NN.XXX.5.i",
]
# d.x.y is registered elsewhere, e twice, f under a seller that does not exist, h once as expected.
REGISTRY = [
    ("TH.LAZ.2.d.x.y", 1), ("ID.TTK.3.e", 3), ("ID.TTK.3.e", 1), ("ID.TTK.3.f", 99), ("PH.LAZ.4.h", 4),
    ("TH.SHP.1.a", 1), (None, 2),
]
SELLER_IDS = [(1, "TH.SHP.1"), (2, "TH.LAZ.2"), (3, "ID.TTK.3"), (4, "PH.LAZ.4"), (5, None)]
WANTED = ["TH.SHP.1", "TH.LAZ.2", "ID.TTK.3", "PH.LAZ.4", "TH", "TH.SHP", "TH.LAZ.2.d", "NN.XXX.5", "ZZ.SHP.9"]
DAYS = [date(2026, 1, 20), date(2026, 1, 22), date(2026, 2, 1)]
OWN = [None, "TH.SHP.1", "PH.LAZ.4", "unknown"]


def item_rows():
    rows = []
    for i, (sku, own, day) in enumerate(itertools.product(SKUS, OWN, DAYS)):
        net = None if i % 7 == 0 else Decimal(i)
        paid = None if i % 5 == 0 else Decimal(i * 2)
        rows.append((sku, own, day, None if i % 3 == 0 else f"s{i % 2}", Decimal(i), paid, net, Decimal(1), Decimal(2)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame(
        item_rows(),
        "fk_sku_used_id string, seller_used_id string, day date, source string, quantity decimal(18,0), "
        "s_paid decimal(18,2), s_net decimal(18,2), s_onsite_selling decimal(18,2), s_seller_selling decimal(18,2)",
    )
    return {
        "ecommerce_item": items,
        "ecommerce_export_sku_sales": items.drop("seller_used_id", "s_paid", "s_net", "s_seller_selling"),
        "ecommerce_export_sku_traffic": items.select(
            "fk_sku_used_id", "day", "source", F.col("quantity").cast("bigint").alias("page_view")
        ),
        "ecommerce_export_seller_sales": items.select(
            F.coalesce("seller_used_id", F.lit("TH")).alias("seller_id"), "day", "source", "quantity",
            F.col("s_paid").alias("revenue"),
        ),
        "ecommerce_export_seller_traffic": items.select(
            F.concat("fk_sku_used_id", F.lit(".z")).alias("fk_seller_used_id"), "day", "source",
            F.lit(1).alias("page_view"),
        ),
        "ecommerce_sku": spark.createDataFrame(REGISTRY, "used_id string, fk_seller_id bigint"),
        "ecommerce_seller": spark.createDataFrame(SELLER_IDS, "id bigint, used_id string"),
    }


@pytest.fixture(scope="module")
def warehouse(tables):
    return Warehouse.from_frames(tables)


def prefix(sku):
    return ".".join(((sku or "").split(".") + ["", "", ""])[:3])


def owners(sku):
    """Registered sellers by left joins: one entry per matching registry row."""
    sellers = dict(SELLER_IDS)
    found = [sellers.get(seller_id) for used_id, seller_id in REGISTRY if used_id == sku and sku is not None]
    return found or [None]


def segment(seller, n):
    return (seller.split(".") + ["", ""])[n] if seller is not None else None


def brute_items(start, end):
    sums = {}
    for sku, own, day, source, quantity, paid, net, onsite, other in item_rows():
        if not start <= day <= end:
            continue
        for registered in owners(sku):
            marketplace = segment(own if own is not None else registered, 1)
            if marketplace == "LAZ":
                revenue = net
            elif marketplace in ("SHP", "TTK"):
                revenue = paid
            else:
                revenue = next(v for v in (paid, net, onsite, other, 0) if v is not None)
            for seller in WANTED:
                if own == seller or registered == seller or prefix(sku) == seller or (sku or "").startswith(seller + "."):
                    key = seller, day, source or "NULL_SOURCE"
                    q, r = sums.get(key, (0, None))
                    sums[key] = q + quantity, r if revenue is None else (r or 0) + revenue
    return sums


def as_dict(frame):
    return {(r.seller_id, r.day, r.source): (r.quantity, r.revenue) for r in frame.collect()}


@pytest.mark.parametrize("as_list", [True, False])
def test_item_flow_equals_the_or_per_seller(spark, warehouse, as_list):
    wanted = WANTED if as_list else spark.createDataFrame([(s,) for s in WANTED], "seller_id string")
    got = fa.flow_sums(warehouse, "item_sku_sales", fa.Sellers(spark, wanted), "2026-01-20", "2026-01-31")
    assert as_dict(got) == brute_items(date(2026, 1, 20), date(2026, 1, 31))


def test_sku_flow_equals_the_or_per_seller(spark, warehouse):
    expected = {}
    for sku, _, day, source, quantity, *_ in item_rows():
        for registered in owners(sku):
            for seller in WANTED:
                if registered == seller or prefix(sku) == seller or (sku or "").startswith(seller + "."):
                    key = seller, day, source or "NULL_SOURCE"
                    expected[key] = expected.get(key, 0) + quantity
    got = fa.flow_sums(warehouse, "sku_sales", fa.Sellers(spark, WANTED), "2026-01-01", "2026-12-31")
    assert {k: v[0] for k, v in as_dict(got).items()} == expected


def test_only_unusual_skus_are_joined(warehouse):
    rows = sorted(r.fk_sku_used_id for r in fa.unusual_owners(warehouse).collect())
    assert rows == ["ID.TTK.3.e", "ID.TTK.3.e", "TH.LAZ.2.d.x.y"]


def test_resolved_seller_equals_full_join_form(spark, tables, warehouse):
    """Left joins and the full-join form of the monthly SQL agree: its day filter drops the extra rows."""
    sales, sku, seller = (
        tables[n] for n in ("ecommerce_export_sku_sales", "ecommerce_sku", "ecommerce_seller")
    )
    for name, frame in (("s", sales), ("k", sku), ("e", seller)):
        frame.createOrReplaceTempView(name)
    full = spark.sql("""
        select coalesce(e.used_id, concat_ws('.', coalesce(split_part(fk_sku_used_id, '.', 1), ''),
          coalesce(split_part(fk_sku_used_id, '.', 2), ''), coalesce(split_part(fk_sku_used_id, '.', 3), ''))) as seller_id,
          trunc(day, 'MM') as year_month, sum(quantity) as q
        from s full join k on s.fk_sku_used_id = k.used_id full join e on k.fk_seller_id = e.id
        where day >= date '2026-01-01' and day < date '2026-03-01' group by 1, 2""")
    expected = {(r.seller_id, r.year_month): r.q for r in full.collect() if r.seller_id in WANTED}
    got = mo.sku_sale_facts(warehouse, fa.Sellers(spark, WANTED), "2026-01-01", "2026-02-01")
    assert {(r.seller_id, r.year_month): r.sum_quantity for r in got.collect()} == expected


def test_monthly_item_revenue_and_precedence(spark, warehouse):
    rows = mo.monthly_rows(warehouse, spark, WANTED, "2026-01-01", company="c")
    got = {(r.seller_id, r.source): r for r in rows.collect()}
    expected = {"TH.SHP.1": 0, "PH.LAZ.4": 0}
    for _, own, day, _, _, paid, net, *_ in item_rows():
        if own in expected and day < date(2026, 2, 1):
            value = net if own == "PH.LAZ.4" or day >= date(2026, 1, 22) else paid
            expected[own] += value or 0
    assert {s: r.sum_revenue for (s, source), r in got.items() if source == "item"} == expected
    sku_sellers = {s for s, source in got if source == "export_sku_sale"}
    assert not sku_sellers & set(expected) and "TH.LAZ.2" in sku_sellers
    items, sales = (
        build(warehouse, fa.Sellers(spark, WANTED), "2026-01-01", company="c")
        for build in (mo.item_facts, mo.sku_sale_facts)
    )
    assert {r.seller_id for r in mo.without_item(sales, items).collect()} == sku_sellers


def test_monthly_source_choice(spark, warehouse):
    only = mo.monthly_rows(warehouse, spark, WANTED, "2026-01-01", sources=["export_sku_sale"])
    assert "TH.SHP.1" in {r.seller_id for r in only.collect()}
    assert mo.clean_sources(["ALL"]) == mo.clean_sources([]) == list(mo.SOURCES)
    with pytest.raises(ValueError):
        mo.clean_sources(["item", "nope"])


def test_direct_flows(spark, warehouse):
    sales = fa.flow_sums(warehouse, "seller_sales", fa.Sellers(spark, ["TH", "PH.LAZ.4"]), "2026-01-20", "2026-01-20")
    assert {r.seller_id for r in sales.collect()} == {"TH", "PH.LAZ.4"}
    assert {r.day for r in sales.collect()} == {date(2026, 1, 20)}
    traffic = fa.flow_sums(warehouse, "seller_traffic", fa.Sellers(spark, ["TH.SHP.1", "TH.SHP.z"]), "2026-01-01", "2026-12-31")
    totals = {r.seller_id: r.n for r in traffic.groupBy("seller_id").agg(F.sum("page_view").alias("n")).collect()}
    assert totals == {"TH.SHP.1": 3 * len(OWN) * len(DAYS), "TH.SHP.z": len(OWN) * len(DAYS)}


def test_switch_and_missing_table(spark, tables):
    broken = {k: v for k, v in tables.items() if k != "ecommerce_export_sku_traffic"}
    jobs = spark.createDataFrame(
        [("TH.SHP.1", False), ("TH.SHP.1", True), ("PH.LAZ.4", True), (" ", False)],
        "seller_id string, use_item_sales boolean",
    )
    errors = {}
    facts = fa.facts_by_switch(Warehouse.from_frames(broken), jobs, "2026-01-01", "2026-12-31", "both", errors)
    seen = {(r.seller_id, r.query_source_table) for r in facts.select("seller_id", "query_source_table").collect()}
    assert ("TH.SHP.1", "sku_sales") in seen and ("TH.SHP.1", "item_sku_sales") in seen
    assert ("PH.LAZ.4", "item_sku_sales") in seen and ("PH.LAZ.4", "sku_sales") not in seen
    traffic = facts.where("query_source_table = 'seller_traffic' and seller_id = 'TH.SHP.1'")
    assert traffic.agg(F.sum("page_view")).first()[0] == 3 * len(OWN) * len(DAYS)
    assert set(errors) == {"sku_traffic"}
    expected = au.expected_queries(jobs.where("seller_id <> ' '"), list(fa.FLOWS), errors)
    audit = au.audit(expected, facts, "a", "b")
    rows = {(r.seller_id, r.use_item_sales, r.query_source_table): r for r in audit.collect()}
    assert rows["PH.LAZ.4", True, "sku_traffic"].status == "error"
    assert len(rows) == 3 * 4 and tuple(audit.columns) == au.AUDIT_COLUMNS
    sample = rows["TH.SHP.1", False, "sku_sales"]
    assert (sample.source_sample, sample.first_day, sample.status) == ("NULL_SOURCE, s0, s1", "2026-01-20", "ok")


@pytest.mark.parametrize("grain", ["day", "week", "month"])
def test_flows_summed_by_period_need_no_second_sum(spark, warehouse, grain):
    days = fa.facts(warehouse, spark, WANTED, "2026-01-01", "2026-12-31")
    periods = fa.facts(warehouse, spark, WANTED, "2026-01-01", "2026-12-31", grain=grain)
    summed, plain = iv.db_by_source(periods, grain, summed=True), iv.db_by_source(days, grain)
    assert sorted(map(str, summed.collect())) == sorted(map(str, plain.collect())) and plain.count() > 3


def test_source_sample_keeps_the_first_five(spark):
    facts = spark.createDataFrame(
        [("d", "l", "q", "s", date(2026, 1, 1), f"x{i}", Decimal(1), None, None) for i in range(9)], fa.FACT_SCHEMA
    )
    row = au.returned(facts).first()
    assert (row.source_sample, row.row_count) == ("x0, x1, x2, x3, x4", 9)


def test_flow_choice():
    assert fa.choose_flows("sku") == ["sku_sales", "sku_traffic"]
    assert fa.choose_flows("both", True) == ["item_seller_sales", "seller_traffic", "item_sku_sales", "sku_traffic"]
    assert fa.choose_flows("seller", False, ["sku_sales"]) == ["sku_sales"]
    for bad in ({"level": "shop"}, {"names": ["nope"]}):
        with pytest.raises(ValueError):
            fa.choose_flows(**bad)


def test_seller_key_rules(spark):
    def named(columns, fallback=None):
        frame = spark.createDataFrame([tuple("A.B.C.D" for _ in columns)], columns)
        return frame.select(fa.seller_key(columns, fallback)).first()[0]

    assert named(["used_id", "seller_id"]) == "A.B.C.D"
    assert named(["fk_seller_used_id"]) == "A.B.C"
    assert named(["fk_sku_used_id"]) == "A.B.C"
    assert named(["other"], "other") == "A.B.C"
    with pytest.raises(ValueError):
        fa.seller_key(["other"])


def test_sellers_are_required(spark):
    with pytest.raises(ValueError):
        fa.Sellers(spark, [" ", ""])


def test_jdbc_options():
    clients = {"acme": {"host": "db", "port": 5432, "database": "dw"}}
    options = jdbc_options(clients, "acme", "me", "secret")
    assert options["url"].startswith("jdbc:postgresql://db:5432/dw")
    ranged = jdbc_table(options, "ecommerce_item", "2026-01-01", "2026-01-31", 8)
    assert (ranged["partitionColumn"], ranged["numPartitions"]) == ("day", "8")
    assert "partitionColumn" not in jdbc_table(options, "ecommerce_sku", "2026-01-01", "2026-01-31", 8)
    with pytest.raises(ValueError):
        jdbc_options(clients, "other", "me", "secret")


def test_rows_without_a_sku_are_spread(spark):
    """Half of the rows have no SKU id; joined by shuffle they reach all tasks, and none is lost."""
    rows = spark.range(8000).selectExpr("if(id % 2 = 0, null, concat('S.1.', id % 50)) as fk_sku_used_id", "id as quantity")
    owners = spark.range(50).selectExpr("concat('S.1.', id) as fk_sku_used_id", "concat('R', id) as registered_seller")
    owners = owners.unionByName(spark.sql("select cast(null as string) as fk_sku_used_id, 'nobody' as registered_seller"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = fa._owned(rows, owners).withColumn("task", F.spark_partition_id())
        tasks = [r.n for r in joined.where("fk_sku_used_id is null").groupBy("task").agg(F.count("*").alias("n")).collect()]
        assert len(tasks) == 8 and max(tasks) < 2 * min(tasks)
        assert joined.count() == 8000 and joined.where("registered_seller is not null").count() == 4000
        assert joined.columns[:2] == ["fk_sku_used_id", "quantity"]
    finally:
        for name in settings:
            spark.conf.unset(name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_usual_sellers_pass_by_the_join_with_many_unusual_skus(spark):
    registry = spark.range(20000).select(F.concat(F.lit("TH.SHP.1."), F.sha2(F.col("id").cast("string"), 256)).alias("used_id"))
    tables = {
        "ecommerce_sku": registry.withColumn("fk_seller_id", F.lit(2)),
        "ecommerce_seller": spark.createDataFrame(SELLER_IDS, "id bigint, used_id string"),
    }
    skus = [r["used_id"] for r in registry.limit(3).collect()]
    rows = spark.createDataFrame([(s,) for s in [*skus, skus[0], "TH.SHP.1.none", "TH.LAZ.2.c", "TH", None]], "fk_sku_used_id string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        found = fa.with_unusual_owner(rows, Warehouse.from_frames(tables))
        joins = [line for line in plan(found).splitlines() if "Join " in line]
        got = sorted((r["fk_sku_used_id"] or "", r["registered_seller"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # The SKUs are too many to broadcast, their prefixes are not.
    assert [("BroadcastHashJoin" in j, "sku_prefix" in j) for j in joins].count((True, True)) == 2
    assert [j for j in joins if "sku_prefix" not in j and "BroadcastHashJoin" in j] == []
    others = ["TH.SHP.1.none", "TH.LAZ.2.c", "TH", ""]
    assert got == sorted([*((s, "TH.LAZ.2") for s in [*skus, skus[0]]), *((s, None) for s in others)], key=lambda r: r[0])


def test_laid_facts_are_the_same_and_are_not_shuffled_again(spark, warehouse):
    names = ["seller_sales", "item_seller_sales", "item_sku_sales", "seller_traffic", "sku_sales", "sku_traffic"]
    plain = fa.facts(warehouse, spark, WANTED, "2026-01-01", "2026-12-31", names=names)
    laid = fa.facts(warehouse, spark, WANTED, "2026-01-01", "2026-12-31", names=names, laid=3)
    assert sorted(map(str, plain.collect())) == sorted(map(str, laid.collect()))
    cells = iv.db_all_sources(iv.db_by_source(laid, "day", summed=True))
    assert "ENSURE_REQUIREMENTS" not in "".join(x for x in plan(cells).splitlines() if "hashpartitioning(seller_id" in x)
    expected = iv.db_all_sources(iv.db_by_source(plain, "day", summed=True))
    assert sorted(map(str, cells.collect())) == sorted(map(str, expected.collect()))


def test_settled_flows_are_rolled_up_as_they_lie(spark, warehouse):
    names, metrics = ["seller_sales", "seller_traffic", "sku_sales", "sku_traffic"], list(fa.METRICS)
    before = spark.sql("show tables").count()
    with job_tables(spark):
        sellers = fa.Sellers(spark, WANTED)
        flows = list(fa.settled_flows(warehouse, spark, names, sellers, "2026-01-01", "2026-12-31", {}, 3).values())
        rows = dr.result_rows(fa.facts_of(warehouse, spark, names, sellers, "2026-01-01", "2026-12-31"), metrics)
        for summed, expected in (
            (dr.flows_by_day(flows, metrics), dr.by_day(rows, metrics)),
            (dr.flows_by_source(flows, metrics), dr.by_source(rows, metrics)),
            (au._per_source(flows[2]), None),
        ):
            assert "Exchange" not in plan(summed)
            if expected is not None:
                assert sorted(map(str, summed.collect())) == sorted(map(str, expected.select(*summed.columns).collect()))
    assert spark.sql("show tables").count() == before
