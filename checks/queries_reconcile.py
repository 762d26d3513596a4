"""Comparison, source investigation, report slices and whole jobs."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT
from tallyframe.functions.dates import period_label
from tallyframe.operators import compare as cp
from tallyframe.operators import facts as fa
from tallyframe.operators import investigate as iv
from tallyframe.operators import slices as sl
from tallyframe.plans.batch import run_batch
from tallyframe.plans.two_file import run_two_file
from tallyframe.sources.files import guess_specs
from tallyframe.sources.scratch import new_folder, settle_laid

from .data import CheckData
from .queries_ingest import METRICS
from .queries_values import WEEK
from .registry import END, START, query

PERIOD = {
    "day": "strftime(day, '%Y-%m-%d')",
    "week": WEEK.format("day"),
    "month": "strftime(day, '%Y-%m')",
}


# ---- two-sided -------------------------------------------------------------------------------


def _two_sided_sql(granularity: str, platform: str = "platform_day") -> str:
    def side(view: str) -> str:
        sums = ", ".join(f"cast(sum({m}) as decimal(38,6)) as {m}" for m in METRICS)
        return f"select seller_id, {PERIOD[granularity]} as period, {sums} from {{{view}}} group by 1, 2"

    def metric(m: str) -> str:
        return f"""select coalesce(p.seller_id, d.seller_id) as seller_id, coalesce(p.period, d.period) as period,
  '{m}' as metric, p.seller_id is not null as on_p, d.seller_id is not null as on_d,
  coalesce(p.{m}, 0) as pv, coalesce(d.{m}, 0) as dv
from p full outer join d on p.seller_id is not distinct from d.seller_id and p.period = d.period"""

    return f"""with p as ({side(platform)}), d as ({side("db_day")})
select seller_id, period, metric, cast(pv as double) as platform_value, cast(dv as double) as db_value,
  cast(dv - pv as double) as diff_db_minus_platform,
  case when pv <> 0 then cast(dv - pv as double) / cast(pv as double) when dv = 0 then 0.0::double else 1.0::double end as diff_pct,
  case when not on_d then 'missing_in_db' when not on_p then 'missing_in_platform' when dv = pv then 'match' else 'mismatch' end as status
from ({" union all ".join(metric(m) for m in METRICS)}) t"""


def _typed(d: CheckData, view: str, granularity: str) -> DataFrame:
    period = period_label(F.col("day"), granularity)
    return d.table(view).select("seller_id", period.alias("period"), *METRICS)


def _two_sided(d: CheckData, granularity: str, config=DEFAULT) -> DataFrame:
    return cp.compare_two_sided(
        _typed(d, "platform_day", granularity), _typed(d, "db_day", granularity), METRICS, config
    )


@query(_two_sided_sql("day"))
def compare_two_sided(d: CheckData) -> DataFrame:
    return _two_sided(d, "day")


@query(_two_sided_sql("week"))
def compare_two_sided_week(d: CheckData) -> DataFrame:
    return _two_sided(d, "week")


@query(_two_sided_sql("month"))
def compare_two_sided_month(d: CheckData) -> DataFrame:
    return _two_sided(d, "month")


@query(f"select status, count(*) as count from ({_two_sided_sql('week')}) t group by 1")
def status_summary(d: CheckData) -> DataFrame:
    return cp.status_summary(_two_sided(d, "week"))


@query(_two_sided_sql("day") + " order by status, period, metric, seller_id limit 300")
def two_sided_preview(d: CheckData) -> DataFrame:
    return sl.two_sided_preview(_two_sided(d, "day"))


LOOSE = replace(
    DEFAULT,
    tolerance_abs={**DEFAULT.tolerance_abs, "quantity": Decimal(1)},
    tolerance_pct={**DEFAULT.tolerance_pct, "revenue": Decimal("0.25")},
)


@query(f"""
select metric, case when status <> 'mismatch' then status
  when metric = 'quantity' and abs(diff_db_minus_platform) <= 1 then 'match'
  when metric = 'revenue' and platform_value <> 0 and abs(diff_db_minus_platform) <= 0.25 * platform_value then 'match'
  else 'mismatch' end as status, count(*) as n
from ({_two_sided_sql('month')}) t group by 1, 2
""")
def tolerance_by_metric(d: CheckData) -> DataFrame:
    return _two_sided(d, "month", LOOSE).groupBy("metric", "status").agg(F.count("*").alias("n"))


@query(f"""
with c as ({_two_sided_sql("day", "platform_read")})
select 'Comparison' as table_name, count(*) as row_count from c
union all select 'Summary', count(distinct status) from c
union all select 'Preview', least(count(*), 300) from c
union all select 'DB_Normalized', count(*) from {{db_day}}
union all select 'Platform_Normalized', count(*) from {{platform_read}}
union all select 'Column_Mapping', count(*) from {{export_specs}}
union all select 'Errors', (select count(*) from {{platform_day}} where orders > 2)
  + (select count(*) from {{export_specs}} where platform_sheet is null)
union all select 'Platform_Duplicates', 0 union all select 'DB_Duplicates', 0
""")
def report_bundle(d: CheckData) -> DataFrame:
    bundle = run_two_file(
        d.grid, d.specs, d.db_grid, guess_specs(d.db_grid), new_folder(d.spark, "two-file")
    )
    return bundle.manifest()


@query(_two_sided_sql("day", "platform_read"))
def report_comparison(d: CheckData) -> DataFrame:
    bundle = run_two_file(
        d.grid, d.specs, d.db_grid, guess_specs(d.db_grid), new_folder(d.spark, "two-file")
    )
    return bundle.table("Comparison")


# ---- by source -------------------------------------------------------------------------------

FACT_SUMS = ", ".join(f"cast(sum(coalesce({m}, 0)) as decimal(38,6)) as {m}" for m in ("quantity", "revenue", "page_view"))


P_SUMS = ", ".join(f"cast(sum({m}) as decimal(38,6)) as {m}" for m in METRICS)


def _ctes(granularity: str, platform: str = "platform_day", facts: str = "export_facts") -> str:
    """Cells, per-source sums and the classified detail, written as plain SQL."""
    period = PERIOD[granularity]
    cells = " union all ".join(
        f"select seller_id, period, '{lv}' as data_level, '{dt}' as data_type, '{m}' as metric, {m} as pv, orders from p"
        for lv, dt, ms in iv.EXPECTED
        for m in ms
    )
    longs = " union all ".join(
        f"""select seller_id, period, data_level, data_type, query_source_table, source, '{m}' as metric, {m} as sv
from src where data_type like '%{"traffic" if m == "page_view" else "sales"}'"""
        for m in iv.METRICS
    )
    return f"""p as (select seller_id, {period} as period, {P_SUMS} from {{{platform}}} group by 1, 2),
src as (select seller_id, {period} as period, data_level, data_type, query_source_table, source, {FACT_SUMS}
  from {{{facts}}} group by 1, 2, 3, 4, 5, 6),
cells as ({cells}),
longs as ({longs}),
pairs as (select c.*, l.query_source_table, l.source, l.sv from cells c
  left join longs l on l.seller_id = c.seller_id and l.period = c.period and l.data_level = c.data_level
    and l.data_type = c.data_type and l.metric = c.metric),
agg as (select seller_id, period, data_level, data_type, metric, any_value(pv) as pv, any_value(orders) as orders,
  coalesce(sum(sv), 0) as dv, string_agg(distinct query_source_table, ', ' order by query_source_table) as tables,
  coalesce(string_agg(source, ', ' order by query_source_table, source) filter (where sv = pv), '') as matching,
  count(*) filter (where sv = pv) as hits
  from pairs group by 1, 2, 3, 4, 5),
detail as (select seller_id, period, data_level, data_type, coalesce(tables, data_type) as query_source_table, metric,
  cast(pv as double) as platform_value, cast(orders as double) as platform_orders, true as platform_orders_available,
  cast(dv as double) as db_all_sources, cast(dv - pv as double) as diff_db_minus_platform,
  case when pv <> 0 then cast(dv - pv as double) / cast(pv as double) when dv = 0 then 0.0::double else 1.0::double end as diff_pct,
  case when dv = pv then 'match' when hits > 0 then 'suspicious_extra_source'
    when dv = 0 and pv <> 0 then 'missing_in_db' else 'mismatch' end as status,
  matching as matching_source_alone from agg)"""


DETAIL = (
    "seller_id, period, data_level, data_type, query_source_table, metric, platform_value, platform_orders, "
    "platform_orders_available, db_all_sources, diff_db_minus_platform, diff_pct, status, matching_source_alone"
)


def _facts(d: CheckData) -> DataFrame:
    return fa.facts(d.warehouse, d.spark, d.sellers, START, END)


def _by_source(d: CheckData, granularity: str, laid: int | None = None) -> DataFrame:
    facts = fa.facts(d.warehouse, d.spark, d.sellers, START, END, grain=granularity, laid=laid)
    return iv.db_by_source(facts, granularity, summed=True)


def _rows(d: CheckData, granularity: str) -> DataFrame:
    # Both sides come by seller, so that neither is shuffled again for the join.
    laid = fa.parts_by_seller(d.spark)
    cells = iv.platform_cells(_typed(d, "platform_day", granularity), list(METRICS), laid=laid)
    return iv.source_rows(cells, _by_source(d, granularity, laid))


def _detail(d: CheckData, granularity: str) -> DataFrame:
    return iv.compare_by_source(_rows(d, granularity)).drop("checked_source", "recommendation")


ADVICE = " ".join(f"when '{k}' then '{v}'" for k, v in iv.RECOMMENDATIONS.items())


@query(f"""with {_ctes("month")} select {DETAIL}, true as checked_source, case status {ADVICE} end as recommendation from detail""")
def compare_by_source(d: CheckData) -> DataFrame:
    return iv.compare_by_source(_rows(d, "month"))


@query(f"""with {_ctes("month")} select seller_id, period, data_level, data_type, query_source_table, metric, source,
  cast(sv as double) as source_value, cast(pv as double) as platform_value, cast(sv - pv as double) as source_diff,
  case when pv <> 0 then cast(sv as double) / cast(pv as double) when sv = 0 then 1.0::double else 0.0::double end as source_accuracy,
  sv = pv as source_match, case when sv = pv then 'MATCH_UI' when sv > pv then 'OVER_UI' else 'UNDER_UI' end as investigation_note
from pairs where source is not null""")
def source_check_detail(d: CheckData) -> DataFrame:
    return iv.source_check_detail(_rows(d, "month"))


@query(f"""select distinct seller_id, {PERIOD["month"]} as period, data_level, data_type from {{platform_day}},
  (values ('seller', 'seller_sales'), ('seller', 'seller_traffic'), ('sku', 'sku_sales'), ('sku', 'sku_traffic')) t(data_level, data_type)""")
def expected_grid(d: CheckData) -> DataFrame:
    return iv.expected_grid(_typed(d, "platform_day", "month"))


@query("""
select seller_id, data_level, data_type, case when use_item_sales and data_type like '%sales' then concat('item_', data_type) else data_type end as query_source_table
from {export_specs}, (values ('seller', 'seller_sales'), ('seller', 'seller_traffic'), ('sku', 'sku_sales'), ('sku', 'sku_traffic')) t(data_level, data_type)
""")
def expected_tables(d: CheckData) -> DataFrame:
    return iv.expected_tables(d.specs)


SRC_SUMS = ", ".join(f"cast({m} as double) as {m}" for m in iv.METRICS)


@query(f"with {_ctes('month')} select seller_id, period, data_level, data_type, query_source_table, source, {SRC_SUMS} from src")
def db_by_source(d: CheckData) -> DataFrame:
    return _by_source(d, "month")


@query(f"""with {_ctes('month')} select seller_id, period, data_level, data_type,
  {", ".join(f"cast(sum({m}) as double) as {m}" for m in iv.METRICS)} from src group by 1, 2, 3, 4""")
def db_all_sources(d: CheckData) -> DataFrame:
    return iv.db_all_sources(_by_source(d, "month", fa.parts_by_seller(d.spark)))


@query(f"""with {_ctes('month', facts='switched_facts')} select seller_id, period, data_level, data_type,
  string_agg(distinct query_source_table, ', ' order by query_source_table) as query_source_table from src group by 1, 2, 3, 4""")
def query_table_label(d: CheckData) -> DataFrame:
    jobs = d.specs.select("seller_id", "use_item_sales")
    facts = fa.facts_by_switch(d.warehouse, jobs, START, END)
    return iv.query_table_label(iv.db_by_source(facts, "month"))


@query(f"""with {_ctes('day')} select seller_id, period, data_level, data_type, query_source_table, count(distinct source) as source_count
from src group by 1, 2, 3, 4, 5 having count(distinct source) > 1""")
def duplicate_source(d: CheckData) -> DataFrame:
    return iv.duplicate_source(_by_source(d, "day"))


@query(f"""with {_ctes('day')} select status, data_type, metric, count(*) as n, cast(sum(diff_db_minus_platform) as double) as diff
from (select status, data_type, metric, cast(diff_db_minus_platform as decimal(38,6)) as diff_db_minus_platform from detail) t
group by 1, 2, 3""")
def status_by_day(d: CheckData) -> DataFrame:
    return iv.cell_statuses(_rows(d, "day")).groupBy("status", "data_type", "metric").agg(
        F.count("*").alias("n"), F.sum("diff_db_minus_platform").alias("diff")
    )


SLICE_SQL = " union all ".join(
    f"select '{name}' as slice, data_type, count(*) as n from detail where {cond} group by 2"
    for name, cond in sl.SLICES.items()
)


@query(f"with {_ctes('day')} {SLICE_SQL}")
def status_slices(d: CheckData) -> DataFrame:
    # One pass over the detail: each row counts for every slice it belongs to.
    inside = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in sl.SLICES.items())))
    rows = iv.cell_statuses(_rows(d, "day")).select("data_type", F.explode(inside).alias("slice"))
    return rows.groupBy("slice", "data_type").agg(F.count("*").alias("n"))


@query(f"""with {_ctes('day')} select seller_id, period, max(platform_orders) as platform_orders, true as platform_orders_available,
  count(*) as missing_rows, string_agg(distinct metric, ', ' order by metric) as missing_metrics,
  string_agg(distinct query_source_table, ', ' order by query_source_table) as missing_query_tables
from detail where status = 'missing_in_db' group by 1, 2""")
def missing_order_summary(d: CheckData) -> DataFrame:
    return iv.missing_orders(_rows(d, "day"))


@query(f"""with {_ctes('month')} select {DETAIL} from detail
where metric = 'revenue' and status = 'mismatch' and query_source_table = 'sku_sales'""")
def filter_comparison(d: CheckData) -> DataFrame:
    return sl.filter_comparison(_detail(d, "month"), "revenue", "mismatch", "sku_sales")


@query(f"""with {_ctes('month')} select distinct 'metric' as filter, metric as value from detail
union all select distinct 'status', status from detail union all select distinct 'table', query_source_table from detail
union all select f, 'all' from (values ('metric'), ('status'), ('table')) t(f)""")
def filter_options(d: CheckData) -> DataFrame:
    return sl.filter_options(_detail(d, "month"))


@query(f"""with {_ctes('day')} select {DETAIL} from detail
order by status, seller_id, period, data_level, data_type, metric limit 500""")
def comparison_preview(d: CheckData) -> DataFrame:
    return sl.by_source_preview(_detail(d, "day"))


@query(f"""with {_ctes('month')} select {DETAIL} from detail where status <> 'match' and seller_id in
  (select distinct seller_id from detail where status <> 'match' order by seller_id limit 20)""")
def per_seller_wrong(d: CheckData) -> DataFrame:
    return sl.per_seller_wrong(_detail(d, "month"), sl.SELLER_TABLES)


@query(f"""with {_ctes('day')}
select 'source_rows' as counter, count(*) as value from pairs where source is not null
union all select 'duplicate_source', count(*) from (select 1 from src
  group by seller_id, period, data_level, data_type, query_source_table having count(distinct source) > 1) t
union all select 'row_count', count(*) from detail""")
def report_counters(d: CheckData) -> DataFrame:
    laid = fa.parts_by_seller(d.spark)
    by_source = settle_laid(_by_source(d, "day", laid), "by-source", laid, fa.LAID_BY)
    cells = iv.platform_cells(_typed(d, "platform_day", "day"), list(METRICS), laid=laid)
    rows = iv.source_rows(cells, by_source)
    counted = {
        "source_rows": iv.source_check_detail(rows),
        "duplicate_source": iv.duplicate_source(by_source),
        "row_count": iv.compare_by_source(rows),
    }
    counts = [df.agg(F.lit(name).alias("counter"), F.count("*").alias("value")) for name, df in counted.items()]
    return reduce(DataFrame.unionByName, counts)


# ---- whole jobs ------------------------------------------------------------------------------


@query(f"""with {_ctes('day', 'platform_read', 'switched_facts')}
select {DETAIL.replace("query_source_table", "case when seller_id like 'PH.%' and data_type like '%sales' then concat('item_', data_type) else data_type end as query_source_table")}
from detail""")
def batch_check(d: CheckData) -> DataFrame:
    bundle = run_batch(d.warehouse, d.grid, d.specs, START, END, new_folder(d.spark, "batch"))
    return bundle.table("Comparison").drop("checked_source", "recommendation")
