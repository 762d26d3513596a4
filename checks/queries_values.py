"""Cell values: text, numbers, dates, ids."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import dates, ids, numbers, revenue, text
from tallyframe.operators import facts as fa
from tallyframe.sources import files

from .data import CheckData
from .queries_warehouse import PAID_OR_NET, RULE
from .registry import CUTOVER, query

# White space beyond ASCII, spelled out because the SQL pattern knows ASCII only.
SPACES = r"[\s" + "\u000b\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + "]+"


@query(f"""
select doc_id, md5(trim(regexp_replace(text, '{SPACES}', ' ', 'g'))) as digest,
  cast(length(trim(regexp_replace(text, '{SPACES}', ' ', 'g'))) as bigint) as n_chars from {{documents}}
""")
def clean_name(d: CheckData) -> DataFrame:
    c = text.clean(F.col("text"))
    return d.table("documents").select(
        "doc_id", F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("n_chars")
    )


@query("""
select doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) as digest from {documents}
""")
def norm_key(d: CheckData) -> DataFrame:
    return d.table("documents").select("doc_id", F.md5(text.name_key(F.col("text"))).alias("digest"))


@query("""
select s_suppkey as id, used_id as part from {supplier} join {ecommerce_seller} on id = s_suppkey
union all select s_suppkey, s_name from {supplier}
union all select s_suppkey, cast(s_acctbal as varchar) from {supplier}
""")
def split_multi(d: CheckData) -> DataFrame:
    sellers = d.table("ecommerce_seller")
    rows = d.table("supplier").join(sellers, F.col("id") == F.col("s_suppkey"))
    listed = F.concat(
        F.lit(" "), F.col("used_id"), F.lit(" ,; "), F.col("s_name"), F.lit("\n\n  "),
        F.col("s_acctbal").cast("string"), F.lit(" ;"),
    )
    return rows.select("id", F.explode(text.split_values(listed)).alias("part"))


@query("select file, seller_id, marketplace from {export_specs}")
def guess_seller(d: CheckData) -> DataFrame:
    # The grid's files are named in capitals and end in .xlsx; lower them and pad the name.
    lowered = F.concat(F.lower(F.regexp_replace("file", r"\.xlsx$", "")), F.lit(" may.xlsx"))
    named = d.grid.select(F.col("file").alias("original"), lowered.alias("file"))
    guessed = files.guess_specs(named)
    originals = named.distinct()
    return originals.join(guessed, "file").select(F.col("original").alias("file"), "seller_id", "marketplace")


@query("""
select regexp_replace(concat(p_name, '_', p_brand, '_', p_type), '[^A-Za-z0-9_-]+', '_', 'g') as safe,
  count(*) as n from {part} group by 1
""")
def safe_key(d: CheckData) -> DataFrame:
    label = F.concat_ws(" / ", F.lit(""), "p_name", "p_brand", "p_type", F.lit(" "))
    rows = d.table("part").select(text.safe_key(F.regexp_replace(label, " / ", " ")).alias("safe"))
    return rows.groupBy("safe").agg(F.count("*").alias("n"))


@query("""
select layout, cast(day as varchar) as day, count(*) as n from {date_cells} group by 1, 2
""")
def parse_date(d: CheckData) -> DataFrame:
    rows = d.table("date_cells").select("layout", dates.parse_day(F.col("cell")).alias("day"))
    return rows.groupBy("layout", "day").agg(F.count("*").alias("n"))


NUMBERS = """
select layout, count(*) as n, count({0}) as readable, cast(sum({0}) as double) as total
from {{number_cells}} group by 1
"""


@query(NUMBERS.format("value"))
def to_number(d: CheckData) -> DataFrame:
    return _by_layout(d, numbers.parse_number(F.col("cell")))


@query(NUMBERS.format("coalesce(try_cast(cell as decimal(24,6)), 0)"))
def coerce_metrics(d: CheckData) -> DataFrame:
    return _by_layout(d, numbers.coerce(F.col("cell")))


def _by_layout(d: CheckData, value) -> DataFrame:
    rows = d.table("number_cells").select("layout", value.alias("value"))
    return rows.groupBy("layout").agg(
        F.count("*").alias("n"), F.count("value").alias("readable"), F.sum("value").alias("total")
    )


def _periods(d: CheckData, granularity: str) -> DataFrame:
    day = dates.parse_day(F.col("cell"))
    rows = d.table("date_cells").select(dates.period_label(day, granularity).alias("period"))
    return rows.groupBy("period").agg(F.count("*").alias("n"))


@query("select strftime(day, '%Y-%m-%d') as period, count(*) as n from {date_cells} group by 1")
def period_day(d: CheckData) -> DataFrame:
    return _periods(d, "day")


# Week of a day: back to the nearest Tuesday (ISO weekday 2), forward six days.
WEEK = """concat(strftime({0} - cast((isodow({0}) + 5) % 7 as int), '%Y-%m-%d'), '/',
  strftime({0} - cast((isodow({0}) + 5) % 7 as int) + 6, '%Y-%m-%d'))"""


@query(f"select {WEEK.format('day')} as period, count(*) as n from {{date_cells}} group by 1")
def period_week(d: CheckData) -> DataFrame:
    return _periods(d, "week")


@query("select strftime(day, '%Y-%m') as period, count(*) as n from {date_cells} group by 1")
def period_month(d: CheckData) -> DataFrame:
    return _periods(d, "month")


@query(f"""
select 'day' as granularity, strftime(day, '%Y-%m-%d') as period, cast(sum(quantity) as double) as quantity
  from {{ecommerce_export_seller_sales}} group by 2
union all select 'week', {WEEK.format('day')}, cast(sum(quantity) as double) from {{ecommerce_export_seller_sales}} group by 2
union all select 'month', strftime(day, '%Y-%m'), cast(sum(quantity) as double) from {{ecommerce_export_seller_sales}} group by 2
""")
def db_period(d: CheckData) -> DataFrame:
    day = F.col("day")
    label = F.explode(
        F.array(
            *(
                F.struct(F.lit(g).alias("granularity"), dates.period_label(day, g).alias("period"))
                for g in ("day", "week", "month")
            )
        )
    )
    # Days first: the label fan-out then runs on one row per day.
    daily = d.table("ecommerce_export_seller_sales").groupBy("day").agg(F.sum("quantity").alias("quantity"))
    return daily.select(label.alias("l"), "quantity").groupBy("l.granularity", "l.period").agg(
        F.sum("quantity").alias("quantity")
    )


@query("""
select cast(last_day(day) as varchar) as month_end,
  cast(sum(case when day > last_day(day) - 7 then quantity else 0 end) as double) as last_7,
  cast(sum(case when day > last_day(day) - 30 then quantity else 0 end) as double) as last_30
from {ecommerce_export_seller_sales} group by 1
""")
def quick_range(d: CheckData) -> DataFrame:
    end = F.last_day("day")

    def within(days: int):
        first, last = dates.last_days(end, days)
        return F.sum(F.when(F.col("day").between(first, last), F.col("quantity")).otherwise(0))

    rows = d.table("ecommerce_export_seller_sales")
    return rows.groupBy(end.alias("month_end")).agg(within(7).alias("last_7"), within(30).alias("last_30"))


@query("""
select split_part(fk_sku_used_id, '.', 1) as country, split_part(fk_sku_used_id, '.', 2) as marketplace,
  split_part(fk_sku_used_id, '.', 5) as beyond, count(distinct split_part(fk_sku_used_id, '.', 3)) as sellers, count(*) as n
from {ecommerce_export_sku_sales} group by 1, 2, 3
""")
def seller_parts(d: CheckData) -> DataFrame:
    sku = F.col("fk_sku_used_id")
    parts = [ids.segment(sku, n).alias(name) for n, name in ((1, "country"), (2, "marketplace"), (3, "number"), (5, "beyond"))]
    per_seller = d.table("ecommerce_export_sku_sales").groupBy(*parts).agg(F.count("*").alias("n"))
    return per_seller.groupBy("country", "marketplace", "beyond").agg(
        F.count("number").alias("sellers"), F.sum("n").alias("n")
    )


@query("""
select concat(split_part(fk_sku_used_id, '.', 1), '.', split_part(fk_sku_used_id, '.', 2), '.', split_part(fk_sku_used_id, '.', 3)) as prefix,
  count(*) as n from {ecommerce_export_sku_traffic} group by 1
""")
def seller_prefix(d: CheckData) -> DataFrame:
    rows = d.table("ecommerce_export_sku_traffic").select(ids.seller_prefix(F.col("fk_sku_used_id")).alias("prefix"))
    return rows.groupBy("prefix").agg(F.count("*").alias("n"))


@query("""
with owned as (
  select split_part(coalesce(i.seller_used_id, registered_seller), '.', 2) as marketplace, i.*
  from {ecommerce_item} i left join {registered} r on r.fk_sku_used_id = i.fk_sku_used_id),
priced as (
  select marketplace, s_net as value from owned where marketplace = 'LAZ'
  union all select marketplace, s_paid from owned where marketplace = 'SHP'
  union all select marketplace, s_paid from owned where marketplace = 'TTK'
  union all select marketplace, list_filter([s_paid, s_net, s_onsite_selling, s_seller_selling, 0], lambda x: x is not null)[1]
  from owned where coalesce(marketplace, '') not in ('LAZ', 'SHP', 'TTK'))
select marketplace, count(*) as n, cast(sum(value) as double) as revenue from priced group by 1
""")
def item_revenue_rule(d: CheckData) -> DataFrame:
    marketplace = ids.segment(F.coalesce("seller_used_id", "registered_seller"), 2)
    rows = fa.with_owner(d.table("ecommerce_item"), d.warehouse)
    return rows.groupBy(marketplace.alias("marketplace")).agg(
        F.count("*").alias("n"), F.sum(revenue.daily_item_revenue(marketplace)).alias("revenue")
    )


@query(f"""
select strftime(day, '%Y-%m') as month, split_part(seller_used_id, '.', 2) as marketplace,
  {PAID_OR_NET} as revenue
from {{ecommerce_item}} left join {RULE} on market = split_part(seller_used_id, '.', 2) and late = (day >= date '{CUTOVER}')
group by 1, 2
""")
def monthly_revenue_rule(d: CheckData) -> DataFrame:
    marketplace = ids.segment(F.col("seller_used_id"), 2)
    value = revenue.monthly_item_revenue(marketplace, F.col("day"), date.fromisoformat(CUTOVER))
    return d.table("ecommerce_item").groupBy(
        dates.period_label(F.col("day"), "month").alias("month"), marketplace.alias("marketplace")
    ).agg(F.sum(value).alias("revenue"))


OWNED = """
from {ecommerce_export_sku_sales} f left join {ecommerce_sku} sku on f.fk_sku_used_id = sku.used_id
left join {ecommerce_seller} sel on sku.fk_seller_id = sel.id
"""


@query(f"""
select coalesce(sel.used_id, concat(split_part(f.fk_sku_used_id, '.', 1), '.', split_part(f.fk_sku_used_id, '.', 2), '.',
  split_part(f.fk_sku_used_id, '.', 3))) as seller_id, count(*) as n {OWNED} group by 1
""")
def resolved_seller(d: CheckData) -> DataFrame:
    rows = fa.with_owner(d.table("ecommerce_export_sku_sales"), d.warehouse)
    seller = ids.resolved_seller(F.col("registered_seller"), F.col("fk_sku_used_id"))
    return rows.groupBy(seller.alias("seller_id")).agg(F.count("*").alias("n"))


@query(f"select sel.used_id as registered_seller, count(*) as n, cast(sum(quantity) as double) as quantity {OWNED} group by 1")
def dim_chain(d: CheckData) -> DataFrame:
    rows = fa.with_owner(d.table("ecommerce_export_sku_sales"), d.warehouse)
    return rows.groupBy("registered_seller").agg(
        F.count("*").alias("n"), F.sum("quantity").alias("quantity")
    )


@query("""
select case when abs(b - a) <= 1 then true when a <> 0 then 20 * abs(b - a) <= abs(a) else b = 0 end as within,
  count(*) as n
from (select sum(quantity) as a, sum(case when source = 'crawl' then 0 else quantity end) as b
  from {ecommerce_export_seller_sales} group by seller, day) t
group by 1
""")
def tolerance_match(d: CheckData) -> DataFrame:
    other = F.when(F.col("source") == "crawl", 0).otherwise(F.col("quantity"))
    pairs = d.table("ecommerce_export_seller_sales").groupBy("seller", "day").agg(
        F.sum("quantity").alias("a"), F.sum(other).alias("b")
    )
    within = numbers.within_tolerance(
        F.col("a"), F.col("b"), F.lit(1), F.lit("0.05").cast("decimal(9,4)")
    )
    return pairs.groupBy(within.alias("within")).agg(F.count("*").alias("n"))


@query("select coalesce(source, 'NULL_SOURCE') as source, count(*) as n from {ecommerce_export_sku_sales} group by 1")
def null_source(d: CheckData) -> DataFrame:
    rows = d.table("ecommerce_export_sku_sales").select(F.coalesce("source", F.lit(fa.NO_SOURCE)).alias("source"))
    return rows.groupBy("source").agg(F.count("*").alias("n"))
