"""Messy exports to normalised facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import compare as cp
from tallyframe.operators import sheets as sh
from tallyframe.plans.ingest import ingest
from tallyframe.sources.delimited import read_delimited
from tallyframe.sources.files import guess_specs
from tallyframe.sources.scratch import new_folder

from .data import CheckData
from .registry import query

METRICS = ("quantity", "revenue", "page_view", "orders")


def _scan(d: CheckData, separator: str, suffix: str) -> DataFrame:
    """Write the database export as files with headers, read them back as text."""
    folder = new_folder(d.spark, f"export-{suffix}")
    rows = d.table("db_day").select(
        F.col("seller_id").alias("Seller"), F.col("day").alias("day"),
        F.col("quantity").alias("total_quantity"), F.col("revenue").alias("revenue_local"),
        F.col("page_view").alias("Total Page View"), F.col("orders").alias("total_orders"),
    )
    rows.write.option("header", True).option("sep", separator).option("extension", suffix).csv(folder)
    return read_delimited(d.spark, [folder])


def _scanned(d: CheckData, grid: DataFrame) -> DataFrame:
    specs = sh.db_specs(guess_specs(grid))
    facts = ingest(grid, specs, "day").facts
    return facts.select("seller_id", "period", *METRICS)


DB_DAY = """
select seller_id, cast(day as varchar) as period, cast(quantity as double) as quantity, cast(revenue as double) as revenue,
  cast(page_view as double) as page_view, cast(orders as double) as orders from {db_day}
"""


@query(DB_DAY)
def scan_csv(d: CheckData) -> DataFrame:
    return _scanned(d, _scan(d, ",", "csv"))


@query(DB_DAY)
def scan_tsv(d: CheckData) -> DataFrame:
    return _scanned(d, _scan(d, "\t", "tsv"))


@query(DB_DAY)
def normalize_db(d: CheckData) -> DataFrame:
    specs = sh.db_specs(guess_specs(d.db_grid))
    return ingest(d.db_grid, specs, "day").facts.select("seller_id", "period", *METRICS)


@query("""
select file, sheet, case sheet when 'Notes' then 0 else 2 end as header_idx
from (select distinct file, sheet from {export_grid}) t where sheet = 'Key Metrics' or file not like '%.SHP.%'
""")
def header_detect(d: CheckData) -> DataFrame:
    found = sh.detect_headers(d.grid, d.specs)
    return found.select("file", "sheet", F.col("header_idx").cast("int").alias("header_idx"))


@query("""
select distinct file, sheet from {export_grid} where sheet = 'Key Metrics' or file not like '%.SHP.%'
""")
def sheet_select(d: CheckData) -> DataFrame:
    chosen = sh.with_specs(d.grid.select("file", "sheet", "has_header").distinct(), d.specs)
    return chosen.select("file", "sheet")


@query("""
select file, sheet, cast(row_idx as bigint) as row_idx, concat_ws('|', c0, c1, c2, c3, c4, c5) as cells from {export_grid}
where (sheet = 'Key Metrics' and row_idx > 2) or (sheet = 'Notes' and row_idx > 0 and file not like '%.SHP.%')
""")
def header_promote(d: CheckData) -> DataFrame:
    rows = sh.data_rows(d.grid, sh.sheet_table(d.grid, d.specs))
    return rows.select("file", "sheet", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("""
select file as file_name, seller_id, marketplace, 'Key Metrics' as sheet,
  case marketplace when 'LAZ' then 'Day' else 'Date' end as date,
  case marketplace when 'SHP' then 'Gross Units Sold' when 'LAZ' then 'Units Sold' else 'Items sold' end as quantity,
  case marketplace when 'SHP' then 'Gross Sales (Local Currency)' when 'LAZ' then 'Net Sales' else 'GMV' end as revenue,
  case marketplace when 'SHP' then 'Product Views' when 'LAZ' then 'PAGE VIEWS' else 'Page views' end as page_view,
  cast(null as varchar) as product_impression,
  case marketplace when 'SHP' then 'Gross Orders' else 'Orders' end as orders
from {export_specs}
""")
def column_mapping(d: CheckData) -> DataFrame:
    return sh.column_mapping(sh.sheet_table(d.grid, d.specs))


@query("""
select concat('export_', seller_id, '.xlsx') as file, count(*) as day_rows, count(*) as week_rows,
  cast(1 as bigint) as month_rows from {platform_day} group by seller_id
""")
def date_range_rows(d: CheckData) -> DataFrame:
    rows = sh.data_rows(d.grid, sh.sheet_table(d.grid, d.specs).where(sh.usable()))
    out = None
    for granularity in ("day", "week", "month"):
        kept = sh.kept_rows(rows, granularity).groupBy("file").agg(F.count("*").alias(f"{granularity}_rows"))
        out = kept if out is None else out.join(kept, "file", "left")
    return out


@query("""
select concat('export_', seller_id, '.xlsx') as file, count(*) + 1 as rows_before, count(*) as rows_after
from {platform_day} group by seller_id
""")
def region_all_filter(d: CheckData) -> DataFrame:
    rows = sh.data_rows(d.grid, sh.sheet_table(d.grid, d.specs).where(sh.usable()))
    after = sh.kept_rows(rows, "week").groupBy("file").agg(F.count("*").alias("rows_after"))
    before = rows.groupBy("file").agg(F.count("*").alias("rows_before"))
    return before.join(after, "file", "left")


PLATFORM_READ = """
select concat('export_', seller_id, '.xlsx') as file_name, split_part(seller_id, '.', 2) as marketplace,
  'Key Metrics' as source_sheet, seller_id, {0} as period, cast(quantity as double) as quantity,
  cast(revenue as double) as revenue, cast(page_view as double) as page_view,
  cast(null as double) as product_impression, cast(orders as double) as orders
from {{platform_read}}
"""


@query(PLATFORM_READ.format("cast(day as varchar)"))
def normalize_platform(d: CheckData) -> DataFrame:
    return ingest(d.grid, d.specs, "day").facts


@query("""
select file, case when file = 'db_TH.csv' then seller_id else concat(split_part(seller_id, '.', 1), '.ALL') end as seller_id, count(*) as n
from (select seller_id, concat('db_', split_part(seller_id, '.', 1), '.csv') as file from {db_day}) t group by 1, 2
""")
def seller_override(d: CheckData) -> DataFrame:
    # TH keeps the seller column of its export; the others are given one id per file.
    country = F.regexp_extract("file", "db_(..)", 1)
    given = F.when(country != "TH", F.concat(F.lit(" "), country, F.lit(".ALL ")))
    specs = sh.db_specs(guess_specs(d.db_grid)).withColumn("seller_id", given)
    rows = ingest(d.db_grid, specs, "day").facts
    return rows.groupBy(F.col("file_name").alias("file"), "seller_id").agg(F.count("*").alias("n"))


@query("""
select concat('export_', seller_id, '.xlsx') as file, 'Key Metrics' as sheet,
  (year(day) - 1990) * 372 + month(day) * 31 + day(day) as row_idx, 'malformed_number:page_view' as reason
from {platform_day} where orders > 2
union all select file, 'Notes', null, 'no_date_column' from {export_specs} where platform_sheet is null
""")
def quarantine(d: CheckData) -> DataFrame:
    found = ingest(d.grid, d.specs, "day").quarantine
    return found.withColumn("row_idx", F.col("row_idx").cast("bigint"))


@query("""
select f.file, f.seller_id, f.marketplace, coalesce(r.n, 0) as rows_read, cast(coalesce(r.q, 0) as double) as quantity,
  coalesce(b.n, 0) + case when f.platform_sheet is null then 1 else 0 end as problems
from {export_specs} f
left join (select seller_id, count(*) as n, sum(quantity) as q from {platform_read} group by 1) r on r.seller_id = f.seller_id
left join (select seller_id, count(*) as n from {platform_day} where orders > 2 group by 1) b on b.seller_id = f.seller_id
""")
def batch_ingest(d: CheckData) -> DataFrame:
    read = ingest(d.grid, d.specs, "day")
    good = F.col("day").isNotNull() & F.col("malformed").isNull()
    rows = read.parsed.groupBy(F.col("file_name").alias("file")).agg(
        F.count_if(good).alias("rows_read"),
        F.sum(F.when(good, F.col("quantity"))).alias("quantity"),
    )
    problems = read.quarantine.groupBy("file").agg(F.count("*").alias("problems"))
    return (
        d.specs.select("file", "seller_id", "marketplace")
        .join(rows, "file", "left").join(problems, "file", "left")
        .na.fill(0, ["rows_read", "quantity", "problems"])
    )


def week_facts(d: CheckData) -> DataFrame:
    return ingest(d.grid, d.specs, "week").facts


WEEKLY = """
select seller_id, concat(strftime(day - cast((isodow(day) + 5) % 7 as int), '%Y-%m-%d'), '/',
  strftime(day - cast((isodow(day) + 5) % 7 as int) + 6, '%Y-%m-%d')) as period, * exclude (seller_id) from {platform_read}
"""


@query(f"""
select seller_id, period, cast(sum(quantity) as double) as quantity, cast(sum(revenue) as double) as revenue,
  cast(sum(page_view) as double) as page_view, cast(sum(orders) as double) as orders from ({WEEKLY}) t group by 1, 2
""")
def aggregate_platform(d: CheckData) -> DataFrame:
    return cp.aggregate(week_facts(d), METRICS)


@query(f"select seller_id, period, count(*) as row_count from ({WEEKLY}) t group by 1, 2 having count(*) > 1")
def duplicate_keys(d: CheckData) -> DataFrame:
    return cp.duplicate_keys(week_facts(d))
