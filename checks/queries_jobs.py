"""Whole jobs, report table by report table, and files as users have them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import sheets as sh
from tallyframe.plans.batch import run_batch
from tallyframe.plans.bundle import Bundle
from tallyframe.plans.direct import run_direct
from tallyframe.plans.ingest import ingest
from tallyframe.plans.monthly import run_monthly, run_single_month
from tallyframe.sources.delimited import read_delimited
from tallyframe.sources.files import guess_specs
from tallyframe.sources.scratch import new_folder

from .data import CheckData
from .queries_ingest import column_mapping as _mapping
from .queries_ingest import quarantine as _quarantine
from .queries_warehouse import COMPANY, MONTHLY, PREFIX, SUMMARY, SWITCHED_AUDIT, TEMPLATE, TEXT_MONTH, audit_sql
from .queries_warehouse import direct_by_day as _by_day
from .queries_warehouse import direct_by_source as _by_source
from .queries_warehouse import direct_preview as _preview
from .queries_warehouse import direct_query as _direct
from .queries_warehouse import direct_totals as _totals
from .registry import CUTOVER, END, FIRST_MONTH, LAST_MONTH, QUERIES, START, query

# A job runs once per session and folder; its tables are checked one by one.
_BUNDLES: dict[tuple[str, str, str], Bundle] = {}


def _bundle(d: CheckData, name: str, run: Callable[[str], Bundle]) -> Bundle:
    key = (d.spark.sparkContext.applicationId, d.sf_dir, name)
    if key not in _BUNDLES:
        _BUNDLES[key] = run(new_folder(d.spark, name, lasting=True))
    return _BUNDLES[key]


def _sql_of(build) -> str:
    return QUERIES[build.__name__].sql


def _batch(d: CheckData) -> Bundle:
    return _bundle(d, "batch", lambda f: run_batch(d.warehouse, d.grid, d.specs, START, END, f))


@query(_sql_of(_mapping))
def batch_column_mapping(d: CheckData) -> DataFrame:
    return _batch(d).table("Column_Mapping")


@query(_sql_of(_quarantine))
def batch_errors(d: CheckData) -> DataFrame:
    return _batch(d).table("Errors").withColumn("row_idx", F.col("row_idx").cast("bigint"))


@query(SWITCHED_AUDIT)
def batch_audit(d: CheckData) -> DataFrame:
    return _batch(d).table("DB_Query_Debug")


def _direct_job(d: CheckData) -> Bundle:
    return _bundle(d, "direct", lambda f: run_direct(d.warehouse, d.spark, d.sellers, START, END, f))


@query(_sql_of(_direct))
def direct_job_rows(d: CheckData) -> DataFrame:
    return _direct_job(d).table("Raw_By_Source")


@query(_sql_of(_by_day))
def direct_job_by_day(d: CheckData) -> DataFrame:
    return _direct_job(d).table("By_Day")


@query(_sql_of(_by_source))
def direct_job_by_source(d: CheckData) -> DataFrame:
    return _direct_job(d).table("By_Source")


@query(_sql_of(_totals))
def direct_job_totals(d: CheckData) -> DataFrame:
    return _direct_job(d).table("Totals")


@query(_sql_of(_preview))
def direct_job_preview(d: CheckData) -> DataFrame:
    return _direct_job(d).table("By_Day_Preview")


@query(audit_sql("select used_id as seller_id, false as use_item_sales from {ecommerce_seller}", "export_facts",
                 "l.q not like 'item%'"))
def direct_job_audit(d: CheckData) -> DataFrame:
    return _direct_job(d).table("DB_Query_Debug")


def _monthly_job(d: CheckData) -> Bundle:
    cutover = date.fromisoformat(CUTOVER)
    return _bundle(d, "monthly", lambda f: run_monthly(
        d.warehouse, d.spark, d.sellers, FIRST_MONTH, f, company=COMPANY, last_month=LAST_MONTH, cutover=cutover
    ))


@query(f"{MONTHLY} select {TEXT_MONTH} from monthly")
def monthly_job_rows(d: CheckData) -> DataFrame:
    return _monthly_job(d).table("Monthly_Check").drop("query_date")


@query(SUMMARY)
def monthly_job_summary(d: CheckData) -> DataFrame:
    return _monthly_job(d).table("Summary")


def _single(d: CheckData, kind: str, template: str) -> DataFrame:
    name = "ecommerce_export_sku_traffic"
    return _bundle(d, kind, lambda f: run_single_month(
        template, d.sellers, kind, "1998-07-01", {name: d.table(name)}, f, client=COMPANY, args={"label": kind}
    )).table(f"Check_{kind.title()}")


_SINGLE = f"""select '{COMPANY}' as company, {PREFIX.format("fk_sku_used_id")} as seller_id,
  count(distinct fk_sku_used_id) as skus, count(*) as n, '{{}}' as label from {{{{ecommerce_export_sku_traffic}}}} where {{}} group by 2"""


@query(_SINGLE.format("content", "day >= date '1998-07-01' and day < date '1998-08-01'"))
def single_month_content(d: CheckData) -> DataFrame:
    return _single(d, "content", TEMPLATE)


@query(_SINGLE.format("media", "day < date '1998-07-01'"))
def single_month_media(d: CheckData) -> DataFrame:
    # The media window starts at a fixed day after all of this data, so the template only uses its other end.
    media = TEMPLATE.replace("t.day >= p.start_date and t.day < p.end_date", "t.day < p.tracking_month")
    return _single(d, "media", media)


# Files

@query("select doc_id, md5(text) as text_md5, length(text) as n_chars from {documents} where text is not null")
def scan_csv_quoted(d: CheckData) -> DataFrame:
    """Whole documents, most with line breaks, commas or quotes, through CSV files."""
    folder = new_folder(d.spark, "documents-csv")
    rows = d.table("documents").where("text is not null").select("doc_id", "text")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(folder)
    found = read_delimited(d.spark, [folder]).where("row_idx > 0")
    text = F.get("cells", F.lit(1))
    return found.select(
        F.get("cells", F.lit(0)).cast("bigint").alias("doc_id"), F.md5(text).alias("text_md5"), F.length(text).alias("n_chars")
    )


@query(r"""
with t as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as text, regexp_replace(text, '[\x00-\x1F",]', ' ', 'g') as bare
           from {documents} where text is not null),
c as (select doc_id, case doc_id % 4 when 0 then text when 1 then concat('5" ', bare) when 2 then concat('q', text, '"', 'x"y')
        else concat('x', chr(10), '2" ', text) end as cell,
        case doc_id % 4 when 3 then concat('7" ', chr(10), doc_id) else cast(doc_id as varchar) end as last_cell from t)
select doc_id, md5(cell) as cell_md5, length(cell) as n_chars, last_cell from c
""")
def scan_csv_layouts(d: CheckData) -> DataFrame:
    """Whole documents with quotes that open a cell, stand within one, are doubled or follow a
    closing one, and with line breaks in cells, row by row in another layout."""
    folder = new_folder(d.spark, "documents-layouts")
    doubled = F.replace("text", F.lit('"'), F.lit('""'))
    bare = F.regexp_replace("text", r'[\x00-\x1F",]', " ")
    layouts = (
        F.format_string('%d,"%s",%d', "doc_id", doubled, "doc_id"),
        F.format_string('%d,5" %s,%d', "doc_id", bare, "doc_id"),
        F.format_string('%d,"q%s"""x"y,%d', "doc_id", doubled, "doc_id"),
        F.format_string('%d,"x\n2"" %s","7"" \n%d"', "doc_id", doubled, "doc_id"),
    )
    line = F.coalesce(*(F.when(F.col("doc_id") % 4 == k, text) for k, text in enumerate(layouts)))
    d.table("documents").where("text is not null").select(line.alias("value")).write.text(folder)
    # Spark's text files are renamed, as those of a user end in .csv; the first row of each is its header.
    files = d.spark.read.format("binaryFile").load(folder).select("path").collect()
    hadoop = d.spark._jvm.org.apache.hadoop.fs
    for old in (hadoop.Path(r["path"]) for r in files):
        old.getFileSystem(d.spark.sparkContext._jsc.hadoopConfiguration()).rename(old, old.suffix(".csv"))
    cell = F.get("cells", F.lit(1))
    return read_delimited(d.spark, [folder]).select(
        F.get("cells", F.lit(0)).cast("bigint").alias("doc_id"), F.md5(cell).alias("cell_md5"), F.length(cell).alias("n_chars"),
        F.get("cells", F.lit(2)).alias("last_cell"),
    )


@query("""select concat(split_part(seller_id, '.', 1), '.ALL') as seller_id, cast(day as varchar) as period, count(*) as n,
  cast(sum(quantity) as double) as quantity from {db_day} group by 1, 2""")
def same_name_files(d: CheckData) -> DataFrame:
    """A file of each task for each country: the same names in folders of their own."""
    folder = new_folder(d.spark, "same-names")
    rows = d.table("db_day").select(
        F.split_part("seller_id", F.lit("."), F.lit(1)).alias("country"), "day", F.col("quantity").alias("total_quantity")
    )
    # Dealt out in turn, so that every task has rows of every country.
    rows.repartition(max(2, d.spark.sparkContext.defaultParallelism)).write.partitionBy("country").option("header", True).csv(folder)
    grid = read_delimited(d.spark, [folder])
    country = F.regexp_extract("file", "country=([^/]+)/", 1)
    specs = sh.db_specs(guess_specs(grid)).withColumn("seller_id", F.concat(country, F.lit(".ALL")))
    facts = ingest(grid, specs, "day").facts
    return facts.groupBy("seller_id", "period").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("""select concat(split_part(seller_id, '.', 1), tail) as seller_id, count(*) as n, cast(sum(quantity) as double) as quantity
from {db_day} cross join (values ('.A'), ('.B')) t(tail) group by 1""")
def many_specs_one_file(d: CheckData) -> DataFrame:
    """Two specs for every file: its rows count for both of their sellers."""
    tail = F.explode(F.array(F.struct(F.lit(".A").alias("tail"), F.lit(0).alias("second")),
                             F.struct(F.lit(".B").alias("tail"), F.lit(1).alias("second"))))
    specs = sh.db_specs(guess_specs(d.db_grid)).withColumn("t", tail)
    specs = specs.withColumns({
        "seller_id": F.concat(F.regexp_extract("file", "db_(..)", 1), "t.tail"), "position": F.col("t.second").cast("bigint"),
    }).drop("t")
    facts = ingest(d.db_grid, specs, "day").facts
    return facts.groupBy("seller_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
