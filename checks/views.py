"""Warehouse tables and platform exports derived from the driver's tables.

One SQL text per view, run unchanged by Spark and by DuckDB. Every view reads
all rows of its inputs. What makes the two sides of a comparison differ are
plain attributes of the order lines:

* lines at the highest discount never reached the warehouse,
* lines without discount were not sold on the platform,
* returned-and-billed lines were collected twice, by ``api`` and by ``crawl``,
* lines at the highest tax count one unit more on the platform,
* the item table does not cover country ``MY``,
* the SKU registry only knows SKUs that were billed at least once, and lists
  those of sellers in debt under one holding seller, which so becomes a hot key.
"""

from __future__ import annotations

import re

SELLER_CODES = """
select s_suppkey as id, concat_ws('.',
  case n_regionkey when 0 then 'TH' when 1 then 'ID' when 2 then 'PH' when 3 then 'VN' else 'MY' end,
  case s_suppkey % 3 when 0 then 'SHP' when 1 then 'LAZ' else 'TTK' end,
  cast(s_suppkey as varchar(20))) as used_id
from {supplier} join {nation} on s_nationkey = n_nationkey
"""

LINES = """
select concat_ws('.', e.used_id, cast(l_partkey as varchar(20))) as fk_sku_used_id, e.used_id as seller_full,
  e.id as sid, cast(l_shipdate as date) as day, l_linenumber, l_linestatus,
  case l_returnflag when 'A' then 'api' when 'N' then 'crawl' else null end as source,
  cast(l_quantity as decimal(18,0)) as quantity,
  cast(l_extendedprice as decimal(18,2)) as s_onsite_selling,
  cast(round(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))), 2) as decimal(18,2)) as s_net,
  cast(round(cast(l_extendedprice as decimal(18,2)) * (1 + cast(l_tax as decimal(4,2))), 2) as decimal(18,2)) as s_paid,
  cast(l_quantity * 3 + l_linenumber as bigint) as page_view,
  cast(l_discount as decimal(4,2)) as discount, cast(l_tax as decimal(4,2)) as tax
from {lineitem} join {ecommerce_seller} e on e.id = l_suppkey
"""

COLLECTED = """
select fk_sku_used_id, seller_full, day, l_linenumber, source, quantity, s_onsite_selling, s_net, s_paid, page_view
from {lines} where discount < 0.10
union all
select fk_sku_used_id, seller_full, day, l_linenumber, 'crawl' as source, quantity, s_onsite_selling, s_net, s_paid, page_view
from {lines} where discount < 0.10 and source = 'api' and l_linestatus = 'F'
"""

VIEWS = {
    "ecommerce_seller": SELLER_CODES,
    "lines": LINES,
    "collected": COLLECTED,
    "ecommerce_sku": """
select distinct fk_sku_used_id as used_id,
  case when s_acctbal < 0 then (select max(s_suppkey) from {supplier}) else s_suppkey end as fk_seller_id
from {lines} join {supplier} on s_suppkey = sid where l_linestatus = 'F'
""",
    "ecommerce_item": """
select fk_sku_used_id, case when l_linenumber = 7 then null else seller_full end as seller_used_id, day, source,
  quantity, s_paid, s_net, s_onsite_selling, cast(null as decimal(18,2)) as s_seller_selling
from {collected} where seller_full not like 'MY.%'
""",
    "ecommerce_export_sku_sales": """
select fk_sku_used_id, day, source, quantity, s_onsite_selling from {collected}
""",
    "ecommerce_export_sku_traffic": """
select fk_sku_used_id, day, source, page_view from {collected}
""",
    "ecommerce_export_seller_sales": """
select seller_full as seller, day, source, sum(quantity) as quantity, sum(s_onsite_selling) as revenue
from {collected} group by seller_full, day, source
""",
    "ecommerce_export_seller_traffic": """
select concat_ws('.', seller_full, 'shop') as fk_seller_used_id, day, source, sum(page_view) as page_view
from {collected} group by seller_full, day, source
""",
    # Platform truth per seller and day.
    "platform_day": """
select seller_full as seller_id, sid, day, sum(quantity) + sum(case when tax = 0.08 then 1 else 0 end) as quantity,
  sum(s_onsite_selling) as revenue, sum(page_view) as page_view, count(*) as orders
from {lines} where discount > 0 group by seller_full, sid, day
""",
    # A database export as one table: seller, day and totals.
    "db_day": """
select seller_full as seller_id, day, sum(quantity) as quantity, sum(s_onsite_selling) as revenue,
  sum(page_view) as page_view, count(*) as orders
from {collected} group by seller_full, day
""",
    # The same platform rows as messy exports, one file per seller: a notes sheet, a title row above the
    # header, a roll-up row over a date range, dashes for small revenue, a broken number on busy days.
    "export_grid": """
select concat('export_', used_id, '.xlsx') as file, 'Notes' as sheet, 0 as row_idx, 'Prepared for' as c0, used_id as c1,
  cast(null as varchar(40)) as c2, cast(null as varchar(40)) as c3, cast(null as varchar(40)) as c4, cast(null as varchar(40)) as c5
from {ecommerce_seller}
union all select concat('export_', used_id, '.xlsx'), 'Notes', 1, 'Contact', 'shop team', null, null, null, null from {ecommerce_seller}
union all select concat('export_', used_id, '.xlsx'), 'Key Metrics', 0, 'Report', used_id, null, null, null, null from {ecommerce_seller}
union all select concat('export_', used_id, '.xlsx'), 'Key Metrics', 2, case id % 3 when 1 then 'Day' else 'Date' end, 'Region',
  case id % 3 when 0 then 'Gross Units Sold' when 1 then 'Units  Sold' else 'Items sold' end,
  case id % 3 when 0 then 'Gross Sales (Local Currency)' when 1 then 'Net Sales' else 'GMV' end,
  case id % 3 when 0 then 'Product Views' when 1 then 'PAGE VIEWS' else 'Page views' end,
  case id % 3 when 0 then 'Gross Orders' else 'Orders' end
from {ecommerce_seller}
union all select concat('export_', seller_id, '.xlsx'), 'Key Metrics', (year(day) - 1990) * 372 + month(day) * 31 + day(day),
  case sid % 3 when 0 then concat(lpad(cast(day(day) as varchar(2)),2,'0'),'/',lpad(cast(month(day) as varchar(2)),2,'0'),'/',cast(year(day) as varchar(4)))
    when 1 then cast(day as varchar(10)) else concat(cast(year(day) as varchar(4)),'/',cast(month(day) as varchar(2)),'/',cast(day(day) as varchar(2))) end,
  'Metro', cast(quantity as varchar(40)), case when revenue < 5000 then '-' else concat('PHP ', cast(revenue as varchar(40))) end,
  case when orders > 2 then concat(cast(page_view as varchar(40)), '-', cast(orders as varchar(40))) else concat(cast(page_view as varchar(40)), '%') end,
  cast(orders as varchar(40))
from {platform_day}
union all select concat('export_', seller_id, '.xlsx'), 'Key Metrics', 100000, '01/01/1995 - 31/12/2001', 'ALL', cast(sum(quantity) as varchar(40)),
  cast(sum(revenue) as varchar(40)), cast(sum(page_view) as varchar(40)), cast(sum(orders) as varchar(40))
from {platform_day} group by seller_id
""",
    # One spec per export: SHP names its sheet, country PH reads sales from items.
    "export_specs": """
select concat('export_', used_id, '.xlsx') as file, used_id as seller_id, split_part(used_id, '.', 2) as marketplace,
  case when used_id like '%.SHP.%' then 'Key Metrics' else null end as platform_sheet,
  used_id like 'PH.%' as use_item_sales, id as position
from {ecommerce_seller}
""",
    # A database export as text cells, one file per country, with its header in row 0.
    "db_grid": """
select distinct concat('db_', split_part(used_id, '.', 1), '.csv') as file, 'db' as sheet, 0 as row_idx,
  'Seller' as c0, 'day' as c1, 'total_quantity' as c2, 'revenue_local' as c3, 'Total Page View' as c4, 'total_orders' as c5
from {ecommerce_seller}
union all select concat('db_', split_part(seller_id, '.', 1), '.csv'), 'db',
  (year(day) - 1990) * 372 + month(day) * 31 + day(day), seller_id, cast(day as varchar(10)),
  cast(quantity as varchar(40)), cast(revenue as varchar(40)), cast(page_view as varchar(40)), cast(orders as varchar(40))
from {db_day}
""",
    # Ship dates as text in seven layouts, one per line number.
    "date_cells": """
select l_linenumber as layout, cast(l_shipdate as date) as day, case l_linenumber
  when 1 then concat(lpad(cast(day(l_shipdate) as varchar(2)),2,'0'),'/',lpad(cast(month(l_shipdate) as varchar(2)),2,'0'),'/',cast(year(l_shipdate) as varchar(4)))
  when 2 then concat('  ', cast(cast(l_shipdate as date) as varchar(10)), ' 00:00:00')
  when 3 then concat(cast(year(l_shipdate) as varchar(4)),'/',cast(month(l_shipdate) as varchar(2)),'/',cast(day(l_shipdate) as varchar(2)))
  when 4 then concat(cast(month(l_shipdate) as varchar(2)),'-',cast(day(l_shipdate) as varchar(2)),'-',cast(year(l_shipdate) as varchar(4)))
  when 5 then concat(cast(day(l_shipdate) as varchar(2)),' ',substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(l_shipdate) as int) * 3 - 2, 3),' ',cast(year(l_shipdate) as varchar(4)))
  when 6 then concat(cast(year(l_shipdate) as varchar(4)),lpad(cast(month(l_shipdate) as varchar(2)),2,'0'),lpad(cast(day(l_shipdate) as varchar(2)),2,'0'))
  else concat(cast(cast(l_shipdate as date) as varchar(10)), ' - ', cast(cast(l_shipdate as date) + interval '6' day as varchar(10))) end as cell
from {lineitem}
""",
    # Prices as text in seven layouts; the value column is what a reader should get.
    "number_cells": """
select l_linenumber as layout, case
    when l_linenumber in (5, 6) then cast(0 as decimal(18,2)) when l_linenumber = 7 then null
    else cast(l_extendedprice as decimal(18,2)) end as value,
  case l_linenumber
    when 1 then cast(cast(l_extendedprice as decimal(18,2)) as varchar(40))
    when 2 then concat('PHP ', cast(cast(l_extendedprice as decimal(18,2)) as varchar(40)))
    when 3 then concat(' ', cast(cast(l_extendedprice as decimal(18,2)) as varchar(40)), ' %')
    when 4 then concat(cast(cast(floor(l_extendedprice / 1000) as bigint) as varchar(40)), ',',
      lpad(cast(cast(l_extendedprice as decimal(18,2)) - cast(floor(l_extendedprice / 1000) as bigint) * 1000 as varchar(40)), 6, '0'))
    when 5 then '-' when 6 then 'n/a'
    else concat(cast(cast(l_extendedprice as decimal(18,2)) as varchar(40)), '-') end as cell
from {lineitem}
""",
    # What is left of the platform exports after parsing: broken rows out, dashes read as 0.
    "platform_read": """
select seller_id, day, quantity, case when revenue < 5000 then 0 else revenue end as revenue, page_view, orders
from {platform_day} where orders <= 2
""",
    # Registered seller per SKU, and every seller a SKU counts for.
    "registered": """
select r.used_id as fk_sku_used_id, e.used_id as registered_seller from {ecommerce_sku} r join {ecommerce_seller} e on e.id = r.fk_seller_id
""",
    "sku_matches": """
select distinct fk_sku_used_id as sku_id, seller_full as seller_id from {collected}
union select fk_sku_used_id, registered_seller from {registered}
""",
    # Daily facts of all export flows.
    "export_facts": """
select data_type, data_level, data_type as query_source_table, seller_id, day, source, sum(quantity) as quantity,
  sum(revenue) as revenue, sum(page_view) as page_view
from (
  select 'seller_sales' as data_type, 'seller' as data_level, seller as seller_id, day,
    coalesce(source, 'NULL_SOURCE') as source, quantity, revenue, null as page_view from {ecommerce_export_seller_sales}
  union all select 'seller_traffic', 'seller', substr(fk_seller_used_id, 1, length(fk_seller_used_id) - 5), day,
    coalesce(source, 'NULL_SOURCE'), null, null, page_view from {ecommerce_export_seller_traffic}
  union all select 'sku_sales', 'sku', seller_id, day, coalesce(source, 'NULL_SOURCE'), quantity, s_onsite_selling, null
    from {collected} join {sku_matches} on sku_id = fk_sku_used_id
  union all select 'sku_traffic', 'sku', seller_id, day, coalesce(source, 'NULL_SOURCE'), null, null, page_view
    from {collected} join {sku_matches} on sku_id = fk_sku_used_id
) t group by data_type, data_level, seller_id, day, source
""",
    # Item facts by day; the marketplace of the row's own or registered seller decides the revenue column.
    "item_facts": """
select m.seller_id, day, coalesce(source, 'NULL_SOURCE') as source, sum(quantity) as quantity,
  sum(case when coalesce(case when l_linenumber = 7 then null else seller_full end, registered_seller) like '%.LAZ.%'
    then s_net else s_paid end) as revenue
from {collected} c join {sku_matches} m on m.sku_id = c.fk_sku_used_id
left join {registered} r on r.fk_sku_used_id = c.fk_sku_used_id
where seller_full not like 'MY.%' group by m.seller_id, day, coalesce(source, 'NULL_SOURCE')
""",
    # Facts under the specs' item switch: country PH takes its sales from items.
    "switched_facts": """
select data_type, data_level, query_source_table, seller_id, day, source, quantity, revenue, page_view from {export_facts}
where data_type in ('seller_traffic', 'sku_traffic') or seller_id not like 'PH.%'
union all select 'seller_sales', 'seller', 'item_seller_sales', seller_id, day, source, quantity, revenue, null
from {item_facts} where seller_id like 'PH.%'
union all select 'sku_sales', 'sku', 'item_sku_sales', seller_id, day, source, quantity, revenue, null
from {item_facts} where seller_id like 'PH.%'
""",
}
SPARK_VIEWS = set(VIEWS) - {"platform_read", "registered", "sku_matches", "export_facts", "item_facts", "switched_facts"}

_NAME = re.compile(r"\{(\w+)\}")


def inputs(text: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(text)))


def duckdb_ctes(text: str) -> str:
    """``text`` for DuckDB: the views it needs, in order, as CTEs in front."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in inputs(sql):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(text)
    body = _NAME.sub(r"\1", text).strip()
    ctes = [f"{name} as ({_NAME.sub(r'\1', VIEWS[name]).strip()})" for name in order]
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"
