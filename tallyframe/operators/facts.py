"""Daily facts by seller and source, for any number of sellers in one pass.

Each flow sums its metrics per (seller, day, source). The seller of a row is
either a column of its table or one of several ids it is listed under. The sums are
restricted to the wanted sellers by a semi-join. Spark moves it below the
aggregation, where it prunes before the shuffle, if the sellers are few enough
to broadcast; otherwise it runs on the sums. Either way a hot seller, SKU or source is
combined map-side.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEVELS, one_of
from ..functions import ids
from ..functions.dates import period_start
from ..functions.numbers import MEASURE
from ..functions.revenue import daily_item_revenue
from ..sources import warehouse as wh
from ..sources.scratch import settle, settle_laid
from ..sources.warehouse import Warehouse


@dataclass(frozen=True)
class Flow:
    name: str
    table: str
    level: str
    data_type: str
    metrics: tuple[str, ...]
    from_items: bool = False


FLOWS = {
    flow.name: flow
    for flow in (
        Flow("seller_sales", wh.SELLER_SALES, "seller", "seller_sales", ("quantity", "revenue")),
        Flow("item_seller_sales", wh.ITEM, "seller", "seller_sales", ("quantity", "revenue"), True),
        Flow("seller_traffic", wh.SELLER_TRAFFIC, "seller", "seller_traffic", ("page_view",)),
        Flow("sku_sales", wh.SKU_SALES, "sku", "sku_sales", ("quantity", "revenue")),
        Flow("item_sku_sales", wh.ITEM, "sku", "sku_sales", ("quantity", "revenue"), True),
        Flow("sku_traffic", wh.SKU_TRAFFIC, "sku", "sku_traffic", ("page_view",)),
    )
}
EXPORT_SALES = ("seller_sales", "sku_sales")
ITEM_SALES = ("item_seller_sales", "item_sku_sales")
METRICS = ("quantity", "revenue", "page_view")
FACT_COLUMNS = (
    "data_type", "data_level", "query_source_table", "seller_id", "day", "source", *METRICS,
)
FACT_SCHEMA = (
    "data_type string, data_level string, query_source_table string, seller_id string, day date, "
    f"source string, quantity {MEASURE}, revenue {MEASURE}, page_view {MEASURE}"
)
NO_SOURCE = "NULL_SOURCE"
LAID_BY = ("seller_id",)

# Columns that name the seller directly, then columns to take its prefix from.
DIRECT_KEYS = ("seller", "seller_id", "seller_used_id", "used_id")
PREFIX_KEYS = ("fk_sku_used_id", "fk_seller_used_id", "used_id")


class Sellers:
    """The sellers to report on: a Python list, or a DataFrame with ``seller_id``."""

    def __init__(self, spark: SparkSession, sellers: DataFrame | Iterable[str]):
        if not isinstance(sellers, DataFrame):
            listed = sorted({s.strip() for s in sellers if s and s.strip()})
            if not listed:
                raise ValueError("at least one seller_id is needed")
            sellers = spark.createDataFrame([(s,) for s in listed], "seller_id string")
        # Written out, so that Spark knows how many there are.
        self.frame = settle(sellers.select("seller_id").dropna().distinct(), "sellers")

    def keep(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.frame, "seller_id", "left_semi")


def seller_key(columns: Iterable[str], fallback: str | None = None, table: str = "") -> Column:
    """How a table names its seller, decided on its column names alone."""
    names = set(columns)
    for name in DIRECT_KEYS:
        if name in names:
            return F.col(name)
    if "fk_seller_used_id" in names:
        return ids.seller_prefix(F.col("fk_seller_used_id"))
    fallback = fallback or next((name for name in PREFIX_KEYS if name in names), None)
    if fallback is None:
        raise ValueError(f"no seller key in table {table}; columns: {sorted(names)}")
    return ids.seller_prefix(F.col(fallback))


def sku_owners(warehouse: Warehouse) -> DataFrame:
    """SKU id with its registered seller; duplicates in the dimensions fan out."""
    sku, seller = warehouse.table(wh.SKU), warehouse.table(wh.SELLER)
    return sku.join(seller, sku["fk_seller_id"] == seller["id"], "left").select(
        sku["used_id"].alias("fk_sku_used_id"), seller["used_id"].alias("registered_seller")
    )


def _unusual_owners(warehouse: Warehouse) -> DataFrame:
    owners = sku_owners(warehouse).where("fk_sku_used_id is not null")
    derived = F.coalesce(
        F.col("registered_seller") == ids.seller_prefix(F.col("fk_sku_used_id")), F.lit(True)
    )
    unusual = (
        owners.groupBy("fk_sku_used_id")
        .agg(F.count("*").alias("copies"), F.bool_and(derived).alias("derived"))
        .where("copies > 1 or not derived")
    )
    return settle(owners.join(unusual, "fk_sku_used_id", "left_semi"), "unusual-owners", lasting=True)


def unusual_owners(warehouse: Warehouse) -> DataFrame:
    """Registry rows that say more than the SKU id itself.

    A SKU registered once, to the seller its id begins with, changes nothing:
    that seller is found from the id. Only the other SKUs have to be joined to
    the facts. The registry is small next to the facts, so it is worth a pass
    of its own; its outcome is written out, and facts are shuffled by SKU only
    if it turns out too large to broadcast.
    """
    owners = warehouse.derived("unusual-owners", lambda: _unusual_owners(warehouse))
    unusual_prefixes(warehouse, owners)
    return owners


def _owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` joined to ``owners`` by SKU id.

    Rows without one match nothing. If the join is a shuffle they would all go to one task, so
    each gets a key of its own that no SKU has.
    """
    sku = F.col("fk_sku_used_id")
    own = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    keyed = rows.withColumn("join_key", F.coalesce(sku, own))
    named = owners.where(sku.isNotNull()).withColumnRenamed("fk_sku_used_id", "join_key")
    return keyed.join(named, "join_key", "left").drop("join_key")


def with_owner(rows: DataFrame, warehouse: Warehouse) -> DataFrame:
    """Rows with their registered seller, null where the registry has none."""
    return _owned(rows, sku_owners(warehouse))


def unusual_prefixes(warehouse: Warehouse, owners: DataFrame) -> DataFrame:
    """The prefixes of unusual SKUs, made together with these."""
    found = owners.select(ids.seller_prefix(F.col("fk_sku_used_id")).alias("sku_prefix")).distinct()
    return warehouse.derived("unusual-prefixes", lambda: settle(found, "unusual-prefixes", lasting=True))


def with_unusual_owner(rows: DataFrame, warehouse: Warehouse) -> DataFrame:
    """Rows with the registered seller if it cannot be told from the SKU id.

    There are far fewer sellers than SKUs, so Spark can broadcast the prefixes of the unusual SKUs
    long after it cannot broadcast the SKUs. Rows with another prefix pass by the join, which
    shuffles only the others if it has to.
    """
    owners = unusual_owners(warehouse)
    prefixes = unusual_prefixes(warehouse, owners)
    marked = rows.withColumn("sku_prefix", ids.seller_prefix(F.col("fk_sku_used_id")))
    usual = marked.join(prefixes, "sku_prefix", "left_anti").withColumn("registered_seller", F.lit(None).cast("string"))
    suspects = marked.join(prefixes, "sku_prefix", "left_semi")
    return usual.unionByName(_owned(suspects, owners)).drop("sku_prefix")


def items_with_owner(rows: DataFrame, warehouse: Warehouse) -> DataFrame:
    """Item rows with the owner where it matters.

    A row that names its seller has its marketplace; one that does not takes it
    from the registry, so those rows need the whole registry.
    """
    named = with_unusual_owner(rows.where("seller_used_id is not null"), warehouse)
    return named.unionByName(with_owner(rows.where("seller_used_id is null"), warehouse))


def between_days(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Closed range on the raw column, so that the scan can skip row groups."""
    return rows.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def _day_and_source(grain: str = "day") -> list[Column]:
    return [
        period_start(F.col("day").cast("date"), grain).alias("day"),
        F.coalesce("source", F.lit(NO_SOURCE)).alias("source"),
    ]


def _sums(metrics: Sequence[str]) -> list[Column]:
    return [F.sum(m).alias(m) for m in metrics]


def parts_by_seller(spark: SparkSession) -> int:
    """In how many parts flows lie if they are laid out by seller."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _summed(rows: DataFrame, metrics: Sequence[str], laid: int | None) -> DataFrame:
    """Sums by seller, day and source. With ``laid`` the rows come in so many parts by seller
    and are summed there: all further sums of a seller find them together, which are too many
    to be combined before they are shuffled again."""
    if laid:
        rows = rows.repartition(laid, *LAID_BY)
    return rows.groupBy("seller_id", "day", "source").agg(*_sums(metrics))


def direct_flow(
    warehouse: Warehouse, flow: Flow, sellers: Sellers, start: str, end: str, grain: str = "day", laid: int | None = None
) -> DataFrame:
    """Flows whose table names the seller: seller sales and seller traffic."""
    rows = between_days(warehouse.table(flow.table), start, end)
    key = seller_key(rows.columns, "fk_seller_used_id", flow.table)
    counted = rows.select(key.alias("seller_id"), *_day_and_source(grain), *flow.metrics)
    return sellers.keep(_summed(counted, flow.metrics, laid))


def matched_flow(
    warehouse: Warehouse,
    flow: Flow,
    values: dict[str, Column],
    sellers: Sellers,
    start: str,
    end: str,
    grain: str = "day",
    laid: int | None = None,
) -> DataFrame:
    """Flows by SKU: a row counts for a seller if any of its ids points to the seller.

    The ids that matter are the row's own seller, the registered seller, the
    three-segment prefix and the dot prefixes of the SKU. For most rows these are a
    handful; each row is counted under all of them, and the sums are cut to the
    wanted sellers.
    """
    owned = items_with_owner if flow.from_items else with_unusual_owner
    rows = owned(between_days(warehouse.table(flow.table), start, end), warehouse)
    sku_id = F.col("fk_sku_used_id")
    kept = [*_day_and_source(grain), *(value.alias(metric) for metric, value in values.items())]
    named = [ids.seller_prefix(sku_id).alias("prefix"), F.col("registered_seller")]
    if flow.from_items:
        named.append(F.col("seller_used_id"))
    # In steps, so that ids are taken apart once for each row. Places instead of an array of the
    # ids themselves need no loop over the segments, so that Spark can compile all of it.
    counted = rows.select(ids.parent(sku_id).alias("parent"), *named, *kept)
    parent, direct = F.col("parent"), [F.col(name) for name in counted.columns[1 : 1 + len(named)]]
    counted = counted.withColumn("place", F.explode(ids.candidate_places(direct, parent)))
    seller = ids.seller_candidate(F.col("place"), direct, parent)
    counted = counted.select(seller.alias("seller_id"), "day", "source", *values).where("seller_id is not null")
    return sellers.keep(_summed(counted, list(values), laid))


def flow_sums(
    warehouse: Warehouse, name: str, sellers: Sellers, start: str, end: str, grain: str = "day", laid: int | None = None
) -> DataFrame:
    """Sums of one flow: ``seller_id, day, source`` and the metrics the flow has. With a
    longer ``grain`` the day is the first one of its week or month. With ``laid`` they come
    in so many parts by seller."""
    flow = FLOWS[name]
    if flow.level == "seller" and not flow.from_items:
        return direct_flow(warehouse, flow, sellers, start, end, grain, laid)
    if flow.from_items:
        owner = F.coalesce("seller_used_id", "registered_seller")
        values = {
            "quantity": F.col("quantity"),
            "revenue": daily_item_revenue(ids.segment(owner, 2)),
        }
    elif name == "sku_sales":
        values = {"quantity": F.col("quantity"), "revenue": F.col("s_onsite_selling")}
    else:
        values = {"page_view": F.col("page_view")}
    return matched_flow(warehouse, flow, values, sellers, start, end, grain, laid)


def labelled(sums: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """Add the label columns; sums shared by several flows are repeated per flow."""
    metrics = [
        (F.col(m) if m in sums.columns else F.lit(None)).cast(MEASURE).alias(m)
        for m in METRICS
    ]
    if len(flows) == 1:
        names = {"data_type": flows[0].data_type, "data_level": flows[0].level, "query_source_table": flows[0].name}
        return sums.select(
            *(F.lit(v).alias(k) for k, v in names.items()), "seller_id", "day", "source", *metrics
        )
    label = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(f.data_type).alias("data_type"),
                    F.lit(f.level).alias("data_level"),
                    F.lit(f.name).alias("query_source_table"),
                )
                for f in flows
            )
        )
    )
    return sums.select(label.alias("label"), "seller_id", "day", "source", *metrics).select(
        "label.*", "seller_id", "day", "source", *METRICS
    )


def choose_flows(
    level: str | None = "both", use_items: bool = False, names: Iterable[str] | None = None
) -> list[str]:
    """Flow names for a level and an item switch, unless they are given by name."""
    if names:
        wanted = {one_of(name, FLOWS, "query flow") for name in names}
        return [name for name in FLOWS if name in wanted]
    level = one_of(level, LEVELS, "level", "both")
    skipped = EXPORT_SALES if use_items else ITEM_SALES
    return [
        name for name, flow in FLOWS.items() if name not in skipped and level in ("both", flow.level)
    ]


def facts_of(
    warehouse: Warehouse,
    spark: SparkSession,
    names: Sequence[str],
    sellers: Sellers,
    start: str,
    end: str,
    errors: dict[str, str] | None = None,
    grain: str = "day",
    laid: int | None = None,
) -> DataFrame:
    """The union of the named flows in the fixed nine-column layout.

    With ``errors``, a flow whose table cannot be resolved is recorded there
    and left out; the other flows go on.
    """
    groups = [[n] for n in names if not FLOWS[n].from_items]
    groups.append([n for n in names if FLOWS[n].from_items])
    parts = []
    for group in filter(None, groups):
        try:
            sums = flow_sums(warehouse, group[0], sellers, start, end, grain, laid)
            parts.append(labelled(sums, [FLOWS[n] for n in group]))
        except Exception as problem:
            if errors is None:
                raise
            errors.update({n: str(problem).splitlines()[0] for n in group})
    if not parts:
        return spark.createDataFrame([], FACT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def settled_flows(
    warehouse: Warehouse,
    spark: SparkSession,
    names: Sequence[str],
    sellers: Sellers,
    start: str,
    end: str,
    errors: dict[str, str],
    laid: int | None = None,
) -> dict[str, DataFrame]:
    """The named flows, written out one by one: one that fails while it is planned or
    read is recorded in ``errors`` and left out, and the others go on.

    With ``laid`` each lies in so many parts by seller, so that sums for a seller need no shuffle.
    """
    written = {}
    for name in names:
        try:
            found = facts_of(warehouse, spark, [name], sellers, start, end, laid=laid)
            written[name] = settle_laid(found, f"facts-{name}", laid, LAID_BY) if laid else settle(found, f"facts-{name}")
        except Exception as problem:
            errors[name] = str(problem).strip().splitlines()[0]
    return written


def facts(
    warehouse: Warehouse,
    spark: SparkSession,
    sellers: DataFrame | Iterable[str],
    start: str,
    end: str,
    level: str | None = "both",
    use_items: bool = False,
    names: Iterable[str] | None = None,
    errors: dict[str, str] | None = None,
    grain: str = "day",
    laid: int | None = None,
) -> DataFrame:
    """Facts of all sellers under one item switch, summed by day or by a longer ``grain``."""
    chosen = choose_flows(level, use_items, names)
    return facts_of(warehouse, spark, chosen, Sellers(spark, sellers), start, end, errors, grain, laid)


def facts_by_switch(
    warehouse: Warehouse,
    jobs: DataFrame,
    start: str,
    end: str,
    level: str | None = "both",
    errors: dict[str, str] | None = None,
    laid: int | None = None,
) -> DataFrame:
    """Facts of ``jobs(seller_id, use_item_sales)``: each seller under its own switch.

    A seller listed under both switches keeps both sales flows; its traffic is
    counted once.
    """
    return reduce(
        DataFrame.unionByName,
        [
            facts_of(
                warehouse, jobs.sparkSession, names, Sellers(jobs.sparkSession, sellers), start, end, errors, laid=laid
            )
            for sellers, names in switch_plan(jobs, level)
        ],
    )


def settled_by_switch(
    warehouse: Warehouse, jobs: DataFrame, start: str, end: str, level: str | None, errors: dict[str, str]
) -> list[DataFrame]:
    """As ``facts_by_switch``, written out flow by flow. Each has one row for a seller, day and source."""
    spark = jobs.sparkSession
    flows: list[DataFrame] = []
    for sellers, names in switch_plan(jobs, level):
        flows += settled_flows(warehouse, spark, names, Sellers(spark, sellers), start, end, errors).values()
    return flows or [spark.createDataFrame([], FACT_SCHEMA)]


def switch_plan(jobs: DataFrame, level: str | None = "both") -> list[tuple[DataFrame, list[str]]]:
    """Which flows to run for which of ``jobs``."""
    jobs = jobs.where("trim(coalesce(seller_id, '')) <> ''")
    traffic = [n for n in choose_flows(level) if n not in EXPORT_SALES]
    return [
        (jobs, traffic),
        (jobs.where("not use_item_sales"), [n for n in choose_flows(level) if n in EXPORT_SALES]),
        (jobs.where("use_item_sales"), [n for n in choose_flows(level, True) if n in ITEM_SALES]),
    ]
