"""Interleaving sources to target weights by Pfair windows and earliest deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import job_tables, settle

from .ranks import add_ranks, row_hash

#: Longest period of a schedule, that is the sum of all shares.
MAX_PERIOD = 20_000
#: The pool of all sources without a share of their own.
REST = "(rest)"


def schedule(spark: SparkSession, shares: dict[str, int]) -> DataFrame:
    """One period of slots: pool, turn (the pool's blocks from 0), slot.

    With W slots in a period, block j of a pool with share w is released at slot
    floor(j W / w) and due by slot ceil((j + 1) W / w). Each slot goes to the released
    block with the earliest deadline, then to the first pool. The shares fill
    the period, so every block runs in its window, and after any number of
    slots a pool has had less than one block more or less than its share.
    """
    pools = sorted(name for name, share in shares.items() if share > 0)
    period = sum(shares[name] for name in pools)
    if not 0 < period <= MAX_PERIOD:
        raise ValueError(f"shares must sum to 1 up to {MAX_PERIOD}, not {period}")
    share = F.array(*(F.lit(shares[name]).cast("long") for name in pools))

    def step(state: Column, t: Column) -> Column:
        windows = F.transform(
            state["done"],
            lambda n, i: F.struct(
                F.ceil((n + 1) * period / F.get(share, i)).alias("due"), i.alias("pool"),
                F.floor(n * period / F.get(share, i)).alias("release"),
            ),
        )
        pick = F.array_min(F.filter(windows, lambda w: w["release"] <= t))["pool"]
        done = F.transform(state["done"], lambda n, i: n + F.when(i == pick, 1).otherwise(0).cast("long"))
        return F.struct(done.alias("done"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), len(pools)).alias("done"), F.array().cast("array<int>").alias("picks")
    )
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda s: s["picks"])
    slots = spark.range(1).select(F.posexplode(picks).alias("slot", "pool_index"))
    names = F.array(*(F.lit(name) for name in pools))
    turn = F.row_number().over(Window.partitionBy("pool_index").orderBy("slot")) - 1
    return slots.select(F.get(names, F.col("pool_index")).alias("pool"), turn.alias("turn"), F.col("slot").cast("long").alias("slot"))


def pool_of(source: Column, shares: dict[str, int]) -> Column:
    own = [name for name in shares if name != REST]
    return F.when(source.isin(own), source).otherwise(F.lit(REST)) if own else F.lit(REST)


def mix(docs: DataFrame, shares: dict[str, int], block_rows: int, source: str = "source", doc_id: str = "doc_id",
        text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, pool, block, place, slot, in_mix.

    ``shares`` are whole numbers; sources that are not named, null ones among
    them, share the pool ``REST`` (share 1 unless given). The rows of a pool are put
    in the order of a hash of id and text and cut into blocks of ``block_rows``.
    ``slot`` is the block's turn in the mix and ``place`` the row's place in the
    block: sorted by both, the rows are interleaved. The mix holds its weights
    until the first pool that has rows runs out; ``in_mix`` says which rows come
    before. Pools without rows leave their slots empty. Repeated rows take a place each,
    and rows without an id are told apart by their texts. Null text counts as empty. The
    column ``row``, if given, is returned as it is.
    """
    with job_tables(docs.sparkSession):
        return _mixed(docs, {REST: 1} | shares, block_rows, source, doc_id, text, [row] if row else [])


def _mixed(docs: DataFrame, shares: dict[str, int], block_rows: int, source: str, doc_id: str, text: str,
           carried: list[str]) -> DataFrame:
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), pool_of(F.col(source), shares).alias("pool"),
        row_hash(doc_id, text).alias("hash"), *carried,
    )
    ranked = add_ranks(settle(rows, "mix-rows"), ["pool"], ["doc_id"], "hash")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows))
    table = settle(schedule(docs.sparkSession, shares), "mix-schedule")
    period = sum(v for v in shares.values() if v > 0)
    own = F.create_map(*(F.lit(x) for name, v in shares.items() if v > 0 for x in (name, v)))
    ranked = ranked.withColumn("share", F.try_element_at(own, F.col("pool")))
    ranked = ranked.withColumn("turn", F.col("block") % F.col("share"))
    # The schedule has one row for each slot of a period: MAX_PERIOD rows at most.
    placed = ranked.join(F.broadcast(table), ["pool", "turn"], "left")
    slot = F.floor(F.col("block") / F.col("share")) * period + F.col("slot")
    placed = settle(placed.select(
        "doc_id", "source", "pool", "block", (F.col("rank") % block_rows).alias("place"), slot.alias("slot"), *carried
    ), "mix-placed", lasting=True)
    ends = placed.groupBy("pool").agg(F.max("block").alias("last")).withColumn("next", F.col("last") + 1)
    ends = ends.withColumn("share", F.try_element_at(own, F.col("pool"))).withColumn("turn", F.col("next") % F.col("share"))
    ends = ends.join(F.broadcast(table), ["pool", "turn"])
    horizon = ends.agg(F.min(F.floor(F.col("next") / F.col("share")) * period + F.col("slot"))).first()[0]
    return placed.withColumn("in_mix", F.coalesce(F.col("slot") < F.lit(horizon), F.lit(False)))


def ordered(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix, over partitions and within them."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")


def capped_shares(docs: DataFrame, max_share: float, parts: int, source: str = "source") -> tuple[dict[str, int], set[str]]:
    """Shares in proportion to the rows of each source, except that none gets more
    than ``max_share`` of the mix; and the sources this holds back. As that raises the
    shares of the others, sources of a smaller size may be held back too. Sources below one of
    ``parts`` go to the rest, so that at most ``parts`` sources are brought to the driver."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    total = docs.count()
    named = counts.where(F.col("source").isNotNull() & (F.col("n") * parts >= total)).collect()
    sizes = {r["source"]: r["n"] for r in named}
    sizes |= {REST: total - sum(sizes.values())}
    capped: set[str] = set()
    # Capping one source raises the others' shares, so look again until none is above.
    while len(capped) * max_share < 1:
        free = sum(n for s, n in sizes.items() if s not in capped)
        room = 1 - len(capped) * max_share
        over = {s for s, n in sizes.items() if s not in capped and free and n / free * room > max_share}
        if not over:
            break
        capped |= over
    free, room = sum(n for s, n in sizes.items() if s not in capped), max(0.0, 1 - len(capped) * max_share)
    weight = {s: max_share if s in capped else (n / free * room if free else 0) for s, n in sizes.items()}
    return {s: max(1, round(w * parts)) for s, w in weight.items() if sizes[s]}, capped
