"""Row numbers within groups of any size, without a group meeting in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 256


#: Bits of ``row_hash``.
HASH_BITS = 60


def row_hash(doc_id: str, text: str) -> Column:
    """60 bits of the MD5 of id and text, as a number: rows without an id differ by their text."""
    key = F.concat_ws(":", F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def add_ranks(df: DataFrame, group: list[str], identity: list[str], hashed: str | None = None,
              rank: str = "rank") -> DataFrame:
    """Numbers the rows of each group from 0 in the order of a hash of ``identity``, or
    of the column ``hashed`` that has HASH_BITS even bits, and then of ``identity``.

    The hash's leading bits cut every group into buckets of some hundred rows.
    Buckets are counted, the counts are summed up in two levels, and each row's
    number is its bucket's start plus its place in the bucket. ``df`` is read
    three times, so it should be a table. Null groups are groups of their own;
    rows with equal ``identity`` follow each other in any order.
    """
    bits = max(0, math.ceil(math.log2(max(1, df.count()) / ROWS_A_BUCKET)))
    low = bits // 2
    even = F.col(hashed) if hashed else F.shiftrightunsigned(F.xxhash64(*identity), 64 - HASH_BITS)
    keyed = df.withColumn("_hash", even).withColumn("_bucket", _top_bits(F.col("_hash"), bits))
    keyed = keyed.withColumns({f"_g{i}": F.col(name) for i, name in enumerate(group)})
    keys = [f"_g{i}" for i in range(len(group))]
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_block", F.shiftright("_bucket", low))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = before.partitionBy(*keys, "_block").orderBy("_bucket")
    across = before.partitionBy(*keys).orderBy("_block")
    blocks = counts.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n"))
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_block_start"))
    starts = counts.select(*keys, "_block", "_bucket", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_in_block"))
    starts = _join_nulls(starts, blocks, [*keys, "_block"])
    starts = starts.select(*keys, "_bucket", (F.col("_block_start") + F.col("_in_block")).alias("_start"))
    joined = _join_nulls(keyed, starts, [*keys, "_bucket"])
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", *identity))
    return joined.withColumn(rank, F.col("_start") + place - 1).select(*df.columns, rank)


def _top_bits(value: Column, bits: int) -> Column:
    return F.shiftright(value, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def _join_nulls(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys are equal; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    condition = [left[k].eqNullSafe(right[f"{k}_r"]) for k in keys]
    return left.join(right, condition).drop(*(f"{k}_r" for k in keys))
