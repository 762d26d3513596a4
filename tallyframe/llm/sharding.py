"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.scratch import settle

from .ranks import HASH_BITS, row_hash

#: Bits looked at beyond those that equal shards would need, and in each further pass.
SPARE_BITS = 3


def _prefix(value: Column, bits: Column | int) -> Column:
    if isinstance(bits, int):
        return F.shiftright(value, HASH_BITS - bits) if bits else F.lit(0).cast("long")
    return F.call_function("shiftright", value, (F.lit(HASH_BITS) - bits).cast("int"))


def directory_levels(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """The directory in parts ``(depth, cells)``: each cell of ``depth`` prefix bits
    with the number of bits of the bucket it belongs to.

    A bucket is the shortest prefix whose rows fit ``limit`` or all have one
    hash. Rows are summed once by a long prefix; only these sums are summed again
    for the shorter ones. Cells that are still too large go to another pass with
    more bits.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    done, depth = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + SPARE_BITS)
    parts: list[tuple[int, DataFrame]] = []
    while True:
        sums = (F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        leaves = rows.select(
            _prefix(F.col("hash"), depth).alias("cell"), "bytes", F.lit(1).alias("n"),
            F.col("hash").alias("lo"), F.col("hash").alias("hi"),
        ).groupBy("cell").agg(*sums)
        leaves = settle(leaves, "shard-cells")
        prefix = F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("bits")).cast("int"))
        levels = leaves.withColumn("bits", F.explode(F.sequence(F.lit(done), F.lit(depth)))).withColumn("prefix", prefix)
        fits = levels.groupBy("bits", "prefix").agg(*sums)
        fits = fits.where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("bits") == HASH_BITS))
        buckets = levels.select("cell", "bits", "prefix").join(
            fits.select("bits", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows")),
            ["bits", "prefix"],
        )
        first = F.min(F.struct("bits", "prefix", "shard_bytes", "shard_rows")).alias("b")
        buckets = settle(buckets.groupBy("cell").agg(first).select("cell", "b.*"), "shard-directory")
        parts.append((depth, buckets))
        large = leaves.join(buckets, "cell", "left_anti").select("cell")
        if depth == HASH_BITS or large.isEmpty():
            return parts
        rows = rows.withColumn("cell", _prefix(F.col("hash"), depth)).join(large, "cell", "left_semi").drop("cell")
        done, depth = depth, min(HASH_BITS, depth + SPARE_BITS)


def place(rows: DataFrame, parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (with a column ``hash``) with bits, prefix, shard_bytes and shard_rows of their bucket."""
    out = None
    for depth, buckets in parts:
        keyed = rows.withColumn("cell", _prefix(F.col("hash"), depth))
        placed = keyed.join(buckets, "cell").drop("cell")
        out = placed if out is None else out.unionByName(placed)
        rows = keyed.join(buckets.select("cell"), "cell", "left_anti").drop("cell")
    digits = F.when(F.col("bits") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("bits"), F.lit("0")))
    return out.withColumn("shard", digits)


def _sized(docs: DataFrame, text: str, doc_id: str, *extra: Column) -> DataFrame:
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")
    return docs.select(size, row_hash(doc_id, text).alias("hash"), *extra)


def assign_shards(docs: DataFrame, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, shard, shard_bytes, shard_rows, over_limit.

    ``shard`` is the bucket's hash prefix in binary digits ('' while all rows fit one
    shard). The size of a row is that of its text in UTF-8; null text has none.
    The hash covers id and text, so rows without an id spread too. Only rows
    that agree in both share all bits; a single row, or such repeated rows, over the
    limit make a shard of their own marked ``over_limit``.
    """
    rows = settle(_sized(docs, text, doc_id, F.col(doc_id).alias("doc_id")), "shard-rows")
    return place(rows, directory_levels(rows, limit)).select(
        "doc_id", "bytes", "shard", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("over_limit")
    )


def write_shards(docs: DataFrame, path: str, limit: int, text: str = "text", doc_id: str = "doc_id",
                 shard: str = "shard") -> None:
    """Writes ``docs`` with one folder ``<shard>=p<prefix>`` of Parquet files per shard."""
    parts = directory_levels(settle(_sized(docs, text, doc_id), "shard-rows"), limit)
    rows = place(_sized(docs, text, doc_id, F.struct(*(docs[c] for c in docs.columns)).alias("row")), parts)
    rows = rows.select("row.*", F.concat(F.lit("p"), "shard").alias(shard))
    rows.repartition(shard).write.partitionBy(shard).parquet(path)
