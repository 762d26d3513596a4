"""Packing documents into sequences of fixed capacity by matching and best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import job_tables, settle

from .ranks import HASH_BITS, add_ranks
from .rows import free_name
from .shipping import ship, small_batches
from .tokens import binary_slices, encoder, slices

#: Longest capacity: a plan has at most as many lengths.
MAX_CAPACITY = 1 << 16
#: Bytes of text encoded at once: what is made of them takes some ten times as much in each worker.
SLICE_BYTES = 2 << 20
#: Bits of a piece's turn that number the pieces of its document: no text has more pieces of MAX_CAPACITY or less.
PIECE_BITS = 20
TURN = "_turn"
Run = tuple[int, int, tuple[tuple[int, int], ...]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, text: str = "text",
           doc_id: str = "doc_id", carried: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (32-bit little-endian) of every document, with ``end_id`` at its end.

    Documents longer than ``capacity`` are cut into pieces of it, the last one
    may be shorter. Null text is empty: its only id is ``end_id``. Null ids and
    repeated rows are kept as they are. A column of whole numbers may be ``carried`` along.
    """
    ship(docs.sparkSession)
    more = [carried] if carried else []
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            flat, bounds = encode(batch.column("text"))
            flat = np.insert(flat, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            ends = bounds[row] + np.minimum(start + capacity, sizes[row])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(ends - bounds[row] - start, pa.int64()),
                    binary_slices(flat, np.concatenate([[0], ends])),
                    *(batch.column(c).take(pa.array(row)) for c in more),
                ],
                names=["doc_id", "piece", "start", "length", "ids", *more],
            )

    schema = "doc_id long, piece int, start long, length long, ids binary"
    return docs.mapInArrow(cut, ", ".join([schema, *(f"{c} long" for c in more)]))


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """How to fill bins with ``counts`` items of each length: runs of equal bins
    ``(bins, gap left, ((length, items in each bin), ...))``.

    Items above a third of the capacity come first: each takes the largest
    other one that fits beside it, and no bin gets a third. The smaller ones
    follow from the longest down, each into the bin with the smallest gap that
    holds it, or into a new bin. Equal lengths are handled together, so the work
    depends on the number of lengths, not of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    runs: list[Run] = []
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= min(n, capacity - n) and left[m] - (m == n) > 0), None)
            if partner is None:
                runs.append((left[n], capacity - n, ((n, 1),)))
                left[n] = 0
            elif partner == n:
                runs.append((left[n] // 2, capacity - 2 * n, ((n, 2),)))
                left[n] %= 2
            else:
                bins = min(left[n], left[partner])
                runs.append((bins, capacity - n - partner, ((n, 1), (partner, 1))))
                left[n] -= bins
                left[partner] -= bins
    gaps = sorted((gap, i) for i, (_, gap, _) in enumerate(runs))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, (n, -1))
            if at == len(gaps):
                bins, gap, held = -(-left[n] // (capacity // n)), capacity, ()
            else:
                gap, i = gaps.pop(at)
                bins, _, held = runs[i]
                runs[i] = (0, 0, ())
            fit = gap // n
            full = min(bins, left[n] // fit)
            rest = min(left[n] - full * fit, fit - 1) if full < bins else 0
            for number, items in ((full, fit), (1 if rest else 0, rest), (bins - full - bool(rest), 0)):
                if number:
                    runs.append((number, gap - items * n, held + ((n, items),) if items else held))
                    insort(gaps, (gap - items * n, len(runs) - 1))
            left[n] -= full * fit + rest
    return [run for run in runs if run[0]]


def intervals(runs: list[Run]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """For each run of bins and length: length, first and end rank of its items,
    items in a bin, first bin, offset of the first item in the bin."""
    used: dict[int, int] = {}
    first_bin = 0
    for bins, _, held in runs:
        offset = 0
        for length, items in held:
            first = used.get(length, 0)
            used[length] = first + bins * items
            yield length, first, used[length], items, first_bin, offset
            offset += length * items
        first_bin += bins


def pack(cut: DataFrame, capacity: int, order: str | None = None) -> DataFrame:
    """``cut`` (doc_id, piece, length and any more columns) with sequence_id and offset.

    Only the number of pieces of each length, ``capacity`` numbers at most, goes
    to the driver, which plans runs of equal sequences for them. The pieces of a
    length are numbered by a hash of their place in the table without meeting in one task,
    and find their run by that number, so null and repeated ids are spread like any others.
    Columns named rank, sequence_id or offset are replaced.

    ``order`` is a column that numbers the documents from 0 without large gaps. With it the
    pieces of a length are taken in its order, sequences are numbered so that theirs is the order of
    their first pieces, and the column is dropped.
    """
    if capacity > MAX_CAPACITY:
        raise ValueError(f"capacity is {MAX_CAPACITY} at most")
    spark = cut.sparkSession
    cut = cut.drop("rank", "sequence_id", "offset")
    row = free_name(cut, "_row")
    with job_tables(spark):
        # Written with a number for each row, so that only numbers and lengths are dealt
        # out for the ranks, and the rest of a row travels once.
        with small_batches(spark):
            cut = settle(cut.withColumn(row, F.monotonically_increasing_id()), "pack-pieces", lasting=True)
        counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
        # A run ends with one of at most `capacity` lengths or splits one run of bins in
        # three, so the table grows with the capacity and not with the pieces.
        table = spark.createDataFrame(
            list(intervals(plan(counts, capacity))),
            "run_length long, first_rank long, end_rank long, items long, first_bin long, first_offset long",
        )
        ranked = _in_turn(cut, row, order) if order else add_ranks(cut.select(row, "length"), ["length"], [row])
        within = (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first_rank"), F.col("end_rank") - 1)
        place = F.col("rank") - F.col("first_rank")
        placed = ranked.join(F.broadcast(table), within).select(
            row, *([TURN] if order else []),
            (F.col("first_bin") + F.floor(place / F.col("items"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + place % F.col("items") * F.col("length")).cast("long").alias("offset"),
        )
    if order:
        first = F.min(TURN).over(Window.partitionBy("sequence_id"))
        placed = placed.select(row, first.alias("sequence_id"), "offset")
        cut = cut.drop(order)
    return cut.join(placed, row).drop(row)


def _in_turn(cut: DataFrame, row: str, order: str) -> DataFrame:
    """row, length, TURN and rank of every piece: its place among those of its length by ``order`` and piece."""
    turn = F.shiftleft(F.col(order), PIECE_BITS) + F.col("piece")
    last = cut.agg(F.max(order)).first()[0] or 0
    even = F.floor(F.col(order) / F.lit(float(last + 1)) * F.lit(float((1 << HASH_BITS) - (1 << 10)))).alias("_even")
    turns = cut.select(row, "length", turn.alias(TURN), even)
    return add_ranks(turns, ["length"], [TURN], hashed="_even").drop("_even")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (32-bit little-endian), n_ids, doc_ids.
    ``packed`` must have the column ids; a sequence's pieces fit its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    ids = F.aggregate("parts.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select(
        "sequence_id", ids.alias("ids"), (F.octet_length(ids) / 4).cast("long").alias("n_ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
