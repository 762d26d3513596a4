"""Token ids in files: concatenated ids with Elias-Fano coded document ends.

A file set is a Parquet folder, so any store that Spark writes to can hold it. Each
of its rows is one block of documents in ascending order:

    part, block   place of the block in the order of the set
    doc_ids       ids of the documents
    n_ids         number of token ids
    ends          where each document ends, see EliasFano
    ids           the token ids, 16 bits each if the vocabulary allows it, else 32
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import settle

from .shipping import ship
from .tokens import binary_slices, encoder, slices

#: Ids and documents after which a block ends.
BLOCK_IDS, BLOCK_DOCS = 2 << 20, 1 << 16
FILE_SCHEMA = "part int, block int, doc_ids array<bigint>, n_ids long, width int, ends binary, ids binary"


class EliasFano:
    """A rising sequence of n numbers up to u in about n (2 + log2(u / n)) bits.

    The low bits of each number stand side by side. The high bits stand in unary: number i with
    high part h sets bit h + i. ``select`` finds that bit from the sampled place
    of every 64th one, so a single number is read without decoding the rest.
    """

    SAMPLE = 64
    _HEAD = struct.Struct("<IQBI")

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits.astype(np.uint8), bitorder="little")
        return cls(n, top, low_bits, pack(low.ravel()), pack(high), ones[:: cls.SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = self._HEAD.pack(self.n, self.top, self.low_bits, len(self.high))
        return head + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, low_bits, high_bytes = cls._HEAD.unpack_from(data)
        samples = np.frombuffer(data, np.uint32, -(-n // cls.SAMPLE), cls._HEAD.size)
        at = cls._HEAD.size + samples.nbytes
        high = np.frombuffer(data, np.uint8, high_bytes, at)
        return cls(n, top, low_bits, np.frombuffer(data, np.uint8, offset=at + high_bytes), high, samples)

    def _low(self, first: int, count: int) -> np.ndarray:
        start = first * self.low_bits
        byte, skip = divmod(start, 8)
        stop = -(-(start + count * self.low_bits) // 8)
        bits = np.unpackbits(self.low[byte:stop], bitorder="little")[skip : skip + count * self.low_bits]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        sample, left = divmod(i, self.SAMPLE)
        byte, skip = divmod(int(self.samples[sample]), 8)
        step = 32
        ones = np.zeros(0, np.int64)
        while len(ones) <= left:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + step], bitorder="little")[skip:]) + skip
            step *= 4
        high = 8 * byte + int(ones[left]) - i
        return high << self.low_bits | int(self._low(i, 1)[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (ones - np.arange(self.n)) << self.low_bits | self._low(0, self.n)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text",
                      doc_id: str = "doc_id") -> None:
    """Encodes every document, ends it with ``end_id`` and writes the file set.

    Documents are dealt out by ranges of doc_id before they are encoded, so that
    the ranges are found without tokenizing. Null ids come first; rows with equal ids
    follow each other in the order of a hash of their text. Null text is empty.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    rising = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        width = 2 if max(words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                            ("n_ids", pa.int64()), ("width", pa.int32()), ("ends", pa.binary()), ("ids", pa.binary())])
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate([sizes for _, sizes, _ in held]))
            flat = np.concatenate([ids for _, _, ids in held])
            row = {"part": part, "block": block, "doc_ids": [d for names, _, _ in held for d in names],
                   "n_ids": len(flat), "width": width, "ends": EliasFano.encode(ends).to_bytes(),
                   "ids": flat.astype(f"<u{width}").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in (piece for whole in batches for piece in slices(whole, "text", 4 << 20)):
            flat, bounds = words.encode(batch.column("text"))
            flat = np.insert(flat, bounds[1:], np.uint32(end_id))
            held.append((batch.column("doc_id").to_pylist(), np.diff(bounds) + 1, flat))
            if sum(len(ids) for _, _, ids in held) >= BLOCK_IDS or sum(len(names) for names, _, _ in held) >= BLOCK_DOCS:
                yield close()
                block, held = block + 1, []
        if held:
            yield close()

    rising.mapInArrow(blocks, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (32-bit little-endian) of every document of a file set.

    ``start`` counts the ids of all documents before. Blocks are read in any
    order; only their id counts are summed up across blocks, part by part.
    """
    ship(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                bounds = np.concatenate([[0], EliasFano.from_bytes(row["ends"]).all()])
                n = len(row["doc_ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)),
                     binary_slices(ids, bounds)],
                    names=["part", "block", "doc_id", "start", "n_tokens", "ids"],
                )

    rows = files.select("part", "block", "doc_ids", "width", "ends", "ids").mapInArrow(
        documents, "part int, block int, doc_id long, start long, n_tokens long, ids binary"
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    counts = files.select("part", "block", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    in_part = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("block")), F.lit(0))
    # A row for each block, written so that its size is known: while it is small the ids stay where they are read.
    starts = settle(counts.select("part", "block", in_part.alias("in_part")).join(parts, "part"), "token-starts")
    return rows.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("in_part") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document, its place in the block found by two ``select`` calls."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    found = files.where(F.array_contains("doc_ids", doc_id)).limit(1).collect()
    if not found:
        return None
    row = found[0]
    at, ends = row["doc_ids"].index(doc_id), EliasFano.from_bytes(bytes(row["ends"]))
    start = ends.select(at - 1) if at else 0
    return np.frombuffer(bytes(row["ids"]), f"<u{row['width']}")[start : ends.select(at)].tolist()
