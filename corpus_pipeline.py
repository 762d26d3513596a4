"""A corpus from raw documents to packed sequences, in stages over tables.

Every stage reads the table its predecessor wrote and works on all of its
rows. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, language_id, mixing, near_dedup, packing
from tallyframe.llm.queries import PACK_END, SEQUENCE_LENGTH, tokenizer_path
from tallyframe.llm.rows import free_name, in_order, numbered
from tallyframe.sources.scratch import job_tables, new_folder, remove, settle

#: No source gets more than this share of the mix before the others run out; shares are
#: counted in so many parts.
MAX_SHARE, SHARE_PARTS = 0.25, 1000
BLOCK_ROWS = 32


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are like no language of the labelled ones, or have no letter.
    The model is fitted on the labelled rows of the stage's own input; if there are none,
    only documents without a letter go. Rows are judged by their texts alone."""
    return language_id.drop_unrecognised(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest text, then the
    smallest id, rows without an id last, then any one of repeated rows."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates one row stays: the smallest id, rows without one last, then any
    one of repeated rows. Blank texts all stay."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Interleaves the sources in proportion to their rows, with at most MAX_SHARE for
    each as long as the others last, and returns all rows in the order of the mix. What a
    source has left when the others have run out comes at the tail; no row goes. Each row has
    a place of its own, whatever its id."""
    row, place = free_name(docs, "_row"), free_name(docs, "_place")
    with job_tables(spark):
        rows = numbered(docs, row)
        shares, _ = mixing.capped_shares(docs, MAX_SHARE, SHARE_PARTS)
        mixed = mixing.mix(rows, shares, BLOCK_ROWS, row=row)
        order = settle(mixed.select(row, F.struct("slot", "place").alias(place)), "pipeline-mix", lasting=True)
    placed = rows.join(order, row).repartitionByRange(place).sortWithinPartitions(place)
    return placed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequence and place in it, and their ids. Of pieces of one
    length those that come first in the mix are packed first, and sequences are numbered in the
    order in which their first pieces come, so that the order of the mix is that of the corpus."""
    cut = packing.pieces(in_order(docs, "mix_place"), tokenizer_path(), SEQUENCE_LENGTH, PACK_END, carried="mix_place")
    return packing.pack(cut, SEQUENCE_LENGTH, order="mix_place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Whatever a stage has read or written for itself is removed
    as soon as its result is written, so only the last result is left."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        after = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        # Twice: what a stage makes to outlast the job it is made in ends with the outer one.
        with job_tables(spark), job_tables(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(after)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(after), after
    return docs
