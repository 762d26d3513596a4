"""Exact duplicates by a 128-bit hash of the text without white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.scratch import job_tables, settle

from .rows import free_name, numbered

#: White space of the text comparison: space and the controls from tab to carriage return.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", content_hash=F.md5,
                 row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes without white space. They are
    grouped by a 128-bit hash and by those bytes, so that a collision of hashes
    makes two groups. Copies are counted where they are read, and only one of
    each text travels. Of a group one row stays: among those with an id (among all, if
    none has one) the longest original text, then the smallest id, then the smallest
    row number, which decides between repeated rows and rows without an id.

    Null text counts as empty. ``row`` names a column of distinct whole numbers and is
    returned as it is; without it the rows are numbered here. Any other columns of
    ``docs`` are not looked at.
    """
    carried = [row] if row else []
    row = row or free_name(docs, "_row")
    if not carried:
        docs = numbered(docs, row)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
        squeezed(F.col(text)).alias("bytes"),
        F.col(row).alias("row"),
    )
    rows = rows.withColumn("hash", content_hash("bytes"))
    order = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), (-F.col("n_chars")).alias("chars"), "doc_id", "row"
    )
    groups = rows.groupBy("hash", "bytes").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    groups = groups.select(
        "hash", F.sha2("bytes", 256).alias("text_sha256"), "group_size",
        F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"),
    )
    members = rows.select("doc_id", "row", "hash", F.sha2("bytes", 256).alias("text_sha256"))
    return members.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256",
        *(F.col("row").alias(name) for name in carried),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of ``exact_groups``, all columns as they are."""
    row = free_name(docs, "_row")
    with job_tables(docs.sparkSession):
        rows = numbered(docs, row)
        gone = exact_groups(rows, text, doc_id, row=row).where("not kept")
        gone = settle(gone.select(row), "exact-gone", lasting=True)
    return rows.join(gone, row, "left_anti").select(*docs.columns)
