"""Numbers for the rows of a table, whatever its ids are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import settle

#: Bits of a row's place in its file within its number.
PLACE_BITS = 40


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column of whole numbers, one for each row and the same whenever it is read.

    A frame that reads Parquet files as they are takes a row's number from its file
    and its place there, so nothing is written again but the list of files. Any other
    frame is written once, with its numbers. Either table outlives the job it is made in.
    """
    try:
        if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
            return _by_place(df, name)
    except AnalysisException:  # files of another format know no places
        pass
    return settle(df.withColumn(name, F.monotonically_increasing_id()), "numbered-rows", lasting=True)


def _by_place(df: DataFrame, name: str) -> DataFrame:
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    own, at, file, number = (free_name(df, x) for x in ("_path", "_at", "_file", "_number"))
    placed = df.select("*", path.alias(own), place.alias(at))
    # One row for each file, all of which the driver has listed anyway.
    files = df.select(path.alias(file)).distinct()
    files = files.withColumn(number, F.row_number().over(Window.orderBy(file)).cast("long"))
    files = settle(files, "numbered-files", lasting=True)
    row = F.shiftleft(number, PLACE_BITS) + F.col(at)
    return placed.join(files, F.col(own) == F.col(file)).select(*(df[c] for c in df.columns), row.alias(name))


def in_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that counts its rows from 0 in the order of its files and of the rows in them."""
    number, start = free_name(df, "_in_files"), free_name(df, "_start")
    rows = numbered(df, number)
    files = rows.groupBy(F.shiftright(number, PLACE_BITS).alias("file")).agg(F.max(number).alias("last"))
    count = F.col("last") - F.shiftleft("file", PLACE_BITS) + 1
    # One row for each file.
    before = F.sum(count).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = settle(files.select("file", F.coalesce(before, F.lit(0)).alias(start)), "files-in-order", lasting=True)
    placed = rows.join(F.broadcast(files), F.shiftright(number, PLACE_BITS) == F.col("file"))
    place = F.col(start) + F.col(number) - F.shiftleft("file", PLACE_BITS)
    return placed.select(*(rows[c] for c in df.columns), place.alias(name))


def smallest_id_first(doc_id: Column, row: Column) -> Column:
    """Orders rows by id, those without one last, and rows of equal ids by their numbers."""
    return F.struct(doc_id.isNull().alias("unnamed"), doc_id.alias("id"), row.alias("row"))
