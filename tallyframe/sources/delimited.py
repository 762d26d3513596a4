"""CSV and TSV files of any encoding and layout, as one grid.

Lines are read as text, so large files are split across tasks. One pass finds, per
block of a file, how many lines it has, whether its bytes are valid UTF-8 and whether any
line leaves a quoted cell open; that gives every line its number and every file its
header. The second pass decodes and parses.

Only in files with an open line does it matter in which state a line begins: at the
start of a record, or within a quoted cell. Every line maps either state to the one it ends
in, and only lines with a quote change anything, so these maps, a few bytes for each such
line, are composed over the lines of a block and then over the blocks of a file.
The lines that turn out to begin within a cell are put to those before them; all others are
parsed where they are read, like the lines of any file.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .paths import base_name, full_path
from .scratch import settle

GLOB = "*.[cCtT][sS][vV]"
_BOM = "^﻿"
#: Longest record, in bytes of all its lines: a quote that is never closed would make one of the rest of a file.
RECORD_BYTES = 16 << 20
#: Lines of records of several lines that may be broadcast.
FEW_LINES = 50_000
#: Bytes without a character in Windows-1252.
UNDEFINED = r"[\x81\x8D\x8F\x90\x9D]"

NOT_TEXT, OPEN_QUOTE, LONG_RECORD = "neither UTF-8 nor Windows-1252 text", "quote left open in line ", "record too long in line "


def _c1_characters() -> dict[str, str]:
    """What cp1252 has in the range that Latin-1 leaves to control codes."""
    pairs = {}
    for code in range(0x80, 0xA0):
        try:
            pairs[chr(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return pairs


def _from_cp1252(raw: Column) -> Column:
    pairs = _c1_characters()
    return F.translate(F.decode(raw.cast("binary"), "ISO-8859-1"), "".join(pairs), "".join(pairs.values()))


def _text(raw: Column, utf8: Column) -> Column:
    return F.regexp_replace(F.when(utf8, raw).otherwise(_from_cp1252(raw)), _BOM, "")


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.option("pathGlobFilter", GLOB).text(list(paths)).select(
        full_path().alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("raw"),
    )


def _leaves_open(line: Column, separator: str) -> Column:
    """Does a line that begins a record end within a quoted cell? Only a quote at the start of a
    cell opens it; after the closing one, quotes are characters like others."""
    inside = '[^"]*+(?:""[^"]*+)*+'
    cell = f'(?:"{inside}"[^{separator}]*+|[^{separator}"][^{separator}]*+|){separator}'
    return line.rlike(f'^(?:{cell})*+"{inside}$')


def _separated(make) -> Column:
    """What ``make`` gives for the file's separator."""
    return F.when(F.lower("file").endswith(".tsv"), make("\t")).otherwise(make(","))


def _ends_open(line: Column) -> tuple[Column, Column]:
    """Whether a line ends within a quoted cell if it begins a record, and if it begins in such a cell."""
    line = F.regexp_replace(line, _BOM, "")
    quoted = F.contains(line, F.lit('"'))
    from_cell = F.concat(F.lit('"'), line)
    return (quoted & _separated(lambda s: _leaves_open(line, s)), ~quoted | _separated(lambda s: _leaves_open(from_cell, s)))


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: what to add to a line's id to get its number in the file, and
    the file's encoding and header, and whether any line is open."""
    first = F.when(~is_blank(F.regexp_replace("raw", _BOM, "")), F.struct("line_id", "raw"))
    utf8 = F.is_valid_utf8("raw")
    undefined = ~utf8 & F.decode(F.col("raw").cast("binary"), "ISO-8859-1").rlike(UNDEFINED)
    counted = lines.groupBy("file", "block_start").agg(
        F.min("line_id").alias("first_id"), F.count("*").alias("n"), F.min(first).alias("first"),
        F.bool_and(utf8).alias("utf8"), F.bool_or(undefined).alias("undefined"), F.bool_or(_ends_open(F.col("raw"))[0]).alias("open"),
    )
    whole = Window.partitionBy("file")
    before = F.sum("n").over(whole.orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(before, F.lit(0)) - F.col("first_id")).alias("shift")
    header = F.struct(F.col("first.line_id") + shift, F.col("first.raw"))
    numbered = counted.select(
        "file", "block_start", shift, F.bool_and("utf8").over(whole).alias("utf8"),
        F.bool_or("undefined").over(whole).alias("undefined"), F.bool_or("open").over(whole).alias("open"),
        F.min(F.when(F.col("first").isNotNull(), header)).over(whole).alias("header"),
    )
    return numbered.where("header is not null").select(
        "file", "block_start", "shift", "utf8", "undefined", "open", F.col("header.col1").alias("header_line"),
        F.col("header.raw").alias("header_raw"),
    )


def _composed(order: str, *within: str) -> tuple[Column, Column]:
    """For rows with ``constant`` (the state a row ends in whatever it begins in, else null) and
    ``turned`` (does it change the state): the same of all rows up to this one."""
    upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(F.col("turned").cast("int")).over(upto)
    known = F.when(F.col("constant").isNotNull(), F.struct("constant", turns.alias("turns")))
    last = F.last(known, ignorenulls=True).over(upto)
    turned = ((turns - F.coalesce(last["turns"], F.lit(0))) % 2 == 1)
    return last["constant"] != turned, turned


def _continued(lines: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of more than one line: file, first, last (their lines' numbers) and bytes; and
    the files that cannot be read: file, error."""
    open_blocks = blocks.where("open and not undefined")
    from_start, from_cell = _ends_open(F.col("raw"))
    raw = lines.join(open_blocks, ["file", "block_start"]).where(F.contains("raw", F.lit('"')))
    quoted = raw.select(
        "file", "block_start", (F.col("line_id") + F.col("shift")).alias("line"),
        F.when(from_start == from_cell, from_start).alias("constant"), (from_start & ~from_cell).alias("turned"),
    )
    constant, turned = _composed("line", "file", "block_start")
    quoted = settle(quoted.select("file", "block_start", "line", constant.alias("constant"), turned.alias("turned")), "delimited-states")
    # What a block does as a whole is what it does up to its last line; of these there are few.
    newest = quoted.groupBy("file", "block_start").agg(F.max(F.struct("line", "constant", "turned")).alias("end"))
    newest = newest.select("file", "block_start", "end.constant", "end.turned")
    constant, turned = _composed("block_start", "file")
    ends = newest.select("file", "block_start", F.coalesce(constant, turned).alias("ends_open"))
    begins = F.lag("ends_open", 1, False).over(Window.partitionBy("file").orderBy("block_start")).alias("begins_open")
    begins = ends.select("file", "block_start", begins)
    # How each line ends, and from that where records of several lines begin and end.
    ended = F.coalesce("constant", F.col("turned") != F.col("begins_open")).alias("ends_open")
    ended = quoted.join(begins, ["file", "block_start"]).select("file", "block_start", "line", ended, "begins_open")
    in_block = Window.partitionBy("file", "block_start").orderBy("line")
    changed = ended.withColumn("before", F.lag("ends_open").over(in_block))
    changed = changed.withColumn("before", F.coalesce("before", "begins_open")).where("before <> ends_open")
    # Openers and closers take turns, so an opener's partner is the next change, be it in a later block.
    firsts = changed.groupBy("file", "block_start").agg(F.min("line").alias("first_change"))
    later = F.lead("first_change").over(Window.partitionBy("file").orderBy("block_start")).alias("later")
    partner = F.coalesce(F.lead("line").over(in_block), F.col("later")).alias("last")
    spans = changed.join(firsts.select("file", "block_start", later), ["file", "block_start"])
    spans = spans.select("file", F.col("line").alias("first"), partner, "ends_open").where("ends_open")
    spans = settle(spans.select("file", "first", "last"), "delimited-spans")
    unclosed = spans.where("last is null").select("file", F.concat(F.lit(OPEN_QUOTE), F.col("first") + 1).alias("error"))
    # Every line has a line break at least.
    closed = F.col("last") - F.col("first") < RECORD_BYTES
    long = spans.where(~closed).select("file", F.concat(F.lit(LONG_RECORD), F.col("first") + 1).alias("error"))
    return spans.where(closed), unclosed.unionByName(long)


def _cells(text: Column, separator: str) -> Column:
    """The cells of a line, as many as it has. A quote opens a quoted cell only at its start."""
    other = f"[^{separator}]*+"
    inside = '[^"]*+(?:""[^"]*+)*+'
    cell = f'{separator}("{inside}"{other}|{other})'
    found = F.regexp_extract_all(F.concat(F.lit(separator), text), F.lit(cell), F.lit(1))
    bare = F.transform(
        found,
        lambda c: F.when(
            c.startswith('"'),
            F.concat(
                F.replace(F.regexp_extract(c, f'^"({inside})"', 1), F.lit('""'), F.lit('"')),
                F.regexp_replace(c, f'^"{inside}"', ""),
            ),
        ).otherwise(c),
    )
    return F.when(F.contains(text, F.lit('"')), bare).otherwise(F.split(text, separator, -1))


def _parsed(text: Column) -> Column:
    return _separated(lambda separator: _cells(text, separator))


def delimited_files(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The grid of all CSV/TSV files under ``paths``, and the files that cannot be read: file, error.

    Row 0 is the header, the first line that is not blank, which ``is_header`` marks; the others
    count the lines from there, a record of several lines by its first one. Line breaks within a cell are given
    as line feeds. A file is known by its full path; its sheet has the base name without suffix.
    """
    lines = _lines(spark, paths)
    blocks = settle(_blocks(lines), "delimited-blocks")
    failed = blocks.where("undefined").select("file", F.lit(NOT_TEXT).alias("error")).distinct()
    text = _text(F.col("raw"), F.col("utf8"))
    line = F.col("line_id") + F.col("shift")
    numbered = lines.join(blocks.where("not undefined"), ["file", "block_start"]).withColumn("text", text)
    numbered = numbered.select("file", line.alias("line"), "header_line", "text", "open")
    single = numbered.where("not open")
    if not blocks.where("open and not undefined").isEmpty():
        spans, unclosed = _continued(lines, blocks)
        members = spans.select("file", F.col("first").alias("record"), F.explode(F.sequence("first", "last")).alias("line"))
        # Spark takes the spans' size for that of their lines and broadcasts these however many there are.
        # Where they are more than a few, lines are sorted and tagged with their records once, for all that follows.
        n_lines = spans.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
        open_lines = numbered.where("open")
        if n_lines > FEW_LINES:
            tagged = settle(open_lines.join(members.hint("merge"), ["file", "line"], "left"), "delimited-lines")
        else:
            tagged = open_lines.join(members, ["file", "line"], "left")
        inside = tagged.where("record is not null")
        sizes = inside.groupBy("file", "record").agg(F.sum(F.octet_length("text")).alias("bytes"))
        long = sizes.where(F.col("bytes") > RECORD_BYTES).select("file", F.concat(F.lit(LONG_RECORD), F.col("record") + 1).alias("error"))
        bad = settle(unclosed.unionByName(long).groupBy("file").agg(F.min("error").alias("error")), "delimited-errors")
        failed = failed.unionByName(bad)
        inside = inside.join(bad, "file", "left_anti")
        joined = inside.groupBy("file", "header_line", F.col("record").alias("line")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")
        )
        outside = tagged.where("record is null").drop("record").join(bad, "file", "left_anti")
        single = single.unionByName(outside).select("file", "header_line", "line", "text").unionByName(joined)
    rows = single.where(~is_blank(F.col("text")) & (F.col("line") >= F.col("header_line")))
    # Headers are known from the first pass, so whoever wants only them does not read the files
    # again. Where one runs over a line end, it is put together with the other records.
    headers = blocks.where("not undefined").dropDuplicates(["file"]).withColumn("header_open", _ends_open(F.col("header_raw"))[0])
    headers = headers.join(failed.select("file"), "file", "left_anti")
    headers = settle(headers.select("file", "header_line", "header_open", _text(F.col("header_raw"), F.col("utf8")).alias("text")), "delimited-headers")
    plain = headers.where("not header_open").select("file", "header_line", F.col("header_line").alias("line"), "text")
    parts = [(plain, True), (rows.where(F.col("line") > F.col("header_line")), False)]
    if not headers.where("header_open").isEmpty():
        long = rows.join(headers.where("header_open").select("file"), "file", "left_semi").where(F.col("line") == F.col("header_line"))
        parts.append((long, True))
    return reduce(DataFrame.unionByName, [_grid(part, is_header) for part, is_header in parts]), failed


def _grid(rows: DataFrame, is_header: bool) -> DataFrame:
    return rows.select(
        "file",
        F.regexp_replace(base_name(F.col("file")), r"\.[^.]+$", "").alias("sheet"),
        (F.col("line") - F.col("header_line")).alias("row_idx"),
        _parsed(F.col("text")).alias("cells"),
        F.lit(True).alias("has_header"),
        F.lit(is_header).alias("is_header"),
    )


def read_delimited(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The grid of ``delimited_files`` without those that cannot be read."""
    return delimited_files(spark, paths)[0]
