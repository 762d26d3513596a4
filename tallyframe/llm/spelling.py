"""Spelling variants: words one edit apart, found by a bit-sliced index of positions.

For some thousand words at a time, a bitset for each position and letter says which of
them have it there. A word is run against all of them at once: letter by letter one
bitset keeps the words without an error so far, one those with a replaced letter and,
looking one position further, one those with an additional letter. The words with one
letter less find theirs by the same run.

One edit leaves the first or the last half of the shorter word as it is, so words meet
in cells of those with the same half (a hash of it decides), once by prefix and once,
spelled backwards, by suffix. A cell that is too large, as many words begin alike, is cut
into parts of words to search and words to search for, and every part of the
one meets every part of the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.scratch import job_tables, settle

from .shipping import ship

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: A word's near word counts as its form if it occurs so many times as often.
FORM_TIMES = 2
#: Words of a cell, letters of a cell (for very long words), and words run against it at once.
CELL_WORDS, CELL_LETTERS, RUN_WORDS = 4096, 1 << 19, 128


def words_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and each of the runs of letters in its text, in ASCII lower case."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))
    run = F.col("run")
    plain = F.octet_length(run) == F.length(run)
    lowered = F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    kept = [c for c in docs.columns if c not in ("run", text)]
    return docs.select(*kept, F.explode(runs).alias("run")).withColumn("run", lowered)


def without_letter(run: Column, at: Column) -> Column:
    """``run`` without the code point at ``at`` (from 0)."""
    at = at.cast("int")
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))


def _cells(words: DataFrame) -> DataFrame:
    """The cells each word is in: least, side, slot, own part, other part, searched, asks, spelled, n."""
    size, least = F.length("word"), F.col("least")
    target = F.greatest(F.lit(1), F.least(F.lit(CELL_WORDS), F.lit(CELL_LETTERS) / least)).cast("long")
    in_both = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("least"))
    in_both = in_both.where(least >= LEAST_LETTERS)
    counts = in_both.groupBy("least").agg(F.count("*").alias("rows"))
    slots = settle(counts.select("least", F.ceil(F.col("rows") / target).alias("slots")), "spelling-slots")
    spelled = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    rows = in_both.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("spelled", spelled).join(slots, "least")
    half = F.substring(F.col("spelled"), F.lit(1), F.floor(least / 2).cast("int"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("least", "side", half), F.col("slots")))
    cell = ["least", "side", "slot"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("members"))
    parts = settle(sizes.select(*cell, F.ceil(F.col("members") / (2 * target)).cast("int").alias("parts")), "spelling-parts")
    rows = rows.join(parts, cell).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    asks = F.col("size") == least
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    searched = F.transform(others, lambda p: F.struct(F.col("own").alias("i"), p.alias("q"), F.lit(True).alias("held"), (asks & (F.col("parts") == 1)).alias("asks")))
    asking = F.transform(others, lambda p: F.struct(p.alias("i"), F.col("own").alias("q"), F.lit(False).alias("held"), F.lit(True).alias("asks")))
    places = F.when((F.col("parts") > 1) & asks, F.concat(searched, asking)).otherwise(searched)
    rows = rows.select(*cell, "spelled", "n", F.explode(places).alias("at"))
    return rows.select(*cell, "at.i", "at.q", "at.held", "at.asks", "spelled", "n")


def _letters(words: list[str], width: int) -> np.ndarray:
    """The code points of each word, with zeros up to ``width``."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def near_in_cell(held: list[str], asking: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``asking``, in ``held``) of the words with one letter replaced or one more
    than the asking ones, which have ``least`` letters, and with the same first half."""
    codes = _letters(held, least + 1)
    asked = _letters(asking, least)
    alphabet = np.unique(codes[codes > 0])
    width = -(-len(held) // 64)
    # One more row of zeros for letters that no held word has.
    index = np.zeros((least + 1, len(alphabet) + 1, width * 8), np.uint8)
    for position in range(least + 1):
        has = codes[:, position] == alphabet[:, None]
        index[position, :-1, : -(-len(held) // 8)] = np.packbits(has, axis=1, bitorder="little")
    index = index.view(np.uint64)
    longer = np.zeros(width * 8, np.uint8)
    longer[: -(-len(held) // 8)] = np.packbits(codes[:, least] > 0, bitorder="little")
    longer = longer.view(np.uint64)
    found = np.searchsorted(alphabet, asked)
    letter = np.where(alphabet[np.minimum(found, len(alphabet) - 1)] == asked, found, len(alphabet))
    half, pairs = least // 2, []
    for at in range(0, len(asking), RUN_WORDS):
        run = letter[at : at + RUN_WORDS]
        same = np.full((len(run), width), ~np.uint64(0))
        replaced, added, alike = np.zeros_like(same), same.copy(), same
        for i in range(least):
            here, next_ = index[i][run[:, i]], index[i + 1][run[:, i]]
            replaced = (replaced & here) | (same & ~here)
            same &= here
            added = (added & next_) | same
            if i + 1 == half:
                alike = same.copy()
        near = alike & ((replaced & ~longer) | (added & longer))
        rows, words = np.nonzero(near)
        bits = np.unpackbits(near[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        pairs.append((at + rows[hit], words[hit] * 64 + bit))
    asks, holds = zip(*pairs, strict=True) if pairs else ((), ())
    none = np.zeros(0, np.int64)
    asks, holds = np.concatenate([none, *asks]), np.concatenate([none, *holds])
    # Bits beyond the last held word belong to none.
    return asks[holds < len(held)], holds[holds < len(held)]


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of ``words`` (word, n; distinct) that differ by one
    inserted, deleted or replaced code point."""
    ship(words.sparkSession)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        least, side = key[0].as_py(), key[1].as_py()
        spelled, n = table.column("spelled").to_pylist(), table.column("n").to_numpy()
        held = np.flatnonzero(table.column("held").to_numpy())
        asking = np.flatnonzero(table.column("asks").to_numpy())
        found: tuple[list, list, list] = ([], [], [])
        if len(held) and len(asking):
            half = least // 2
            asks, holds = near_in_cell([spelled[i] for i in held], [spelled[i] for i in asking], least)
            for a, b in zip(asking[asks].tolist(), held[holds].tolist(), strict=True):
                one, other = spelled[a], spelled[b]
                if side:
                    one, other = one[::-1], other[::-1]
                    if one[:half] == other[:half]:
                        continue  # a pair that meets by its prefix
                pairs = [(one, other, n[b])] + ([(other, one, n[a])] if len(other) > len(one) else [])
                for pair in pairs:
                    for column, value in zip(found, pair, strict=True):
                        column.append(value)
        return pa.table({"word": pa.array(found[0], pa.string()), "near": pa.array(found[1], pa.string()),
                         "near_n": pa.array(found[2], pa.int64())})

    cells = _cells(words).groupBy("least", "side", "slot", "i", "q")
    return cells.applyInArrow(search, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for every word that has a form: the last word on the way from form to form.
    A form occurs FORM_TIMES as often at least, so ways are short and never closed."""
    ways = settle(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(ways.join(further, "root", "left").select("word", "root", "further"), "spelling-ways")
        ways = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.where("further is not null").isEmpty():
            return ways


def spelling_forms(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``words`` (word, n; distinct).

    ``form`` is the near word with the largest n, the first in code-point order of
    equal ones, if that is FORM_TIMES the word's own n at least; ``root`` the end of the
    way from form to form, the word itself without one. Words need LEAST_LETTERS
    letters; an empty table gives an empty one.
    """
    with job_tables(words.sparkSession):
        words = settle(words.select("word", "n"), "spelling-words")
        near = near_words(words).groupBy("word").agg(
            F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
        )
        best = words.join(near, "word", "left").withColumn("best_n", -F.col("best.order"))
        best = settle(best.withColumn("has_form", F.coalesce(F.col("best_n") >= FORM_TIMES * F.col("n"), F.lit(False))), "spelling-best")
        form = F.when(F.col("has_form"), F.col("best.near"))
        forms = best.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(F.col("has_form"), F.col("best_n")).alias("form_n"))
        out = forms.join(_roots(forms.where("form is not null")), "word", "left")
        out = out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return settle(out, "spelling-forms", lasting=True)


def frequent_words(words: DataFrame) -> DataFrame:
    """word, n of the words (column word) with LEAST_LETTERS letters and LEAST_TIMES occurrences
    at least. Words are counted where they are read."""
    long_enough = words.where(F.length("word") >= LEAST_LETTERS)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)
