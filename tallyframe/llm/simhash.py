"""Near duplicates by SimHash fingerprints, found by one-wildcard variants of half fingerprints.

A fingerprint of 64 bits is cut into two segments, fewer than the bits that may differ
plus one, so of two linked fingerprints one segment differs by one bit at most. Each
segment is indexed under its 32 variants with one bit left out; fingerprints linked
share a variant, which an equality join finds, and the other bits are counted.

In the lists of a variant without bit i only fingerprints that differ in it are compared, so a
list matters only if it holds both; those that are equal in a whole segment meet in the
list of bit 0. Only components are wanted, so the lists are settled in steps:

1. each member is compared with one of its list, LEADER_ROUNDS times with another one;
   a list whose members are in one component is closed;
2. of an open list, the members outside its largest component are compared with all others, if
   they are FEW_OTHERS at most;
3. other lists are cut once more in the same way: the other segment in halves, of which one
   differs by one bit at most, under 32 variants; these lists are treated as in 2;
4. members of lists that still have many others are indexed under all 2016 variants of the whole
   fingerprint with two bits left out. Such a list has four members at most, and any two
   of them are linked, so such lists cost a fixed number of rows for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.scratch import job_tables, settle

from .near_dedup import components
from .shipping import ship
from .tokens import slices

WORDS, SEED, DISTANCE = 3, 42, 2
#: Most members outside a list's largest component that are compared with the whole list, and
#: rounds with one member of each list before.
FEW_OTHERS, LEADER_ROUNDS = 16, 2
#: Shingles whose bits are spread out at once.
SPREAD = 1 << 15


def fingerprint_values(texts: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set where over half of the XXH64 hashes
    of its shingles, repeats included, have it."""
    from xxhash import xxh64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = split.offsets.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes > 0)])[offsets - offsets[0]]
    flat, sizes = flat.filter(pa.array(sizes > 0)), sizes[sizes > 0]
    joined = " ".join(flat.to_pylist()).encode()
    ends = np.cumsum(sizes + 1) - 1
    counts = np.diff(bounds)
    # A text with fewer words than a shingle has one of all its words.
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    first = np.repeat(bounds[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = first + np.repeat(np.minimum(counts, words), shingles) - 1
    spans = zip((ends[first] - sizes[first]).tolist(), ends[last].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(first))
    ones = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), shingles)
    for at in range(0, len(hashes), SPREAD):
        bits = np.unpackbits(hashes[at : at + SPREAD].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = owner[at : at + SPREAD]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ones[part[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, print (the fingerprint as a signed number) of every row. Null text and texts
    without a word have fingerprint 0."""
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            values = fingerprint_values(batch.column("text"), words, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "print"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, print long")


def _variants(prints: DataFrame) -> DataFrame:
    """print, key and bit: 64 rows for each, a half with one bit left out and which half and
    bit, and that bit."""
    segment = "shiftrightunsigned(print, if(k < 32, 0, 32)) & 4294967295L"
    variants = F.expr(f"""transform(sequence(0L, 63L), k -> struct(
        shiftleft(k, 32) | ({segment} & ~shiftleft(1L, cast(k % 32 as int))) as key,
        shiftrightunsigned(print, cast(k as int)) & 1 as bit))""")
    return prints.select("print", F.explode(variants).alias("variant")).select("print", "variant.*")


def _lists(prints: DataFrame) -> DataFrame:
    """key, print of the lists that may hold linked fingerprints."""
    variants = _variants(prints)
    # Rows in the low half of a number, set bits in the high half: one column to shuffle.
    sizes = variants.groupBy("key").agg(F.sum(F.shiftleft("bit", 32) + 1).alias("sizes"))
    n, ones = F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("sizes", 32)
    whole = F.shiftright("key", 32) % 32 == 0
    kept = sizes.where((n > 1) & (whole | ones.between(1, n - 1))).select("key")
    # By sort and merge at every size: lists grow with the prints, so they are never few for long,
    # and a list that is a large part of all can be split.
    return settle(variants.select("key", "print").join(kept.hint("merge"), "key"), "simhash-lists")


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (print, label) after the components named by each of ``edges`` (a, b) are one."""
    edges = settle(edges.distinct(), "simhash-merges")
    if edges.isEmpty():
        return labels
    to = components(edges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    merged = labels.join(to, "label", "left").select("print", F.coalesce("to", "label").alias("label"))
    return settle(merged, "simhash-labels")


def _open(rows: DataFrame, *key: str) -> DataFrame:
    """Of ``rows`` (key columns, print, label) those of lists with several components, with the
    list's largest component, ``top``, and how many rows are not in it, ``others``."""
    parts = rows.groupBy(*key, "label").agg(F.count("*").alias("n"))
    lists = parts.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("top"))
    lists = lists.where("parts > 1").select(*key, F.col("top.label").alias("top"), (F.col("n") - F.col("top.n")).alias("others"))
    return rows.select(*key, "print", "label").join(lists, list(key))


def _led(rows: DataFrame, turn: int) -> DataFrame:
    """Links between components of each list's first member, by a hash that changes every turn, and the others."""
    first = F.min(F.struct(F.xxhash64("print", F.lit(turn)).alias("order"), "print", "label")).alias("first")
    first = rows.groupBy("key").agg(first).select(F.col("key").alias("list"), "first")
    linked = (F.col("label") != F.col("first.label")) & _close(F.col("print"), F.col("first.print"))
    pairs = rows.join(first, [F.col("key") == F.col("list"), linked])
    return pairs.select(F.least("label", "first.label").alias("a"), F.greatest("label", "first.label").alias("b"))


def _across_few(rows: DataFrame, *key: str) -> DataFrame:
    """Links between components within lists of FEW_OTHERS others at most: these with all rows."""
    rows = rows.where(F.col("others") <= FEW_OTHERS)
    a = rows.where("label <> top").select(*key, F.col("print").alias("print_a"), F.col("label").alias("a"), "top")
    b = rows.select(*(F.col(c).alias(f"{c}_b") for c in key), F.col("print").alias("print_b"), F.col("label").alias("b"))
    same = [F.col(c) == F.col(f"{c}_b") for c in key]
    once = (F.col("a") != F.col("b")) & ((F.col("b") == F.col("top")) | (F.col("print_a") < F.col("print_b")))
    pairs = a.join(b, [*same, once, _close(F.col("print_a"), F.col("print_b"))])
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _halved(members: DataFrame) -> DataFrame:
    """key, half, print, label: 32 rows for each member of a list, a half of the segment the
    list does not share with one bit left out, and which half and bit."""
    other = "shiftrightunsigned(print, if(shiftrightunsigned(key, 37) = 0, 32, 0) + if(k < 16, 0, 16)) & 65535L"
    halves = F.expr(f"transform(sequence(0L, 31L), k -> shiftleft(k, 16) | ({other} & ~shiftleft(1L, cast(k % 16 as int))))")
    return members.select("key", F.explode(halves).alias("half"), "print", "label")


def _across_long(members: DataFrame) -> DataFrame:
    """Links between components among all ``members``, by two bits left out of the whole.

    The members of a list differ in these two bits only, so each has one of four places."""
    pairs = list(combinations(range(64), 2))
    pair = F.explode(F.expr("sequence(0, %d)" % (len(pairs) - 1))).alias("pair")
    low = F.array(*(F.lit(i).cast("tinyint") for i, _ in pairs))
    high = F.array(*(F.lit(j).cast("tinyint") for _, j in pairs))
    rows = members.select("print", "label").distinct().select("print", "label", pair)
    rows = rows.withColumns({"i": F.get(low, F.col("pair")).cast("int"), "j": F.get(high, F.col("pair")).cast("int")})
    rest = F.expr("print & ~(shiftleft(1L, i) | shiftleft(1L, j))")
    place = F.expr("(shiftright(print, i) & 1) + 2 * (shiftright(print, j) & 1)")
    rows = rows.select("pair", rest.alias("rest"), place.alias("place"), "label")
    held = [F.max(F.when(F.col("place") == p, F.col("label"))).alias(f"l{p}") for p in range(4)]
    lists = rows.groupBy("pair", "rest").agg(F.min("label").alias("low"), F.max("label").alias("high"), *held)
    others = F.explode(F.array(*(f"l{p}" for p in range(4)))).alias("b")
    return lists.where("low < high").select(F.col("low").alias("a"), others).where("b > a")


def component_labels(prints: DataFrame) -> DataFrame:
    """print, label for the distinct ``prints``: one of the fingerprints that can be reached by
    links of DISTANCE bits at most, the same for all of these."""
    lists = _lists(prints)
    labels = prints.select("print", F.col("print").alias("label"))

    def opened() -> DataFrame:
        return settle(_open(lists.join(labels, "print"), "key"), "simhash-open")

    for turn in range(LEADER_ROUNDS):
        labels = _merged(labels, _led(opened(), turn))
    rows = opened()
    many = F.col("others") > FEW_OTHERS
    halves = settle(_open(_halved(rows.where(many)), "key", "half"), "simhash-halves")
    across = _across_few(rows, "key").union(_across_few(halves, "key", "half"))
    return _merged(labels, across.union(_across_long(halves.where(many))))


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Words are separated by ASCII white space and compared in ASCII lower case; fewer words than
    a shingle has make one shingle. Null text and texts without a word have fingerprint
    zero and are linked like any others. Rows are linked when their fingerprints
    differ by DISTANCE bits at most; ``component_id`` is the smallest id that can be reached. Rows
    without an id take part; a component without any id has none. Repeated rows
    and ids are judged each for itself. Other columns are not looked at.
    """
    with job_tables(docs.sparkSession):
        own = settle(fingerprints(docs, text, doc_id, words, seed), "simhash-prints", lasting=True)
        # Copies are counted out where they are read; only one of each fingerprint travels on.
        prints = settle(own.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
        named = prints.join(component_labels(prints), "print")
        smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
        named = settle(named.join(smallest, "label").select("print", "component_id"), "simhash-named", lasting=True)
    out = own.join(named, "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
