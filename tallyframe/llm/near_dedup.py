"""Near duplicates: bottom-k sketches find candidates, whole shingle sets decide.

Every document's set of five-word shingles is hashed by one function; its k smallest hashes
are its sketch. Documents with the same set are one class from then on.

Inverted lists hold the classes whose sketch has a value. A class can have a near duplicate
only if a good part of its sketch is shared at all; the others are left out, which
loses a pair with a chance below 1e-9. Then come rounds of candidates:

1. the first class of each list with every other one, which settles groups of near copies
   by as many pairs as they have members;
2. all pairs of a list whose classes are still in different components. Lists longer than
   LONG_LIST are passages that many documents share, or large groups of copies. They
   are needed only for classes that have little else ("heavy" ones), as any others
   that are near duplicates also share values of short lists. Of these, the classes
   whose whole sets have too many shingles that no other heavy class has
   cannot reach the threshold and leave. The first class of a long list is the one with
   the fewest such shingles, the middle of a group of copies; then others are tried.
3. all pairs of heavy classes that are still in different components and share one of
   their rarest shingles: with a quarter of the set and one more, rarest first, two
   sets at 0.75 always do. The places of the shared one bound what the sets can
   share at all, which rules out nearly every pair of a passage or a group of copies.

Candidates are filtered by the estimate from the sketch of the union, with a
margin of seven standard deviations (for a sketch of 64 and a pair at the threshold, a
binomial chance below 1e-9 to be left out), and decided by their whole sets. Pairs
within a component are never looked at again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import job_tables, settle

from .rows import free_name, numbered, smallest_id_first
from .shipping import ship, small_batches
from .tokens import slices

WORDS, SKETCH, THRESHOLD = 5, 64, 0.75
#: Bytes of text made into shingles at once: they take some ten times as much in each worker.
SLICE_BYTES = 2 << 20
#: Longer lists are not taken for all pairs at once; share of a sketch in such lists from
#: which a class needs them; other first classes tried for them.
LONG_LIST, HEAVY_SHARE, LEADER_ROUNDS = 32, 0.4, 2
#: Standard deviations below the threshold's expected estimate at which a pair is ruled out.
MARGIN = 7
#: Passes in which classes without enough shared shingles leave; each may leave others without.
LEAVING_ROUNDS = 3
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scatter(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads the bits of each number over all 64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the word shingles of each text."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    present = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(present)])[offsets - offsets[0]]
    coded = flat.filter(pa.array(present)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = hashes[coded.indices.to_numpy()]
    whole = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words if len(whole) else 0):
        whole = _scatter(whole * _MIX[0] + hashes[i : len(hashes) - words + 1 + i])
    found = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start >= words:
            found.append(np.unique(whole[start : end - words + 1].view(np.int64)))
        elif end > start:
            one = np.zeros(1, np.uint64)
            for i in range(start, end):
                one = _scatter(one * _MIX[0] + hashes[i : i + 1])
            found.append(_scatter(one + np.uint64(end - start)).view(np.int64))
        else:
            found.append(np.zeros(0, np.int64))
    return found


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, words: int = WORDS, sketch: int = SKETCH) -> DataFrame:
    """doc_id, row, n (size of the shingle set), digest of the set, sketch."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            sets = shingle_sets(batch.column("text"), words)
            sizes = [min(len(s), sketch) for s in sets]
            lowest = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                pa.array(np.concatenate([s[:sketch] for s in sets])),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) for s in sets], pa.binary()), lowest],
                names=["doc_id", "row", "n", "digest", "sketch"],
            )

    return docs.mapInArrow(profile, "doc_id long, row long, n long, digest binary, sketch array<bigint>")


def _alike_sizes(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b)


def _can_reach(n_a: Column, apart_a: Column, n_b: Column, apart_b: Column, threshold: float) -> Column:
    """Could two sets reach the threshold, given how many of their shingles they do not share at least?"""
    shared = F.least(n_a - apart_a, n_b - apart_b)
    return shared >= threshold * (n_a + n_b - shared)


def _heavy_classes(texts: DataFrame, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The classes of ``texts`` that can have a near duplicate among them: node, alone (how
    many of their shingles no other one has); and the rarest shingles of each: value, node, n,
    at (how many of its shingles are rarer)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
            sets = shingle_sets(batch.column("text"), words)
            sizes = [len(s) for s in sets]
            node = np.repeat(batch.column("node").to_numpy(), sizes)
            shingles = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(shingles, pa.int64())],
                names=["node", "n", "shingle"],
            )

    held = settle(texts.mapInArrow(spell, "node long, n long, shingle long"), "near-shingles")
    for _ in range(LEAVING_ROUNDS):
        single = held.groupBy("shingle").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
        alone = single.groupBy("node").agg(F.count("*").alias("alone"))
        counted = held.groupBy("node", "n").agg(F.lit(0).alias("_")).join(alone, "node", "left")
        counted = counted.select("node", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
        staying = settle(counted.where(F.col("n") - F.col("alone") >= threshold * F.col("n")), "near-staying")
        held = held.join(staying.select("node"), "node", "left_semi")
    times = held.groupBy("shingle").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "shingle")) - 1
    placed = held.join(times, "shingle").withColumn("at", place)
    rarest = placed.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold)) & (F.col("times") > 1))
    rarest = settle(rarest.select(F.col("shingle").alias("value"), "node", "n", "at"), "near-rarest")
    return staying.select("node", "alone"), rarest


def _estimated(pairs: DataFrame, suspects: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose union's sketch does not rule out the threshold."""
    own = suspects.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    other = suspects.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.join(own, "a").join(other, "b")
    longest = F.greatest(F.size("sketch_a"), F.size("sketch_b"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, longest)
    both = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    expected = F.size(union) * threshold
    return joined.where(both >= expected - MARGIN * F.sqrt(expected * (1 - threshold))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold."""
    own = texts.select(F.col("node").alias("a"), F.col("digest").alias("digest_a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    percent = round(100 * threshold)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.int64))
        for batch in (part for whole in batches for part in slices(whole, "text_b", SLICE_BYTES)):
            digests, nodes = batch.column("digest_a").to_pylist(), batch.column("a").to_pylist()
            linked = []
            for i, second in enumerate(shingle_sets(batch.column("text_b"), words)):
                if kept[0] != digests[i]:
                    kept = (digests[i], shingle_sets(batch.column("text_a").slice(i, 1), words)[0])
                shared = len(np.intersect1d(kept[1], second, assume_unique=True))
                if 100 * shared >= percent * (len(kept[1]) + len(second) - shared):
                    linked.append((nodes[i], batch.column("b")[i].as_py()))
            a, b = zip(*linked, strict=True) if linked else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    joined = pairs.join(own, "a").join(other, "b").select("a", "digest_a", "text_a", "b", "text_b")
    return joined.mapInArrow(decide, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label for all ends of ``edges`` (a, b): the smallest node that can be reached."""
    edges = settle(edges.union(edges.select("b", "a")).distinct(), "near-edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                    .select("node", F.least("node", "least").alias("label")), "near-labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
        near = labels.join(seen.agg(F.min("label").alias("near")), "node")
        near = near.select("node", F.least("label", "near").alias("near"), "label")
        # Also take over the label of the label, which halves the way on long chains.
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = near.join(jump, "near").select("node", F.least("near", "far").alias("new"), "label")
        moved = settle(moved.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")),
                       "near-labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the components at both ends of each of ``links`` have become one."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    edges = links.join(a, "a").join(b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    edges = settle(edges.distinct(), "near-merges")
    if edges.isEmpty():
        return labels
    merged = components(edges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    joined = labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return settle(joined, "near-joined")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS,
                threshold: float = THRESHOLD, sketch: int = SKETCH, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with a Jaccard similarity of ``threshold`` or more are linked; of each
    component one row is kept, the one with the smallest id and, among repeated rows
    or where none has an id, with the smallest row number. Words are separated by ASCII white
    space and compared in ASCII lower case; fewer words than a shingle
    has make one shingle. Null and blank texts have none, stay alone and are kept. The
    component_id of rows without an id is the smallest id they are linked with, or null.
    Equal ids with different texts are separate documents. ``row`` names a column of distinct
    whole numbers and is returned as it is; without it the rows are numbered here.

    Shingles are compared by 64-bit hashes: that two of n shingles of a pair
    share one by chance has a probability of about n * n / 2^65.
    """
    ship(docs.sparkSession)
    carried = [row] if row else []
    row = row or free_name(docs, "_row")
    with job_tables(docs.sparkSession), small_batches(docs.sparkSession):
        if not carried:
            docs = numbered(docs, row)
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(row).cast("long").alias("row"))
        found = _near_groups(rows, words, threshold, sketch)
        return settle(found.select("doc_id", "n_shingles", "component_id", "kept", *(F.col("row").alias(c) for c in carried)),
                      "near-groups", lasting=True)


def _near_groups(docs: DataFrame, words: int, threshold: float, sketch: int) -> DataFrame:
    own = settle(profiles(docs, words, sketch), "near-profiles")
    classes = own.where("n > 0").groupBy("digest").agg(
        F.min(smallest_id_first(F.col("doc_id"), F.col("row"))).alias("rep"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    labels = _linked_classes(docs, classes, words, threshold)
    named = classes.select("node", "digest", "rep").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("best"))
    named = named.join(smallest, "label").select(
        "digest", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep_row")
    )
    out = own.select("doc_id", "row", "n", "digest").join(named, "digest", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (F.col("row") == F.coalesce("keep_row", "row")).alias("kept"), "row",
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one row of each component of ``near_groups``, all columns as they are."""
    row = free_name(docs, "_row")
    with job_tables(docs.sparkSession):
        rows = numbered(docs, row)
        gone = near_groups(rows, text, doc_id, row=row, **settings).where("not kept")
        gone = settle(gone.select(row), "near-gone", lasting=True)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def _linked_classes(docs: DataFrame, classes: DataFrame, words: int, threshold: float) -> DataFrame:
    """node, label for every class that may have a near duplicate."""
    postings = classes.select(
        "node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value")
    )
    lists = postings.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    shared = settle(postings.join(lists, "value"), "near-shared")
    # Half of what a near duplicate would share is far below what chance leaves of it.
    enough = shared.groupBy("node", "m").agg(
        F.count("*").alias("in_lists"), F.sum((F.col("length") > LONG_LIST).cast("int")).alias("in_long")
    ).where(F.col("in_lists") >= F.col("m") * threshold / 2)
    enough = enough.select("node", (F.col("in_long") > HEAVY_SHARE * F.col("m")).alias("heavy"))
    suspects = settle(classes.join(enough, "node"), "near-suspects")
    chosen = suspects.select(F.col("rep.row").alias("row"), "node", "digest", "heavy")
    texts = settle(docs.join(chosen, "row").select("node", "digest", "text", "heavy"), "near-texts")
    staying, rarest = _heavy_classes(texts.where("heavy"), words, threshold)
    used = shared.join(suspects.select("node"), "node", "left_semi").join(staying, "node", "left")
    used = used.withColumn("long", F.col("length") > LONG_LIST).where("not long or alone is not null")
    alone = F.when(F.col("long"), F.col("alone")).otherwise(0).alias("alone")
    lists = settle(used.select("value", "node", "n", "long", alone), "near-lists")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = settle(_estimated(pairs, suspects, threshold), "near-pairs")
        return settle(_verified(likely, texts, words, threshold), "near-links")

    def led(rows: DataFrame, order: Column) -> DataFrame:
        """Each list's first row by ``order`` with all others of other components."""
        first = rows.groupBy("value").agg(F.min(F.struct(order.alias("o"), "node", "n", "alone", "label")).alias("first"))
        pairs = rows.join(first, "value").where("first.label <> label")
        pairs = pairs.where(_can_reach(F.col("n"), F.col("alone"), F.col("first.n"), F.col("first.alone"), threshold))
        return pairs.select(F.col("first.node").alias("a"), F.col("node").alias("b"))

    def open_lists(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Those of the lists that have classes of several components."""
        rows = rows.join(labels, "node")
        split = rows.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return settle(rows.join(split.where("low <> high").select("value"), "value"), "near-open")

    labels = suspects.select("node", F.col("node").alias("label"))
    middle = F.struct(F.col("alone") / F.col("n"), "node")
    labels = _joined(labels, links(led(lists.withColumn("label", F.col("node")), middle)))
    rows = open_lists(lists.where("not long"), labels)
    members = F.array_sort(F.collect_list(F.struct("node", "n", "label")))
    short = rows.groupBy("value").agg(members.alias("members"))
    pairs = short.select(F.explode("members").alias("x"), "members").select("x", F.explode("members").alias("y"))
    pairs = pairs.where(F.expr("x.node < y.node and x.label <> y.label"))
    pairs = pairs.where(_alike_sizes(F.col("x.n"), F.col("y.n"), threshold))
    labels = _joined(labels, links(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))))
    for turn in range(LEADER_ROUNDS):
        rows = open_lists(lists.where("long"), labels)
        labels = _joined(labels, links(led(rows, F.xxhash64("node", F.lit(turn)))))
    rows = open_lists(rarest, labels)
    largest = rows.groupBy("value", "label").agg(F.count("*").alias("size")).groupBy("value")
    largest = largest.agg(F.max(F.struct("size", "label")).alias("top")).select("value", F.col("top.label").alias("top"))
    outside = rows.join(largest, "value").where("label <> top").select(
        "value", "top", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("label").alias("label_a")
    )
    pairs = outside.join(rows, "value").where("label_a <> label and (label = top or a < node)")
    pairs = pairs.where(_can_reach(F.col("n_a"), F.col("at_a"), F.col("n"), F.col("at"), threshold))
    return _joined(labels, links(pairs.select("a", F.col("node").alias("b"))))
