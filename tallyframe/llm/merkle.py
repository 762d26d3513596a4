"""A Merkle tree over a table: a tree for each group, one over the groups, a proof for each row.

Where a leaf stands in its group is found without sorting the rows. The ids of a group
make a bitmap of 64-bit words, of which only those that hold an id exist; words are put
together by OR where the rows are read. A directory holds the rows before each word,
summed over ranges of 2^12 words, then of 2^24, and so on; a leaf's place is its
word's entry plus the bits before its own.

Leaves are then laid into arrays of SLOTS by their place. An array is reduced by as many
levels as it holds in one go, its result is a slot of the next round's arrays. On the way
back every array hands the siblings above it to what lies in its slots, down to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import job_tables, settle

from .ranks import HASH_BITS, add_ranks
from .shipping import ship

#: Levels reduced in one round, which makes arrays of 2^LEVELS slots.
LEVELS = 10
#: Bits of a key that one level of the directory sums over.
SPAN_BITS = 12


def field(value: Column) -> Column:
    """How a value enters a leaf: ``-`` for null, else its size in bytes, ``:`` and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _node(digests: bytes) -> bytes:
    return hashlib.sha256(digests).hexdigest().encode()


def reduce_levels(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each of ``levels`` + 1 levels: every two are hashed together, a last one alone."""
    found = [digests]
    for _ in range(levels):
        below = found[-1]
        found.append([_node(b"".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return found


def siblings(levels: list[list[bytes]], at: int) -> list[str]:
    """The way up from slot ``at``: ``<`` or ``>`` and the digest of the node beside it on that
    side, or nothing where there is none."""
    way = []
    for nodes in levels[:-1]:
        beside = at ^ 1
        way.append(("<" if at & 1 else ">") + nodes[beside].decode() if beside < len(nodes) else "")
        at >>= 1
    return way


def fold(digest: bytes, way: list[str]) -> bytes:
    """The root that ``digest`` leads to by its way up."""
    for step in way:
        beside = step[1:].encode()
        digest = _node(beside + digest if step.startswith("<") else digest + beside)
    return digest


def with_starts(nodes: DataFrame, group: list[str], key: str, size: str) -> DataFrame:
    """``nodes`` (group columns, key; distinct and not null) with ``start``: the sum of ``size``
    over the smaller keys of the group.

    Keys are summed over ranges of 2^SPAN_BITS, and these sums again, until few ranges are
    left, so no window is longer than that, however many keys a group has.
    """
    nodes = settle(nodes, "rank-nodes")
    low, high = nodes.agg(F.min(key), F.max(key)).first()
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    if low is None or high - low < 1 << SPAN_BITS:
        return nodes.withColumn("start", F.coalesce(F.sum(size).over(before.partitionBy(*group)), F.lit(0)))
    above = f"{key}_above"
    range_ = F.shiftright(key, SPAN_BITS).alias(above)
    sums = nodes.groupBy(*group, range_).agg(F.sum(size).alias("_size"))
    sums = with_starts(sums, group, above, "_size").select(*group, above, F.col("start").alias("_start"))
    inner = F.coalesce(F.sum(size).over(before.partitionBy(*group, above)), F.lit(0))
    placed = nodes.withColumn(above, range_).withColumn("_inner", inner).join(sums, [*group, above])
    return placed.withColumn("start", F.col("_start") + F.col("_inner")).drop(above, "_start", "_inner")


def _numbered_groups(leaves: DataFrame) -> DataFrame:
    """name, g, n: the groups' names in order, null first, their numbers and rows."""
    names = leaves.groupBy("name").agg(F.count("*").alias("n"))
    # Sorted over partitions; a number counts the rows of a partition in its order.
    spread = names.repartitionByRange("name").sortWithinPartitions("name").withColumn("at", F.monotonically_increasing_id())
    spread = settle(spread.withColumn("part", F.shiftright("at", 33)), "merkle-names")
    sizes = with_starts(spread.groupBy("part").agg(F.count("*").alias("size")), [], "part", "size")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = spread.join(sizes.select("part", "start"), "part")
    return settle(numbered.select("name", (F.col("start") + inside).alias("g"), "n"), "merkle-groups")


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, leaf, claimed, row) with ``place``: in its group by id, null first, rows of
    one id by their leaves."""
    word, bit = F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))")
    keyed = rows.withColumn("word", word)
    nulls = rows.where("id is null").groupBy("g").agg(F.count("*").alias("nulls"))
    bitmap = keyed.where("id is not null").groupBy("g", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    words = with_starts(bitmap, ["g"], "word", "n").join(nulls, "g", "left")
    words = words.select("g", "word", "bits", "n", (F.col("start") + F.coalesce("nulls", F.lit(0))).alias("start"))
    words = settle(words, "merkle-words")
    kept = ["g", "id", "leaf", "claimed"]
    single = F.bit_count("bits") == F.col("n")
    before = F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(id & 63 as int))"))
    plain = keyed.join(words.where(single), ["g", "word"]).select(*kept, (F.col("start") + before).alias("place"))
    repeated = words.where(~single).select("g", "word", "start")
    if repeated.isEmpty() and nulls.isEmpty():
        return plain
    odd = keyed.join(repeated, ["g", "word"]).select(*kept, "word", "row", "start")
    ids = odd.groupBy("g", "word", "id", "start").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("g", "word").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.select("g", "id", (F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("first"))
    odd = odd.join(ids, ["g", "id"]).select(*kept, "row", "first")
    odd = odd.unionByName(rows.where("id is null").select(*kept, "row", F.lit(0).cast("long").alias("first")))
    # The rows of one id, and all without one, may be any number: the first of them is known,
    # so they are told apart by it, and their leaves are summed up like the words of ids.
    digits = F.conv(F.substring("leaf", 1, HASH_BITS // 4), 16, 10).cast("long").alias("digits")
    odd = settle(odd.withColumn("digits", digits), "merkle-odd")
    leaves = odd.groupBy("g", "first", "digits").agg(F.count("*").alias("n"))
    leaves = with_starts(leaves, ["g", "first"], "digits", "n").select("g", "first", "digits", "start")
    odd = add_ranks(odd, ["g", "first", "digits"], ["row"]).join(leaves, ["g", "first", "digits"])
    return plain.unionByName(odd.select(*kept, (F.col("first") + F.col("start") + F.col("rank")).alias("place")))


def _arrays(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """tree, height, block and the slots of each block in order, from tree, height, place, digest, payload."""
    slot = F.struct(F.col("place").bitwiseAND(F.lit((1 << LEVELS) - 1)).alias("slot"), "digest", *payload)
    blocks = nodes.groupBy("tree", "height", F.shiftright("place", LEVELS).alias("block"))
    return blocks.agg(F.array_sort(F.collect_list(slot)).alias("slots"))


def _up(arrays: DataFrame) -> DataFrame:
    """tree, height (levels left), place, digest of each array's top."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights = batch.column("height").to_pylist()
            digests = [reduce_levels([d.encode() for d in ds], min(LEVELS, h))[-1][0].decode()
                       for ds, h in zip(batch.column("digests").to_pylist(), heights, strict=True)]
            left = pa.array([max(0, h - LEVELS) for h in heights], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("tree"), left, batch.column("block"), pa.array(digests, pa.string())],
                                             names=["tree", "height", "place", "digest"])

    rows = arrays.select("tree", "height", "block", F.col("slots.digest").alias("digests"))
    return rows.mapInArrow(top, "tree long, height int, place long, digest string")


def _down(arrays: DataFrame, ways: DataFrame) -> DataFrame:
    """tree, place, way of each slot, given the ways of the arrays (tree, place, way)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tree", "height", "block", "digests", "way"))
            for tree, height, block, digests, way in zip(*columns, strict=True):
                levels = reduce_levels([d.encode() for d in digests], min(LEVELS, height))
                found = [siblings(levels, i) + way for i in range(len(digests))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(found), pa.int64()), pa.array([(block << LEVELS) + i for i in range(len(found))], pa.int64()),
                     pa.array(found, pa.list_(pa.string()))], names=["tree", "place", "way"],
                )

    rows = arrays.join(ways.withColumnRenamed("place", "block"), ["tree", "block"])
    rows = rows.select("tree", "height", "block", F.col("slots.digest").alias("digests"), "way")
    return rows.mapInArrow(split, "tree long, place long, way array<string>")


def _rounds(arrays: DataFrame, highest: int) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of each round, and the roots: tree, digest."""
    rounds, nodes = [arrays], settle(_up(arrays), "merkle-nodes")
    while highest > LEVELS:
        highest -= LEVELS
        rounds.append(settle(_arrays(nodes, []), "merkle-arrays"))
        nodes = settle(_up(rounds[-1]), "merkle-nodes")
    return rounds, nodes.select("tree", "digest")


def _ways(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, place, way of the first round's arrays, from the ways of the roots (tree, way)."""
    ways = tops.select("tree", F.lit(0).cast("long").alias("place"), "way")
    for arrays in reversed(rounds[1:]):
        ways = settle(_down(arrays, ways), "merkle-ways")
    return ways


def _height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def manifest(docs: DataFrame, values: list[Column], group: str = "lang", doc_id: str = "doc_id",
             claimed: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of ``values``. The leaves of a group ascend by id, rows without an id come first
    and rows of one id follow each other by their leaves. Every two nodes become one until one
    is left, the group's subroot; a last one without a partner is hashed alone. The subroots in the order
    of the groups, null first, become the root in the same way. ``proof_sha256`` is the hash of
    the siblings on a leaf's way up, of the empty text where it has none. ``claimed`` is the leaf that is
    checked against the root where it is not null, else the row's own: folded_root is where
    it leads by the row's siblings, and verified whether that is the root. An empty table gives an empty one. Other
    columns than those used in ``values`` and ``claimed`` are not looked at.
    """
    ship(docs.sparkSession)
    claimed = F.lit(None).cast("string") if claimed is None else claimed
    with job_tables(docs.sparkSession):
        leaves = docs.select(
            F.col(group).cast("string").alias("name"), F.col(doc_id).cast("long").alias("id"), leaf(values).alias("leaf"),
            claimed.alias("claimed"), F.monotonically_increasing_id().alias("row"),
        )
        leaves = settle(leaves, "merkle-leaves")
        groups = _numbered_groups(leaves)
        numbers = groups.select(F.col("name").alias("group_name"), "g")
        rows = leaves.join(numbers, F.col("name").eqNullSafe(F.col("group_name"))).select("g", "id", "leaf", "claimed", "row")
        sizes = groups.select(F.col("g").alias("tree"), _height(F.col("n")).alias("height"))
        placed = _places(rows).select(F.col("g").alias("tree"), "place", F.col("leaf").alias("digest"), "id", "claimed")
        arrays = settle(_arrays(placed.join(sizes, "tree"), ["id", "claimed"]), "merkle-arrays")
        rounds, subroots = _rounds(arrays, sizes.agg(F.max("height")).first()[0] or 0)
        height = max(0, groups.count() - 1).bit_length()
        top = F.lit(0).cast("long")
        nodes = subroots.select(top.alias("tree"), F.lit(height).alias("height"), F.col("tree").alias("place"), "digest")
        upper = settle(_arrays(nodes, []), "merkle-arrays")
        top_rounds, roots = _rounds(upper, height)
        no_way = docs.sparkSession.range(1).select(top.alias("tree"), F.array().cast("array<string>").alias("way"))
        group_ways = _down(upper, _ways(top_rounds, no_way)).select(F.col("place").alias("tree"), "way")
        root = roots.first()
        known = subroots.select("tree", F.col("digest").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"))
        return settle(_judged(arrays, _ways(rounds, group_ways), known), "merkle-manifest", lasting=True)


def _judged(arrays: DataFrame, ways: DataFrame, known: DataFrame) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("height", "slots", "way", "subroot", "root"))
            for height, slots, upper, subroot, root in zip(*columns, strict=True):
                levels = reduce_levels([s["digest"].encode() for s in slots], min(LEVELS, height))
                found = []
                for at, s in enumerate(slots):
                    way = siblings(levels, at) + upper
                    folded = fold((s["claimed"] or s["digest"]).encode(), way).decode()
                    proof = hashlib.sha256("".join(step[1:] for step in way).encode()).hexdigest()
                    found.append((s["id"], s["digest"], subroot, root, proof, folded, folded == root))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), _JUDGED.types, strict=True)],
                    schema=_JUDGED)

    rows = arrays.join(ways.withColumnRenamed("place", "block"), ["tree", "block"]).join(known, "tree")
    rows = rows.select("height", "slots", "way", "subroot", "root")
    return rows.mapInArrow(judge, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                  "folded_root string, verified boolean")


_JUDGED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
