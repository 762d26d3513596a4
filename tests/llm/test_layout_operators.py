"""Packing, token files, URL rules, search, mixing, shards: small tables and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.verify import difference, duck, frame_of
from tallyframe.llm import mixing, near_dedup, packing, sharding, token_files, tokens, topk, url_filter
from tallyframe.llm.queries import (
    BLOCK_ROWS, ORACLES, QUERIES, RULES, SEQUENCE_LENGTH, SHARES, op6_exact_topk, tokenizer_path,
)
from tallyframe.llm.tokens import WordEncoder

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), frame_of(duck(SF_DIR), ORACLES[name])) == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aB'sré.,!? \n\t\r\x0b\x0c\u00a0\u2028\u0301Å;:1九<|>_-", "<|endoftext|>", "<|ENDOFTEXT|>",
                                          "<|startoftext|>"]), max_size=30).map("".join), max_size=5))
def test_words_encode_like_whole_texts(texts):
    import pyarrow as pa

    from tokenizers import Tokenizer

    encode = _encoder()
    tokenizer: Tokenizer = encode.tokenizer
    flat, bounds = encode.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_remembers_so_many_words(monkeypatch):
    """Words met once are forgotten, those met again stay, and ids are the same whatever is remembered."""
    import pyarrow as pa

    encode = WordEncoder(tokenizer_path())
    for start in range(0, 400_000, 100_000):
        encode.encode(pa.array([" ".join(["again", *map(str, range(start, start + 100_000))])]))
    assert len(encode.words) <= 300_000 and len(encode.again) == len(encode.words) and "again" in encode.words.to_pylist()
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    encode = WordEncoder(tokenizer_path())
    for start in range(0, 300, 7):
        text = " ".join(f"word{i % 40} {i}" for i in range(start, start + 12))
        flat, _ = encode.encode(pa.array([text]))
        assert flat.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encode.words) <= 60


@pytest.mark.parametrize("module", [packing, near_dedup])
def test_workers_get_texts_a_few_megabytes_at_a_time(spark, folder, monkeypatch, module):
    slices = module.slices

    def noted(batch, text, most):
        with open(f"{folder}/batches", "a") as out:
            print(batch.nbytes, file=out)
        return slices(batch, text, most)

    monkeypatch.setattr(module, "slices", noted)
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 600) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if module is packing:
        found = packing.pack(packing.pieces(docs, tokenizer_path(), 2048), 2048)
    else:
        found = near_dedup.near_groups(docs)
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == set(range(2500))
    sizes = [int(n) for n in open(f"{folder}/batches")]
    assert sum(sizes) > 10 << 20 and max(sizes) < 3 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def _encoder(found=[]):  # noqa: B006
    if not found:
        found.append(WordEncoder(tokenizer_path()))
    return found[0]


# Packing

@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
def test_plan_fills_bins(counts):
    capacity = 60
    runs = packing.plan(counts, capacity)
    used = Counter()
    for bins, gap, held in runs:
        assert sum(n * k for n, k in held) + gap == capacity and gap >= 0
        assert sum(k for n, k in held if 3 * n > capacity) <= 2
        used.update({n: bins * k for n, k in held})
    assert {n: c for n, c in used.items()} == {n: c for n, c in counts.items() if c}
    bins, total = sum(b for b, _, _ in runs), sum(n * c for n, c in counts.items())
    # No packing has fewer: by volume, with one item above a half in a bin, or two above a third.
    halves, thirds = (sum(c for n, c in counts.items() if k * n > capacity) for k in (2, 3))
    least = max(-(-total // capacity), halves, _unmatched(counts, capacity), -(-thirds // 2))
    assert bins <= 11 / 9 * least + 2


def _unmatched(counts, capacity):
    """The fewest bins for the items above a third: a plain largest-fit matching."""
    left, bins = sorted(n for n, c in counts.items() for _ in range(c) if 3 * n > capacity), 0
    while left:
        first, bins = left.pop(), bins + 1
        fits = [n for n in left if n + first <= capacity]
        if fits:
            left.remove(max(fits))
    return bins


def check_packed(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, library):
    rows = QUERIES["op2_best_fit_packing"](spark, SF_DIR).collect()
    sequences = check_packed(rows, SEQUENCE_LENGTH)
    total, expected = 0, {}
    for doc_id, text in texts_of(spark).items():
        ids = library(text) + [0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), SEQUENCE_LENGTH)):
            part = ids[start : start + SEQUENCE_LENGTH]
            expected[doc_id, piece] = (start, len(part), crc(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    assert sequences <= -(-total // SEQUENCE_LENGTH) + 1


def test_packing_edges_and_sequences(spark, library):
    rows = [(None, "one", None), (1, None, "s"), (1, None, "s"), (2, "", None), (3, "words " * 50, None), (4, "words " * 19, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("rank", "length", "sequence_id", "ids")})
    packed = packing.pack(packing.pieces(docs, tokenizer_path(), 20), 20)
    found = packed.collect()
    assert sorted((r.doc_id or -1, r.length) for r in found) == [(-1, 2), (1, 1), (1, 1), (2, 1), (3, 11), (3, 20), (3, 20), (4, 20)]
    assert check_packed(found, 20) == 4
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in found:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer_path(), 20), 20).count() == 0


# Token files

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000) | st.sampled_from([0, 0, 100_000]), max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(steps).astype(int)
    coded = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
    assert coded.all().tolist() == values.tolist() == [coded.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1500, 20_000))
    assert len(token_files.EliasFano.encode(values).to_bytes()) * 8 < 20_000 * (3.5 + np.log2(values[-1] / 20_000))


def test_token_files_query(spark, library):
    rows = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_files"](spark, SF_DIR).collect()}
    start, expected = 0, {}
    for doc_id, text in sorted(texts_of(spark).items()):
        ids = library(text) + [1]
        expected[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert rows == expected


def test_token_file_edges(spark, folder, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 2)
    rows = [(7, "b", None), (None, "null id", None), (3, None, None), (3, None, None), (9, "", None), (8, "x " * 40_000, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"part": F.lit(1), "ends": F.lit(2), "tie": F.lit(3)})
    token_files.write_token_files(docs, f"{folder}/files", tokenizer_path(), 1)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, f"{folder}/files").collect())
    assert found == [(0, None, 3), (3, 3, 1), (4, 3, 1), (5, 7, 2), (7, 8, 40_001), (40_008, 9, 1)]
    assert token_files.read_document(spark, f"{folder}/files", 7) == library("b") + [1]
    assert token_files.read_document(spark, f"{folder}/files", 70) is None
    token_files.write_token_files(docs.limit(0), f"{folder}/none", tokenizer_path(), 1)
    assert token_files.read_token_files(spark, f"{folder}/none").count() == 0


# URL rules

def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, False, None, default))
    return host, path, best[3], best[4]


def test_url_rules(spark):
    rng = random.Random(5)
    hosts = ["a.b.c", "b.c", "c", "x.b.c", "bb.c", "A.B.C", "c.", ".c", "", "a b", "user@b.c:80"]
    paths = ["", "/", "/d", "/d/", "/d/e", "/d/e/f.html", "//", "/D/", "/é/"]
    rules = [(rng.choice(hosts[:6]).lower(), rng.choice(paths), rng.choice(["block", "allow"])) for _ in range(9)]
    urls = [f"http://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/d/", "#x")] + [None, "", "no", "://", "a://b://c/d"]
    urls += ["http://" + "a." * 300 + "b.c" + "/d" * 3000, "ht\ntp://c/d\n/e"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(1, urls[1], "h", 1)],
                                  "page_id long, url string, rule string, short int")
    for chosen in (rules, RULES, []):
        judged = url_filter.judge(pages, url_filter.rule_table(spark, chosen)).collect()
        assert len(judged) == len(urls) + 1
        for r in judged:
            assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id], chosen), urls[r.page_id]
    odd = url_filter.rule_table(spark, [("", "", "block"), (None, "/", "block"), ("b.c", None, "block")])
    assert {r.verdict for r in url_filter.judge(pages, odd).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), odd).count() == 0


# Search

def brute_search(rows, queries, k):
    found = {}
    for q, x in queries:
        scores = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q and len(x) == len(y))
        found[q] = [(i, -s) for s, i in scores[:k]]
    return {q: hits for q, hits in found.items() if hits}


@pytest.mark.parametrize("size", [1, 3, 120])
def test_search(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(size)
    rows = [(i, rng.integers(-5, 6, 4).tolist()) for i in range(size)] + [(500, [1, 2]), (502, [3, 4]), (504, []), (506, [])]
    extra = [(None, [1, 2, 3, 4]), (600, None)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + extra], "vec_id long, values array<long>, rank string")
    hits = defaultdict(list)
    found = topk.search(frame, frame.where("vec_id % 2 = 0").union(frame.where("vec_id = 0")), 5).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        hits[r.query_id].append((r.vec_id, r.score))
    assert hits == brute_search(rows, [r for r in rows if r[0] % 2 == 0], 5)
    assert [r.rank for r in sorted(found, key=lambda r: (r.query_id, r.rank)) if r.query_id == 0] == list(range(1, len(hits[0]) + 1))


def test_search_meets_all_blocks_in_many_partitions(spark, monkeypatch):
    """Blocks of both sides must be dealt alike: with partitions of their own, cells were lost."""
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-5, 6, 4).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, values array<long>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = topk.search(frame, frame.where("vec_id % 2 = 0"), 5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hits = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        hits[r.query_id].append((r.vec_id, r.score))
    assert hits == brute_search(rows, [r for r in rows if r[0] % 2 == 0], 5)


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 300, (12, 16))
    points = np.floor(centers[rng.integers(0, 12, 4000)] + rng.normal(0, 5, (4000, 16)))
    ids = rng.permutation(4000)
    for query, found, scores in topk.best_in_block(ids[:5], points[:5], ids, points, 10):
        own = points[np.flatnonzero(ids == query)[0]]
        exact = sorted((-int(p @ own), int(i)) for i, p in zip(ids, points, strict=True) if i != query)[:10]
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == exact


def test_search_answers_queries_together():
    """Products of matrices for many queries at once, not a step for each query and part of the block."""
    rng = np.random.default_rng(4)
    points, products = rng.integers(-3, 4, (600, 8)), []
    scorer = topk._scorer

    def counted(*sides):
        score = scorer(*sides)
        return lambda *part: products.append(1) or score(*part)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topk, "_scorer", counted)
        hits = {q: list(zip(f.tolist(), s.tolist(), strict=True))
                for q, f, s in topk.best_in_block(np.arange(200), points[:200], np.arange(600), points, 7, step=50)}
    assert hits == brute_search(list(enumerate(points)), list(enumerate(points[:200])), 7)
    assert len(products) <= 2 * -(-200 // 64)


def test_exact_topk_goes_by_rows(spark, folder):
    """Copies of a query's row, rows with its id and rows without an id are candidates; scores are
    exact above 2^53; a query row that comes twice is asked twice."""
    rng = np.random.default_rng(8)
    rows = [(i % 50, rng.integers(-3, 4, 4).tolist()) for i in range(120)] + [(None, [3.0, 3.0, 3.0, 3.0]), (None, None)]
    large, small = 2.0**21 + 1 / 64, 1 / 64
    big = [(20, [large, small, small]), (20, [large, small, small]), (5, [large, small, 0.0]), (4, [large, small, small])]
    for some in (rows, big, big[:1]):
        out = f"{folder}/{len(some)}"
        floats = [(i, v and [float(x) for x in v]) for i, v in some]
        spark.createDataFrame(floats, "vec_id long, embedding array<double>").write.parquet(f"{out}/embeddings.parquet")
        found = op6_exact_topk(spark, out).collect()
        usable = [(i, [int(64 * x // 1) for x in v]) for i, v in some if v]
        wanted = []
        for n, (q, x) in enumerate(usable):
            if q is not None and q % 20 == 0:
                hits = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i or 0) for m, (i, y) in enumerate(usable) if m != n)
                wanted += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(hits[:20], 1)]
        assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found)


def test_vectors_with_gaps_take_no_part(spark):
    rows = [(0, [1.0, None]), (20, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (60, None), (80, [0.51, -0.01])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = frame.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v")).where("v is not null").collect()
    assert [(r.vec_id, r.v) for r in found] == [(80, [32, -1])]
    empty = frame.limit(0).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("values"))
    assert topk.search(empty, empty, 20).count() == 0


# Mixing

@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 5, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}, {"a": 7, "b": 3}, SHARES,
                                    {"a": 3, "b": 3, "c": 3, "d": 2, "z": 0}])
def test_schedule_stays_within_one_block(spark, shares):
    rows = sorted((r.slot, r.pool, r.turn) for r in mixing.schedule(spark, shares).collect())
    period, had = sum(shares.values()), Counter()
    assert [r[0] for r in rows] == list(range(period))
    for slot, pool, turn in rows:
        assert turn == had[pool]
        had[pool] += 1
        assert all(abs(had[p] * period - w * (slot + 1)) < period for p, w in shares.items())


def test_mix_query(spark):
    rows = QUERIES["op7_mixing"](spark, SF_DIR).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(source.keys())
    check_mix(rows, {mixing.REST: 1} | SHARES, BLOCK_ROWS)


def check_mix(rows, shares, block_rows):
    assert all(r.pool == (r.source if r.source in shares else mixing.REST) for r in rows)
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.pool, r.block].append(r)
    slots = {key: {r.slot for r in held} for key, held in blocks.items()}
    assert all(len(s) == 1 for s in slots.values())
    assert len({next(iter(s)) for s in slots.values()}) == len(slots)
    count = Counter(pool for pool, _ in blocks)
    for (pool, block), held in blocks.items():
        assert sorted(r.place for r in held) == list(range(len(held))) and len(held) <= block_rows
        assert len(held) == block_rows or block == count[pool] - 1
    # Before the horizon every slot belongs to a pool within one block of its share.
    period, had = sum(shares.values()), Counter()
    mixed = sorted((r.slot, r.pool) for r in rows if r.in_mix and r.place == 0)
    for slot, pool in mixed:
        had[pool] += 1
        assert all(abs(had[p] * period - shares[p] * (slot + 1)) < period for p in count)


def test_mix_edges(spark):
    rows = [(i, "t", "a") for i in range(50)] + [(None, "t", "a")] * 2 + [(9, "t", "b")] * 7 + [(i, None, None) for i in range(9)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("rank", "slot", "block", "pool", "turn")})
    found = mixing.mix(docs, {"a": 3, "b": 2}, 4).collect()
    assert len(found) == len(rows)
    check_mix(found, {"a": 3, "b": 2, mixing.REST: 1}, 4)
    assert mixing.mix(docs.limit(0), {"a": 3}, 4).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(spark, {"a": mixing.MAX_PERIOD + 1})
    ordered = [(r.slot, r.place) for r in mixing.ordered(mixing.mix(docs, {"a": 3, "b": 2}, 4)).collect()]
    assert ordered == sorted(ordered)


def test_capped_shares(spark):
    rows = [(i, "t", "a") for i in range(60)] + [(i, "t", f"s{i % 4}") for i in range(40)] + [(1, "t", None)]
    docs = spark.createDataFrame(rows, DOCS)
    shares, capped = mixing.capped_shares(docs, 0.25, 100)
    assert capped == {"a"} and shares["a"] == 25 and all(17 <= shares[f"s{i}"] <= 19 for i in range(4))
    assert mixing.capped_shares(docs.limit(0), 0.25, 100) == ({}, set())


# Shards

def test_shards(spark, folder):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(60), "s") for i in range(400)] + [(900, "x" * 5000, "s"), (None, "n", "s"), (None, None, None)]
    rows += [(77, "y" * 90, "s")] * 6
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("hash", "cell", "bits", "bytes", "prefix")})
    for limit in (200, 1000, 10**9):
        found = sharding.assign_shards(docs, limit).collect()
        assert Counter((r.doc_id, r.bytes) for r in found) == Counter((i, len((t or "").encode())) for i, t, _ in rows)
        sizes, counts = Counter(), Counter()
        for r in found:
            sizes[r.shard] += r.bytes
            counts[r.shard] += 1
        names = sorted(sizes)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
        for r in found:
            assert (r.shard_bytes, r.shard_rows, r.over_limit) == (sizes[r.shard], counts[r.shard], sizes[r.shard] > limit)
        assert {r.doc_id for r in found if r.over_limit} == ({900, 77} if limit == 200 else {900} if limit == 1000 else set())
        # A bucket was split only where it had to be: its parent would not fit.
        for name in names:
            assert not name or sum(n for other, n in sizes.items() if other.startswith(name[:-1])) > limit
    assert sharding.assign_shards(docs.limit(0), 10).count() == 0
    sharding.write_shards(docs, f"{folder}/shards", 1000)
    back = spark.read.parquet(f"{folder}/shards")
    assert back.count() == len(rows) and set(docs.columns) < set(back.columns)
