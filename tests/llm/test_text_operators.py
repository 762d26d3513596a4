"""Exact and near duplicates, languages, token counts: small tables and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, language_id, near_dedup, token_counts
from tallyframe.llm.queries import QUERIES, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], schema)


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


EDGES = [(5, "a b"), (3, "ab"), (9, "a\tb "), (1, None), (2, ""), (4, " \n"), (7, "x" * 300_000), (8, "x" * 300_000),
         (6, "AB"), (10, "a b")]


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.lit("same")])
def test_exact_groups(spark, content_hash):
    found = {r.doc_id: r for r in exact_dedup.exact_groups(docs_of(spark, EDGES), content_hash=content_hash).collect()}
    assert len(found) == len(EDGES)
    for doc_id, text in EDGES:
        group = [(-len(t or ""), i) for i, t in EDGES if bare(t) == bare(text)]
        row = found[doc_id]
        assert (row.keep_id, row.group_size, row.kept) == (min(group)[1], len(group), doc_id == min(group)[1])
        assert row.text_sha256 == hashlib.sha256(bare(text).encode()).hexdigest()


def test_exact_groups_without_ids_and_repeated(spark):
    rows = [(None, "a a"), (4, "aa"), (None, "b"), (None, "b"), (7, "c"), (7, "c")]
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs_of(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(
        [(None, 4, 2, False), (4, 4, 2, True), (None, None, 2, True), (None, None, 2, False), (7, 7, 2, True), (7, 7, 2, False)], key=str
    )
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, rows).withColumns({"hash": F.lit(1), "bytes": F.lit(2), "group_size": F.lit(3), "kept": F.lit(4)})
    assert exact_dedup.exact_groups(clash).count() == 6


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_rows(seed, n):
    """Families of edited copies, passages that many share, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    family = [word() for _ in range(60)]
    rows = [(1000, None), (1001, " \n"), (1002, "one two"), (1003, "One  TWO "), (1004, "one two three"), (1005, "é É")]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            words = list(family)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
        elif kind == 1:
            words = [word() for _ in range(rng.randrange(3, 30))] + passage
        elif kind == 2:
            words = passage + [word() for _ in range(rng.randrange(1, 10))]
        else:
            words = rng.choice(rows)[1].split() if rng.random() < 0.5 and rows[-1][1] else [word() for _ in range(20)]
            words = [w if rng.random() > 0.02 else word() for w in words or ["x"]] if words else ["x"]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return [(i, t) for i, t in rows]


@pytest.mark.parametrize(("seed", "long_list"), [(1, 32), (2, 3)])
def test_near_groups(spark, monkeypatch, seed, long_list):
    monkeypatch.setattr(near_dedup, "LONG_LIST", long_list)
    rows = [(i, t or "") for i, t in near_rows(seed, 120)]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs_of(spark, rows)).collect()}
    assert found == brute_groups(rows)


def test_near_groups_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (3, text + " end"), (3, "other words of id three are here"), (8, None), (8, None), (None, "alone")]
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs_of(spark, rows)).collect()}
    assert found == {(None, 36, 3, False), (5, 36, 3, False), (3, 37, 3, True), (3, 3, 3, True), (8, 0, 8, True),
                     (None, 1, None, True)}
    assert near_dedup.near_groups(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("n", "digest", "sketch", "node", "label", "kept")})
    assert near_dedup.near_groups(clash).count() == len(rows)


@pytest.mark.parametrize("shared", [23, 24, 27, 30, 31])
def test_estimate_rules_out_below_a_chance_of_1e_9(spark, shared):
    """Of the 64 smallest of the union, ``shared`` are in both sketches."""
    common, rest = list(range(shared)), list(range(shared, 64))
    sketches = [(0, common + rest), (1, common + list(range(1000, 1000 + len(rest))))]
    suspects = spark.createDataFrame(sketches, "node long, sketch array<long>")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    found = near_dedup._estimated(pairs, suspects, 0.75).count()
    chance = sum(math.comb(64, k) * 0.75**k * 0.25 ** (64 - k) for k in range(shared + 1))
    assert found or chance < 1e-9


def test_long_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(100)]
    found = near_dedup.near_groups(docs_of(spark, rows)).select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [0]


def test_near_dedup_query(spark):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op5_minhash_near_dedup"](spark, SF_DIR).collect()}
    assert found == brute_groups(list(texts_of(spark).items()))


def test_language_query_on_held_out_rows(spark):
    found = QUERIES["op8_language_id"](spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = [(i, f"the quick brown fox number {i}", "en") for i in range(20)]
    rows += [(100 + i, f"der schnelle braune fuchs nummer {i}", "de") for i in range(20)]
    model = language_id.fit(docs_of(spark, rows + [(999, None, "xx"), (998, "words", None), (997, "12 !", "zz")]))
    assert model.languages == ["de", "en"]
    asked = docs_of(spark, [(1, None), (2, ""), (3, "123 .,"), (None, "the fox"), (5, "der fuchs"), (5, "der fuchs"),
                            (6, "漢字" * 10), (7, "the brown fox " * 50_000), (8, "É")])
    found = [(r.doc_id, r.lang_pred) for r in language_id.identify(asked.withColumn("score", F.lit("x")), model).collect()]
    assert found[:6] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de"), (5, "de")]
    assert found[7] == (7, "en") and {x for _, x in found[6:]} <= {"de", "en"}
    scores = {r.doc_id: (r.score, r.rejected) for r in language_id.identify(asked, model).collect()}
    assert scores[1] == (0.0, True) and scores[6][1] and 0 <= scores[8][0] <= 1
    assert language_id.identify(docs_of(spark, []), model).count() == 0
    nothing = language_id.fit(docs_of(spark, []))
    assert {r.lang_pred for r in language_id.identify(asked, nothing).collect()} == {"und"}


def plain_ngrams(text):
    letters = [b if b >= 0x80 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode()]
    found = Counter()
    for n, mark in ((2, 1 << 24), (3, 0)):
        for i in range(len(letters) - n + 1):
            part = letters[i : i + n]
            if set(part) != {32}:
                found[((int.from_bytes(bytes(part)) | mark) * 2654435761 % 2**32) >> 19] += 1
    return found


def plain_language_model(rows):
    """idf and, language by language, centroids: plain dictionaries and loops."""
    grams = [plain_ngrams(text) for text, _ in rows]
    seen = Counter(f for g in grams for f in g)
    idf = {f: math.log((1 + len(rows)) / (1 + n)) + 1 for f, n in seen.items()}

    def unit(vector):
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1
        return {f: x / norm for f, x in vector.items()}

    def vector(found):
        return unit({f: (1 + math.log(n)) * idf.get(f, math.log(1 + len(rows)) + 1) for f, n in found.items()})

    def dot(a, b):
        return sum(x * b[f] for f, x in a.items() if f in b)

    def total(vectors):
        out = Counter()
        for v in vectors:
            out.update(v)
        return out

    centroids = []
    for language in sorted({lang for _, lang in rows}):
        own = [vector(g) for g, (_, lang) in zip(grams, rows, strict=True) if lang == language]
        centers = [max(own, key=lambda v, mean=unit(total(own)): dot(v, mean))]
        while len(centers) < min(language_id.CENTROIDS, len(own)):
            centers.append(min(own, key=lambda v: max(dot(v, c) for c in centers)))
        for _ in range(12):
            nearest = [max(range(len(centers)), key=lambda c, v=v: dot(v, centers[c])) for v in own]
            parts = [[v for v, n in zip(own, nearest, strict=True) if n == c] for c in range(len(centers))]
            centers = [unit(total(part)) if part else center for part, center in zip(parts, centers, strict=True)]
        centroids += [(language, c) for c in centers]
    return vector, dot, centroids


def test_language_query_is_the_nearest_centroid(spark):
    """Every row of the query against plain centroids; the sample holds all labelled rows of this table."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    learned = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert len(learned) < language_id.SAMPLE_ROWS / 4
    # Ties of equal texts are broken by the order of the rows, so these are put in one.
    vector, dot, centroids = plain_language_model(sorted(((r.text, r.lang) for r in learned), key=lambda x: (x[1], sample_key(x[0]))))
    found = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF_DIR).collect()}
    assert set(found) == {r.doc_id for r in docs}
    for r in docs:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score, found[r.doc_id].rejected) == ("und", 0.0, True)
            continue
        own = vector(plain_ngrams(r.text))
        scored = sorted(((dot(own, c), language) for language, c in centroids), reverse=True)
        assert abs(found[r.doc_id].score - min(1, scored[0][0])) < 2e-3, r.doc_id
        if scored[0][0] - max((s for s, language in scored if language != scored[0][1]), default=0) > 4e-3:
            assert found[r.doc_id].lang_pred == scored[0][1]


def sample_key(text):
    """The order in which the sample's rows are taken."""
    seen, counts = language_id.ngram_counts(text)
    return seen.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()


def test_token_count_query(spark):
    reference, pre_token = unigram_reference(), token_counts.PRE_TOKEN
    texts = texts_of(spark)
    found = QUERIES["op9_token_counts"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        tokens = len(reference.encode("▁" + text.replace(" ", "▁")).tokens) if text else 0
        words = len(pre_token.findall(" " + text)) if text else 0
        assert (r.n_tokens, r.n_pretokens, r.n_chars) == (tokens, words, len(text)), r.doc_id


def unigram_reference(byte_fallback=True):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, models

    model = tokenizer_path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=model)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    # The library matches the names of bytes and controls as text, so texts avoid "<".
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))


def test_token_counts_match_the_library(spark):
    reference = unigram_reference()
    texts = list(texts_of(spark).values())[:60] + ["", "  two  spaces ", "a\nb\n\n c", "漢字ꙮ 🦊🦊 x", "word" * 3000, None]
    found = token_counts.count_tokens(docs_of(spark, list(enumerate(texts))), tokenizer_path("piece_bpe_32k.model"))
    for r in found.collect():
        text = texts[r.doc_id]
        expected = len(reference.encode("▁" + text.replace(" ", "▁")).tokens) if text else 0
        assert (r.n_tokens, r.n_chars) == (expected, len(text or "")), text


def test_token_counts_edges(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, "")]
    docs = docs_of(spark, rows).withColumns({"n_tokens": F.lit("x"), "n_pretokens": F.lit(1)})
    found = [(r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).collect()]
    assert found == [(None, 2, 2), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert token_counts.count_tokens(docs_of(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_trie_shares_prefixes_and_may_be_emptied():
    scores = {"a": -3.0, "b": -3.0, "ab": -4.0, "abb": -9.0}
    whole, small = token_counts.PrefixTrie(scores, False), token_counts.PrefixTrie(scores, False, max_nodes=3)
    words = ["ab", "abb", "aba", "b", "zz", "abab", "abb"]
    assert [whole.count(w) for w in words] == [small.count(w) for w in words] == [1, 2, 2, 1, 2, 2, 2]
    assert len(whole.forward) == len({w[:i] for w in words for i in range(len(w) + 1)})
