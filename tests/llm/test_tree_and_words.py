"""Spelling variants, Merkle manifest and SimHash: brute force on small tables and on whole ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import merkle, simhash, spelling
from tallyframe.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def query(spark, name, rows, folder, **extra):
    """The rows of a registered query over a table of ``rows``."""
    docs = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCS)
    docs.withColumns({c: F.lit(x) for c, x in extra.items()}).write.parquet(f"{folder}/documents.parquet")
    return QUERIES[name](spark, folder).collect()


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*(f.split()[0] for f in DOCS.split(", "))).collect()]


# Spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts):
    near = defaultdict(list)
    deleted = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            deleted["r", i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in counts:
                deleted["d", w[:i] + w[i + 1 :], w] |= {w, w[:i] + w[i + 1 :]}
    pairs = {(a, b) for group in deleted.values() for a in group for b in group if a != b}
    for a, b in pairs:
        assert one_edit(a, b)
        near[a].append(b)
    forms, out = {}, {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * n:
            forms[w] = best
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, len(near[w]), counts[forms[w]] if w in forms else None)
    return out


def plain_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def forms_of(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_query(spark):
    found = QUERIES["op11_spelling_variants"](spark, SF_DIR).collect()
    assert forms_of(found) == plain_forms(plain_words(documents(spark))) and len(found) == len({r.word for r in found})


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=8), max_size=60), st.integers(1, 70))
def test_cell_finds_what_differs_by_one(words, least):
    least = 5 + least % 3
    held = sorted(w for w in words if len(w) in (least, least + 1))
    asking = [w for w in held if len(w) == least] + ["z" * least]
    if held:
        asks, holds = spelling.near_in_cell(held, asking, least)
        found = sorted((asking[a], held[b]) for a, b in zip(asks, holds, strict=True))
        half = least // 2
        assert found == sorted((a, b) for a in asking for b in held if a[:half] == b[:half] and one_edit(a, b))


@pytest.mark.parametrize("cell", [4096, 8])
def test_spelling_in_large_cells(spark, monkeypatch, cell):
    """Words that all begin alike are more than a cell holds and are cut into parts."""
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    rng = random.Random(5)
    words = {"commonbegin" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) for _ in range(150)}
    words |= {"".join(rng.choice("xyÿ") for _ in range(rng.randrange(5, 8))) for _ in range(150)} | {"q" * 3000, "q" * 3001}
    counts = {w: rng.choice([3, 3, 4, 7, 20, 50, 200]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert forms_of(spelling.spelling_forms(table).collect()) == plain_forms(counts)


def test_spelling_edges(spark, folder):
    rows = [(1, "HOUSE house Housé house houses houses, houses; ÀÉÎÕÜ ÀÉÎÕÜ àéîõü ÀÉÎÕÜ"), (None, "house " * 9), (2, None), (3, ""),
            (2, "house" * 50_000), (2, "hous hous hous 12345 12345 12345"), (1, "house"), (1, "house")]
    assert forms_of(query(spark, "op11_spelling_variants", rows, folder, run=1, id="x", word=2)) == plain_forms(plain_words(rows))


def test_spelling_of_nothing(spark, folder):
    assert query(spark, "op11_spelling_variants", [], folder) == []


# Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def way_up(levels, at):
    for nodes in levels[:-1]:
        yield at & 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else None
        at >>= 1


def plain_manifest(rows):
    groups, out = defaultdict(list), []
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf([doc_id, source, lang, n_chars, text])
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        claimed = plain_leaf([doc_id, source, lang, n_chars + 1, text]) if tampered else leaf
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, claimed, doc_id))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf for _, _, leaf, _, _ in sorted(groups[x], key=lambda g: g[:3])]) for x in names}
    top = plain_tree([trees[x][-1][0] for x in names]) if names else []
    for g, x in enumerate(names):
        for i, (_, _, leaf, claimed, doc_id) in enumerate(sorted(groups[x], key=lambda g: g[:3])):
            folded, proof = claimed, ""
            for right, beside in [*way_up(trees[x], i), *way_up(top, g)]:
                folded = sha((beside or "") + folded if right else folded + (beside or ""))
                proof += beside or ""
            root = top[-1][0]
            out.append((doc_id, leaf, trees[x][-1][0], root, sha(proof), folded, folded == root))
    return Counter(out)


def test_merkle_query(spark):
    found = QUERIES["op12_merkle_manifest"](spark, SF_DIR).collect()
    assert Counter(map(tuple, found)) == plain_manifest(documents(spark))
    assert {r.verified for r in found} == {True, False}


@pytest.mark.parametrize("levels", [10, 2])
def test_merkle_edges(spark, folder, monkeypatch, levels):
    """Ids far apart, negative, null, repeated with equal and with other rows; groups of one and without a name."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(rng.choice([i, -i, i << 40, -(i << 50)]), f"text {i}", rng.choice(["en", "de"]), "s", i) for i in range(1, 150)]
    rows += [(None, f"t{i % 4}", "en", "s", 1) for i in range(9)] + [(5, f"u{i % 3}", "en", None, None) for i in range(9)]
    rows += [(2**63 - 1, "x" * 200_000, "fr", "s", 2**63 - 1), (-(2**63), None, None, None, None), (7, "", "é", "", 0), (0, "z", "", "s", 3)]
    found = query(spark, "op12_merkle_manifest", rows, folder, g=1, word=2, row=3, id=4, leaf=5)
    # A number that cannot grow is left as it is.
    rows = [r if r[4] != 2**63 - 1 else (*r[:4], r[4]) for r in rows]
    assert Counter(map(tuple, found)) == plain_manifest(rows)


@pytest.mark.parametrize("count", [0, 1, 2])
def test_merkle_of_few_rows(spark, folder, count):
    rows = [(i, "t", "en", "s", 1) for i in range(count)]
    assert Counter(map(tuple, query(spark, "op12_merkle_manifest", rows, folder))) == plain_manifest(rows)


def test_many_groups(spark, folder):
    rows = [(i, "t", f"lang {i % 37}" if i % 5 else None, "s", 1) for i in range(200)]
    assert Counter(map(tuple, query(spark, "op12_merkle_manifest", rows, folder))) == plain_manifest(rows)


# SimHash

def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(prints):
    """The smallest of each distinct print's component, by comparing all pairs."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    array = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= 2):
            a, b = sorted((root(p), root(prints[j])))
            parent[b] = a
    return {p: root(p) for p in prints}


def plain_simhash(rows):
    prints = [plain_print(r[1]) for r in rows]
    labels, least = plain_labels(prints), {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[labels[p]] = min(least.get(labels[p], r[0]), r[0])
    return Counter((r[0], f"{p:016x}", least.get(labels[p])) for r, p in zip(rows, prints, strict=True))


def test_simhash_query(spark):
    found = QUERIES["op13_simhash_near_dedup"](spark, SF_DIR).collect()
    assert Counter(map(tuple, found)) == plain_simhash(documents(spark))


def test_simhash_edges(spark, folder):
    words = [f"w{i}" for i in range(400)]
    rows = [(9, " ".join(words)), (4, " ".join(words[:399])), (None, " ".join(words).upper()), (None, None), (8, ""), (7, " \n\t"),
            (3, "one"), (3, "one"), (5, "One  two"), (5, "x " * 60_000), (6, "x  x\nx"), (None, "alone")]
    assert Counter(map(tuple, query(spark, "op13_simhash_near_dedup", rows, folder, key=1, label=2, n=3))) == plain_simhash(rows)


def test_simhash_of_nothing(spark, folder):
    assert query(spark, "op13_simhash_near_dedup", [], folder) == []


@pytest.mark.parametrize("rounds", [2, 0])
@pytest.mark.parametrize("kind", ["chain", "ball", "half"])
def test_component_labels(spark, monkeypatch, kind, rounds):
    """Long chains, dense groups of thousands of links, and long lists of prints that are not linked."""
    monkeypatch.setattr(simhash, "LEADER_ROUNDS", rounds)
    rng = random.Random(kind)
    base = rng.getrandbits(64)
    if kind == "chain":
        prints = {base}
        for _ in range(300):
            base ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(base)
    elif kind == "ball":
        prints = {base ^ sum(1 << b for b in rng.sample(range(14), rng.randrange(8))) for _ in range(600)}
        prints |= {base ^ (1 << 40 | 1 << 41 | 1 << 42) ^ (1 << b) for b in range(20)}
    else:
        prints = {(base >> 32 << 32) | rng.getrandbits(32) for _ in range(600)}
        prints |= {p ^ 0b101 << rng.randrange(30) for p in list(prints)[:40]} | {p ^ 1 << 50 for p in list(prints)[:40]}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    found = {r.print: r.label for r in simhash.component_labels(spark.createDataFrame(signed, "print long")).collect()}
    assert set(found) == {p for p, in signed}

    def grouped(labels):
        groups = defaultdict(set)
        for p, label in labels.items():
            groups[label].add(p)
        return sorted(sorted(g) for g in groups.values())

    plain = {int(np.uint64(p).astype(np.int64)): q for p, q in plain_labels(prints).items()}
    assert grouped(found) == grouped(plain)
