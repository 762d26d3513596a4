"""The corpus pipeline, stage by stage, against plain versions of each stage."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from tallyframe.llm import language_id
from tallyframe.sources.scratch import scratch_root
from .test_layout_operators import check_packed
from .test_text_operators import bare, brute_groups

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.settle(stage(spark, docs, SF_DIR), "test-stage")
        out[name] = (docs, result)
        docs = result
    return out


def pairs(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "best-fit packing" or after.columns == before.columns
        assert after.count() > 0


def test_language_stage(stages):
    before, after = stages["language id"]
    model = language_id.fit(before)
    assert set(pairs(after)) == {i for i, r in pairs(before).items() if not model.predict(r.text)[2]}
    assert after.count() >= 0.98 * before.count()


def test_exact_stage(stages):
    before, after = stages["exact dedup"]
    best = {}
    for r in before.collect():
        best[bare(r.text)] = min(best.get(bare(r.text), (1, 0)), (-len(r.text), r.doc_id))
    assert set(pairs(after)) == {i for _, i in best.values()}


def test_near_stage(stages):
    before, after = stages["minhash near-dedup"]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()])
    assert set(pairs(after)) == {i for i, (_, _, kept) in groups.items() if kept}


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    assert sorted(before.collect()) == sorted(after.collect())


def test_mixing_keeps_every_row_of_a_hot_source(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 2 else f"s{i % 7}", 6) for i in range(2000)]
    after = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), SF_DIR).collect()
    assert sorted(tuple(r) for r in after) == rows
    # The surplus is the tail; before it the source has its quarter within two blocks.
    head = max(i for i, r in enumerate(after) if r.source != "hot") + 1
    assert abs(sum(r.source == "hot" for r in after[:head]) - 1000 / 3) <= 64


@pytest.mark.parametrize("parts", [(90, 10), (50, 30, 20), (40, 30, 20, 10), (33, 23, 22, 22)])
def test_mixing_keeps_every_row_of_few_sources(spark, parts):
    rows = [(i, f"text {i}", "en", f"s{s}", 6) for s, n in enumerate(parts) for i in range(1000 * s, 1000 * s + 10 * n)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, SF_DIR).collect()) == rows


def test_packing_stage(stages):
    before, after = stages["best-fit packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(pairs(before))
    assert check_packed(rows, corpus_pipeline.SEQUENCE_LENGTH) <= sum(r.length for r in rows) / corpus_pipeline.SEQUENCE_LENGTH + 2


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, None), (2, "the words of a text", "en", "s", 1),
            (2, "the words of a text", "en", "s", 1), (3, "123", "en", None, 1)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settle(stage(spark, docs, SF_DIR), "test-odd")
        assert {r.doc_id for r in docs.collect()} <= {2}


def test_stages_judge_rows_and_not_ids(spark):
    """A decision on one row holds for no other one with its id, or without any."""
    words = " ".join(f"the words of a long text number {i}" for i in range(12))
    rows = [(None, "123"), (None, "some text of its own"), (None, words + " more"), (1, words), (2, "the first text"),
            (2, "the longer copy"), (3, "thelonger  copy   "), (2, words + " most")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)

    def left(stage):
        return Counter((r.doc_id, r.text) for r in stage(spark, docs, SF_DIR).collect())

    assert left(corpus_pipeline.keep_known_languages) == Counter(rows[1:])
    assert left(corpus_pipeline.drop_exact_copies) == Counter(rows) - Counter([(2, "the longer copy")])
    gone = {x for x in rows if x not in left(corpus_pipeline.drop_near_copies)}
    assert (2, words + " most") in gone and not gone & {(2, "the first text"), (None, "some text of its own"), (1, words)}


def test_one_row_of_each_group_stays(spark, folder):
    """Copies go whether they lack an id, repeat one, or repeat a whole row."""
    words = " ".join(f"the words of a long text number {i}" for i in range(12))
    near = words + " and one more"
    rows = [(None, words), (None, words + "  "), (None, near), (3, near), (7, "another text"), (7, "another text"),
            (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    docs.write.parquet(f"{folder}/docs")
    for table in (docs, spark.read.parquet(f"{folder}/docs")):
        exact = corpus_pipeline.settle(corpus_pipeline.drop_exact_copies(spark, table, SF_DIR), "test-exact")
        assert Counter((r.doc_id, r.text) for r in exact.collect()) == Counter(
            [(None, words + "  "), (3, near), (7, "another text"), (8, "")])
        left = corpus_pipeline.drop_near_copies(spark, exact, SF_DIR)
        assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, near), (7, "another text"), (8, "")])


def test_stages_keep_clashing_columns_and_long_texts(spark):
    names = ("row", "_row", "hash", "rank", "value", "node", "_path", "_place", "place", "slot")
    long = "the words of a long text " * 40_000
    rows = [(1, long, "en", "s", 1), (2, long + "x", "en", "s", 1), (3, "the words of another", "en", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF_DIR), "test-clash")
    found = {r.doc_id: r for r in docs.collect()}
    assert set(found) == {1, 3} and docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    assert all(r[n] == f"{n}{i}" for i, r in found.items() for n in names) and found[1].text == long


def test_language_stage_without_labels(spark):
    rows = [(1, "some words", None, "s", 1), (2, "12 !", None, "s", 1), (None, None, None, None, None), (None, "É", None, "s", 1)]
    after = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(rows, DOCS), SF_DIR)
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter([(1, "some words"), (None, "É")])


def test_run(spark, stages):
    root = Path(f"{scratch_root(spark)}/tallyframe")
    before = set(root.iterdir()) if root.exists() else set()
    found = corpus_pipeline.run(spark, SF_DIR)
    # Nothing of what the stages have written is left but the result.
    assert {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before} == {"pipeline-best-fit-packing"}
    assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in stages["best-fit packing"][1].collect())


def test_packing_follows_the_mix(spark, folder):
    """Texts of one length fill the sequences in the order in which the mixing stage has put them."""
    rows = [(i, " ".join(["word"] * 300), "en", "hot" if i % 2 else f"s{i % 7}", 6) for i in range(600)]
    corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), SF_DIR).write.parquet(f"{folder}/mixed")
    mixed = corpus_pipeline.numbered(spark.read.parquet(f"{folder}/mixed"), "at").orderBy("at").collect()
    packed = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{folder}/mixed"), SF_DIR).collect()
    order = [r.doc_id for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset))]
    assert order == [r.doc_id for r in mixed] and order != sorted(order)
