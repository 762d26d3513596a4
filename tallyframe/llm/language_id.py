"""Languages by the nearest centroid of n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

#: Rows that a model is fitted on, all languages together; languages share them evenly.
SAMPLE_ROWS = 6000
#: Hashed features of a text, and centroids of a language.
FEATURES = 1 << 13
CENTROIDS = 4
#: A text is rejected if its cosine with the nearest centroid is below this part of the
#: quantile of the sample's texts of its size. Sizes are powers of two of the number of
#: distinct n-grams; one with fewer sample rows takes half the floor of the next larger one.
REJECT_QUANTILE, REJECT_PART, SIZE_ROWS = 0.001, 0.6, 100
UNKNOWN = "und"

_SPACE = 0x20
_CLASS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else _SPACE for b in range(256)], np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pairs and triples of bytes of the lower-cased text: features and counts.
    Whatever is no letter counts as a space, and n-grams of spaces only are left out."""
    data = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    pairs = data[:-1] << 8 | data[1:]
    triples = pairs[:-1] << 8 | data[2:]
    pairs = pairs[pairs != (_SPACE << 8 | _SPACE)]
    triples = triples[triples != (_SPACE << 16 | _SPACE << 8 | _SPACE)]
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    codes = np.concatenate([(pairs | np.uint32(1 << 24)), triples]) * np.uint32(2654435761) >> shift
    counts = np.bincount(codes, minlength=FEATURES)
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


@dataclass(frozen=True)
class LanguageModel:
    """Centroids as rows of one matrix (features x centroids), with each centroid's language."""

    languages: list[str]
    owner: np.ndarray
    weights: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        seen, counts = ngram_counts(text)
        values = (1 + np.log(counts)) * self.idf[seen]
        return seen, (values / (np.linalg.norm(values) or 1)).astype(np.float32)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid, and whether that is too far."""
        if not self.languages:
            return UNKNOWN, 0.0, True
        seen, values = self.vector(text)
        cosines = values @ self.weights[seen]
        best = int(np.argmax(cosines))
        score = float(np.clip(cosines[best], 0, 1))
        return self.languages[self.owner[best]], score, bool(score < self.floors[_size(len(seen))])


def _size(features: int) -> int:
    return max(0, int(features).bit_length() - 1)


def _floors(sizes: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The cosine below which a text of each size is rejected; larger texts never get a lower one."""
    floors = np.full(FEATURES.bit_length(), np.nan)
    for size in range(len(floors)):
        own = cosines[sizes == size]
        if len(own) >= SIZE_ROWS:
            floors[size] = REJECT_PART * np.quantile(own, REJECT_QUANTILE)
    known = np.flatnonzero(~np.isnan(floors))
    top = floors[known[-1]] if len(known) else REJECT_PART * min(cosines, default=0.0)
    for size in range(len(floors) - 1, -1, -1):
        above = floors[size + 1] if size + 1 < len(floors) else top
        below_known = len(known) and size < known[-1]
        floors[size] = min(above, floors[size]) if not np.isnan(floors[size]) else above / 2 if below_known else above
    return floors


def _centroids(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun with rows far from each other."""
    centers = [rows.mean(axis=0)]
    near = rows @ (centers[0] / (np.linalg.norm(centers[0]) or 1))
    centers = [rows[int(np.argmax(near))]]
    near = rows @ centers[0]
    while len(centers) < min(k, len(rows)):
        centers.append(rows[int(np.argmin(near))])
        near = np.maximum(near, rows @ centers[-1])
    found = np.stack(centers)
    for _ in range(rounds):
        own = np.argmax(rows @ found.T, axis=1)
        sums = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else found[c] for c in range(len(found))])
        found = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return found


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", doc_id: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> LanguageModel:
    """A model of the rows of ``labelled`` that have a language and a letter.

    About ``sample_rows`` of them, chosen by a hash and as many of each language,
    are turned into n-gram counts where they are read; only these vectors of at
    most FEATURES entries come to the driver. A table without such rows gives a model
    that knows no language.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(language).cast("string").alias("lang"),
                           F.col(doc_id).alias("doc_id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) / F.lit(1 << 30))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        empty = np.zeros(0)
        return LanguageModel([], empty, empty, empty, empty)
    shares = pd.DataFrame({"lang": languages, "share": [sample_rows / len(languages) / counts[x] for x in languages]})
    # One row for each language.
    drawn = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(shares)), "lang").where("draw < share")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()),
                 pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
                names=["lang", "seen", "counts"],
            )

    sample = drawn.select("lang", "text").mapInArrow(vectors, "lang string, seen binary, counts binary").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["seen"]), bytes(r["counts"])))
    entries = [(np.frombuffer(r["seen"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in sample]
    documents = np.bincount(np.concatenate([s for s, _ in entries]) if entries else [], minlength=FEATURES)
    idf = np.log((1 + len(entries)) / (1 + documents)) + 1
    names = np.array([r["lang"] for r in sample], object)
    sizes = np.array([_size(len(seen)) for seen, _ in entries])
    del sample
    owner, found, near = [], [], np.zeros(len(entries))
    for i, name in enumerate(languages):
        # One language's rows at a time are spread out over all features.
        rows = np.flatnonzero(names == name)
        own = np.zeros((len(rows), FEATURES), np.float32)
        for row, at in zip(own, rows, strict=True):
            seen, count = entries[at]
            row[seen] = (1 + np.log(count)) * idf[seen]
            row /= np.linalg.norm(row) or 1
        centers = _centroids(own, centroids) if len(own) else own
        near[rows] = (own @ centers.T).max(axis=1) if len(own) else 0
        owner += [i] * len(centers)
        found.append(centers)
    floors = _floors(sizes, near)
    weights = np.ascontiguousarray(np.concatenate(found).T) if found else np.zeros((FEATURES, 0), np.float32)
    return LanguageModel(languages if found else [], np.array(owner), weights, idf, floors)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``.

    ``lang_pred`` is a language of the model, or ``und`` (score 0) where the text
    is null or has no letter. ``score`` is the cosine with the nearest centroid
    from 0 to 1. ``rejected`` marks ``und`` and texts much farther from every centroid
    than texts of their size that the model was fitted on. Only the text is looked at; null ids
    and repeated rows are kept.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("readable", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            rows = zip(batch.column("text"), batch.column("readable").to_pylist(), strict=True)
            found = [fitted.predict(t.as_py()) if readable else (UNKNOWN, 0.0, True) for t, readable in rows]
            names, scores, far = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(far, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def drop_unrecognised(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, all columns as they are, in one
    pass and without a shuffle. A model without languages rejects only texts without a letter."""
    rows = docs.where(F.col(text).rlike(r"\p{L}"))
    if not model.languages:
        return rows
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            keep = [not fitted.predict(t.as_py())[2] for t in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(known, docs.schema)
