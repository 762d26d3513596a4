"""Exact nearest vectors by inner product, with a table of distances to pivots."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.scratch import settle

from .shipping import ship

#: Pivots of the table; rows of a block of candidates and of queries; candidates evaluated first;
#: queries of a block that are answered together.
PIVOTS, CANDIDATE_ROWS, QUERY_ROWS, STEP, TOGETHER = 32, 4096, 2048, 512, 64
RESULT = "query_row long, query_id long, vec_id long, score long"
#: Whole numbers up to this are exact as doubles.
DOUBLES = 2.0**53


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as a double; null where a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """Candidates with one more component that brings all to the length sqrt(norm2): then
    the distance to a query, whose extra component is 0, falls as the inner product rises."""
    rest = np.sqrt(np.maximum(0.0, norm2 - (vectors * vectors).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(0.0, squares))


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``points`` far from each other, begun with the one farthest from the mean."""
    far = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    near = np.full(len(points), np.inf)
    for _ in range(min(count, len(points))):
        chosen.append(int(np.argmax(near if chosen else far)))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _scorer(vectors: np.ndarray, queries: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Inner products of some of ``queries`` with some rows of ``vectors``: in doubles where no
    sum can leave their whole numbers, else in longs, which are slower."""
    largest = [float(np.abs(x.astype(float)).max(initial=0.0)) for x in (vectors, queries)]
    kind = float if largest[0] * largest[1] * vectors.shape[1] < DOUBLES else np.int64
    own, asked = vectors.astype(kind), queries.astype(kind)
    return lambda rows, some: (asked[some] @ own[rows].T).astype(np.int64)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores with their ids; ties to smaller ids."""
    if len(scores) > k:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[kept], scores[kept]
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def best_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
                  pivots: int = PIVOTS, step: int = STEP, query_rows: np.ndarray | None = None,
                  rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best of a block: query id, vec ids, scores; ties to smaller ids.
    No candidate is the query's own one: that with its id, or with its number if ``query_rows``
    and ``rows`` number them.

    The distances of all candidates to the pivots are computed once. The largest
    difference to the query's own distances bounds its distance to a candidate from
    below, hence the score from above. Queries near one pivot are answered together, as
    products of matrices: first with the candidates of the highest bounds, which give each
    its k-th score so far, then with those whose bound reaches that of any of them; equal
    bounds are still evaluated, as a tie may go to them.
    """
    score = _scorer(vectors, queries)
    own_of, number = (query_ids, ids) if rows is None else (query_rows, rows)
    vectors, queries = vectors.astype(float), queries.astype(float)
    norm2 = float((vectors * vectors).sum(axis=1).max(initial=0.0))
    lifted = _lifted(vectors, norm2)
    table_points = choose_pivots(lifted, pivots)
    table = _distances(lifted, table_points).astype(np.float32).T.copy()
    padded = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    own = _distances(padded, table_points).astype(np.float32)
    square = (queries * queries).sum(axis=1)
    # Rounding of distances may not hide a candidate: widen bounds by more than it.
    slack = 1e-3 + 1e-5 * (math.sqrt(norm2) + np.sqrt(square))
    alike = np.argsort(own.argmin(axis=1), kind="stable")
    for some in (alike[at : at + TOGETHER] for at in range(0, len(alike), TOGETHER)):
        apart = np.abs(table[0] - own[some, :1])
        for p in range(1, len(table)):
            np.maximum(apart, np.abs(table[p] - own[some, p : p + 1]), out=apart)
        lower = np.maximum(0.0, apart - slack[some, None], dtype=np.float64)
        most = (square[some] + norm2)[:, None]
        bound = (most - lower * lower) / 2 + 0.5 + 1e-9 * most
        order = np.argsort(-bound.max(axis=0), kind="stable")
        part = order[:step]
        found, other = score(part, some), number[part] != own_of[some, None]
        reached = np.full(len(some), -np.inf)
        for i, scores in enumerate(found):
            if other[i].sum() >= k:
                reached[i] = _first(ids[part][other[i]], scores[other[i]], k)[1][-1]
        rest = order[step:]
        rest = rest[(bound[:, rest] >= reached[:, None]).any(axis=0)]
        part = np.concatenate([part, rest])
        found = np.concatenate([found, score(rest, some)], axis=1)
        other = number[part] != own_of[some, None]
        for i, query in enumerate(some):
            yield int(query_ids[query]), *_first(ids[part][other[i]], found[i][other[i]], k)


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", values: str = "values",
           row: str | None = None) -> DataFrame:
    """The ``k`` vectors with the highest inner product for every query: query_id, rank, vec_id, score.

    ``values`` are whole numbers; scores are exact as far as a long holds them. Candidates and queries are
    dealt into blocks by a hash; every block of queries meets every block of
    candidates in a task of its own, which returns k rows a query at most. The best
    of these are taken by query. A query's own id is no candidate for it. Rows
    with a null id or null values take no part, and vectors only meet others of their
    length. Repeated rows are candidates each; a repeated query is asked once, and
    a query id with several vectors ranks the candidates of all of them.

    With ``row``, a column of both that numbers the rows, every row of ``queries`` is a query of
    its own, and only that row is no candidate for it. Then rows without an id are candidates
    too, after those with one where scores are equal.
    """
    ship(vectors.sparkSession)
    vectors = settle(_usable(vectors, vec_id, values, row), "topk-vectors")
    queries = settle(_usable(queries, vec_id, values, row).distinct(), "topk-queries")
    n_vectors, n_queries = vectors.count(), queries.count()
    v_blocks, q_blocks = max(1, math.ceil(n_vectors / CANDIDATE_ROWS)), max(1, math.ceil(n_queries / QUERY_ROWS))
    # Ties of ids aside, a block has about CANDIDATE_ROWS rows however the ids are distributed.
    length, dealt = F.size("values").alias("length"), F.xxhash64("row", "vec_id", "values")

    def block(blocks: int) -> Column:
        return F.pmod(dealt, F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    # Both sides' numbers must be of one type: a cogroup hashes them as they are, and an int
    # is not dealt to the partition of an equal long.
    left = vectors.select(block(v_blocks).alias("v"), every(q_blocks).alias("q"), length, "*")
    right = queries.select(every(v_blocks).alias("v"), block(q_blocks).alias("q"), length, "*")

    def cell(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        query, place, score = ([np.zeros(0, np.int64)] for _ in range(3))
        # Candidates are known by their places in the order in which ties are broken.
        own = own.sort_values(["unnamed", "vec_id"], ignore_index=True)
        if len(own) and len(asked):
            vectors, points = np.stack(own["values"].to_numpy()), np.stack(asked["values"].to_numpy())
            best = best_in_block(np.arange(len(asked)), points, np.arange(len(own)), vectors, k,
                                 query_rows=asked["row"].to_numpy(np.int64), rows=own["row"].to_numpy(np.int64))
            for i, found, scores in best:
                query.append(np.full(len(found), i))
                place.append(found)
                score.append(scores)
        asked, own = asked.iloc[np.concatenate(query)], own.iloc[np.concatenate(place)]
        named = own["vec_id"].astype("Int64").where(~own["unnamed"])
        columns = (asked["row"].array, asked["vec_id"].array, named.array, np.concatenate(score))
        return pd.DataFrame(dict(zip(("query_row", "query_id", "vec_id", "score"), columns, strict=True)))

    found = left.groupBy("length", "v", "q").cogroup(right.groupBy("length", "v", "q")).applyInPandas(cell, RESULT)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _usable(rows: DataFrame, vec_id: str, values: str, row: str | None) -> DataFrame:
    """row, vec_id, unnamed (has it no id?) and values; without ``row`` the id is the row's number."""
    number, name = F.col(row or vec_id).cast("long"), F.col(vec_id).cast("long")
    rows = rows.where(F.col(values).isNotNull() & number.isNotNull())
    return rows.select(number.alias("row"), F.coalesce(name, F.lit(0)).alias("vec_id"), name.isNull().alias("unnamed"),
                       F.col(values).alias("values"))
