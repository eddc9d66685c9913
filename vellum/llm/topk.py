"""Exact nearest vectors by inner product: a table of distances to pivots bounds each score, the best bounds are tried first.

The squared distance of two vectors is |q|^2 + |c|^2 - 2 q.c, and by the triangle inequality no less than the square of
|d(q, p) - d(c, p)| for any pivot p. So the largest of these differences over many pivots bounds q.c from above, and a
candidate whose bound is below the k-th best score so far, as are all behind it in the order of bounds, needs no product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import Scratch, map_arrow, record

#: Results of a query, pivots, and rows of the sample from which the pivots come (the first by hash; it decides speed alone).
NEAREST, PIVOTS, SAMPLE = 10, 32, 1024
#: Numbers of the sample at most, and bytes of vectors of one cell's candidates and of its queries, about.
SAMPLE_NUMBERS, CANDIDATES, QUERIES = 1 << 20, 4 << 20, 8 << 20
#: Candidates that are tried first; as many again and again as were tried before.
FIRST = 64
#: Sums of products of whole numbers below this are exact in floating point.
EXACT = 1 << 53
LIMITS = (-(1 << 63), (1 << 63) - 1)


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, within the limits of long; equal rows once.

    Left out: null ids, null vectors, and those that hold a component that is null, infinite or no number.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.col(f"`{key}`").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(sound).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))
    return rows.dropDuplicates(["vec_id", "v"])


class Pivots:
    """For each length of vector the sample's rows of it, and of those PIVOTS that lie far from each other."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        by_length: dict[int, list[tuple[int, list[int]]]] = {}
        for key, v in rows:
            by_length.setdefault(len(v), []).append((key, v))
        self.sample = {n: (np.array([k for k, _ in r], np.int64), np.array([v for _, v in r], float).reshape(len(r), n)) for n, r in by_length.items()}
        self.pivots = {n: self._spread(m) for n, (_, m) in self.sample.items()}

    @staticmethod
    def _spread(m: np.ndarray) -> np.ndarray:
        chosen, near = [0], ((m - m[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(m)):
            k = int(near.argmax())
            chosen.append(k)
            near = np.minimum(near, ((m - m[k]) ** 2).sum(1))
        return m[chosen]

    def distances(self, m: np.ndarray) -> np.ndarray:
        """The distances of the rows to the pivots of their length; none, where the sample has no vector of it."""
        p = self.pivots.get(m.shape[1], np.zeros((0, m.shape[1])))
        squares = (m * m).sum(1)[:, None] + (p * p).sum(1) - 2 * (m @ p.T)
        return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def matrix(column: pa.ListArray, length: int, dtype=float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length).astype(dtype)


TABLE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", T.ArrayType(T.LongType())), T.StructField("far", T.ArrayType(T.FloatType()))])


def with_distances(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """The pivot table: rows (vec_id, v) with `far`, the distance to each pivot."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("v")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            far: list = [None] * len(column)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                for k, row in zip(at, pivots.distances(matrix(column.take(pa.array(at)), int(n))), strict=True):
                    far[k] = row
            return record(TABLE, vec_id=batch.column("vec_id"), v=column, far=far)

        return f

    return map_arrow(rows, make, TABLE)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then id; of equal ids the best."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], scores[order]


def search(query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best rows of m, and how many were tried. least: a score that the k-th best of all has at least."""
    order = np.flatnonzero(bounds >= least)
    order = order[np.argsort(-bounds[order], kind="stable")]
    got, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, FIRST
    # equal scores go by id, so that a bound equal to the k-th score has still to be tried
    while at < len(order) and bounds[order[at]] >= least:
        part = order[at : at + step]
        part = part[bounds[part] >= least]
        got, scores = best_of(np.r_[got, ids[part]], np.r_[scores, m[part] @ query], k)
        if len(got) == k:
            least = max(least, float(scores[-1]))
        at, step = at + step, 2 * step
    return got, scores, at


def search_plainly(query: list[int], ids: np.ndarray, rows: list[list[int]], k: int) -> list[tuple[int, int]]:
    """As `search`, for numbers whose products floating point would round."""
    best: dict[int, int] = {}
    for key, row in zip(ids.tolist(), rows, strict=True):
        score = sum(a * b for a, b in zip(query, row, strict=True))
        best[key] = max(score, best.get(key, score))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])


def cell(pivots: Pivots, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Searches the queries of one cell among its candidates, both (vec_id, v, far) of one length."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if candidates.num_rows and queries.num_rows:
            sides = [t.combine_chunks() for t in (candidates, queries)]
            columns = [[c.chunk(0) for c in (t.column("vec_id"), t.column("v"), t.column("far"))] for t in sides]
            (ids, v, far), (q_ids, q, q_far) = [(a.to_numpy(), b, c) for a, b, c in columns]
            n = len(q[0])
            most = np.abs(matrix(v, n)).max(initial=0) * np.abs(matrix(q, n)).max(initial=0) * max(n, 1)
            for x in pairs(ids, v, far, q_ids, q, q_far, n) if most < EXACT else plain_pairs(ids, v, q_ids, q):
                out += x
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=FOUND.names)

    def pairs(ids, v, far, q_ids, q, q_far, n):
        m, qs = matrix(v, n), matrix(q, n)
        width = len(far[0])
        d, qd = matrix(far, width, np.float32), matrix(q_far, width, np.float32)
        squares, sample = (m * m).sum(1), pivots.sample.get(n)
        # what rounding of the distances may take from a bound
        slack = 1e-6 * (d.max(initial=0) + qd.max(initial=0)) ** 2 + 1
        for key, query, to_pivots in zip(q_ids, qs, qd, strict=True):
            apart = np.abs(d - to_pivots).max(1, initial=0).astype(float)
            bounds = (squares + query @ query - apart * apart) / 2 + slack
            bounds[ids == key] = -np.inf
            least = -1e300
            if sample is not None:
                known = best_of(sample[0][sample[0] != key], (sample[1] @ query)[sample[0] != key], k)[1]
                least = float(known[-1]) if len(known) == k else least
            got, scores, _ = search(query, bounds, ids, m, k, least)
            yield [(int(key), int(i), int(s)) for i, s in zip(got, scores, strict=True)]

    def plain_pairs(ids, v, q_ids, q):
        rows, queries = v.to_pylist(), q.to_pylist()
        for key, query in zip(q_ids.tolist(), queries, strict=True):
            others = np.flatnonzero(ids != key)
            found = search_plainly(query, ids[others], [rows[j] for j in others], k)
            yield [(key, i, max(LIMITS[0], min(LIMITS[1], s))) for i, s in found]

    return run


def nearest(vectors: DataFrame, scratch: Scratch, is_query=lambda key: key % 100 == 0, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of highest inner product, ties to the lesser id.

    vectors: (vec_id, embedding) and any others; is_query: which ids are queries, of all of which every other row is a
    candidate but those of the query's own id. Components are taken as `whole` says. Equal rows count once; of several
    vectors of one id the query is the least, and a candidate counts by its best. Vectors of another length are
    no candidates. Scores stay within the limits of long. No vectors, or no queries, give no rows.

    Queries and candidates meet in cells of bounded size, each block of one with each of the other; a cell's bounds come
    from the pivot table, and its first k-th score from the sample, whose rows are candidates too.
    """
    rows = scratch.table(whole(vectors), "whole")
    numbers = rows.agg(F.sum(F.size("v")).alias("n"), F.max(F.size("v")).alias("longest")).first()
    longest = numbers.longest or 0
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // max(1, longest))))
    pivots = Pivots([(r.vec_id, r.v) for r in first.collect()])
    table = scratch.table(with_distances(rows, pivots), "pivot-table")
    asked = table.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("v", "far")).alias("q")).select("vec_id", "q.*")
    asked = scratch.table(asked, "queries")
    query_numbers = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    chunks, blocks = (max(1, -(-8 * (n or 0) // size)) for n, size in ((numbers.n, CANDIDATES), (query_numbers, QUERIES)))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int):
        """Each row in its own part of n and in all m of the other side."""
        part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias(own)
        return df.select("vec_id", "v", "far", F.size("v").alias("length"), part, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    cells = ["length", "chunk", "block"]
    there, here = dealt(table, "chunk", chunks, "block", blocks), dealt(asked, "block", blocks, "chunk", chunks)
    run = cell(pivots, k)
    found = there.groupBy(*cells).cogroup(here.groupBy(*cells)).applyInArrow(lambda a, b: run(a, b), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
