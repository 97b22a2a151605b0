"""Exact top-k vector search with multi-resolution segment statistics.

A vector is cut into equal segments at several resolutions. Within a segment of length n, with means m and deviations s,
the squared distance of two vectors is at least n((m-m')^2 + (s-s')^2); with the squared norms kept exactly this
bounds their inner product from above by the sum over segments of n(mm' + ss'). The bounds are computed from coarse to
fine: the coarsest for every row of a chunk, each finer one only for rows whose bound so far reaches the query's k-th best score,
and the survivors are scored exactly. The k-th best score is carried from chunk to chunk, and a chunk none of whose
rows can reach it (by the least and greatest of its rows' means and its greatest deviations) is skipped whole.

Queries and rows are dealt into blocks of bounded size and meet block by block; each meeting returns k rows for a query,
which are reduced to k by rank. Nothing is broadcast, and no pair of rows is ever materialised. There are few query blocks, since
each of them has all rows sent to it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Numbers that a block of queries, and of rows, holds (about); rows of a chunk.
QUERY_VALUES, ROW_VALUES, CHUNK = 1 << 21, 1 << 20, 1024
#: Rows that a task should get at least before there are more tasks.
LEAST_ROWS = 1024
SEGMENTS = (1, 4, 16)
SCALE = 256
#: Sums of whole numbers below this are exact in doubles.
_EXACT = float(1 << 53)


def _features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and deviation, scaled by the root of the segment's length."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    return np.concatenate([np.stack([p.mean(axis=1), p.std(axis=1)], axis=1) * math.sqrt(p.shape[1]) for p in parts], axis=1)


def _matrix(table: pa.Table, prefix: str = "") -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
    ids, own = (np.array(table.column(f"{prefix}{c}").to_pylist(), np.int64) for c in ("id", "own"))
    return ids, own, table.column(f"{prefix}vector").to_pylist()


def _scaled(vectors: list[list[float]]) -> np.ndarray:
    return np.floor(np.array(vectors, np.float64) * SCALE)


class Searcher:
    """The k best rows of a block for each query. `seen` counts pairs bounded at each level, and scored exactly. own: what tells a row from others (default: its id)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> None:
        # rows with near means stand together, so that chunks have tight bounds
        order = np.lexsort((ids, rows.mean(axis=1)))
        self.ids, self.rows, self.k = ids[order], rows[order], k
        self.own = (ids if own is None else own)[order]
        self.levels = [_features(self.rows, n) for n in SEGMENTS]
        self.chunks = [slice(a, a + CHUNK) for a in range(0, len(ids), CHUNK)]
        coarse = [self.levels[0][c] for c in self.chunks]
        self.low, self.high = (np.array([f(x, axis=0) for x in coarse]) for f in (np.min, np.max))
        self.longest = float(np.sqrt((self.rows * self.rows).sum(axis=1).max()))
        self.seen = [0] * (len(SEGMENTS) + 1)

    def best(self, own: int, query: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the query's own, best first; ties to the smaller id."""
        marks = [_features(query[None, :], n)[0] for n in SEGMENTS]
        reach = np.maximum(self.low * marks[0], self.high * marks[0]).sum(axis=1)
        scores, ids, floor = np.empty(0), np.empty(0, np.int64), -np.inf
        slack = 1e-9 * (1 + self.longest * float(np.sqrt(query @ query)))  # far above what rounding adds to a bound
        for c in np.argsort(-reach, kind="stable"):
            if reach[c] < floor - slack:
                break  # the chunks after it reach no further
            at = np.arange(len(self.ids))[self.chunks[c]]
            at = at[self.own[at] != own]
            for n, (level, mark) in enumerate(zip(self.levels, marks)):
                self.seen[n] += len(at)
                at = at[level[at] @ mark >= floor - slack]
            self.seen[-1] += len(at)
            scores, ids = np.r_[scores, self.rows[at] @ query], np.r_[ids, self.ids[at]]
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
            if len(ids) == self.k:
                floor = scores[-1]
        return [(int(s), int(i)) for s, i in zip(scores, ids)]


def _search(k: int):
    def big(ids: np.ndarray, own: np.ndarray, rows: list[list[int]], query_own: int, query: list[int]) -> list[tuple[int, int]]:
        """The same over whole numbers too large for doubles."""
        scored = ((-sum(a * b for a, b in zip(x, query)), int(i)) for i, o, x in zip(ids, own, rows) if o != query_own)
        return [(max(-(1 << 63), min((1 << 63) - 1, -s)), i) for s, i in heapq.nsmallest(k, scored)]

    def run(key: tuple, queries: pa.Table, table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if queries.num_rows and table.num_rows:
            (q_ids, q_own, q_raw), (ids, own, raw) = _matrix(queries), _matrix(table, "row_")
            q, rows = _scaled(q_raw), _scaled(raw)
            exact = np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * q.shape[1] < _EXACT
            searcher = Searcher(ids, rows, k, own) if exact else None
            whole = None if exact else [[math.floor(x * SCALE) for x in v] for v in raw]
            for i, v in enumerate(q_raw):
                found = searcher.best(int(q_own[i]), q[i]) if exact else big(ids, own, whole, q_own[i], [math.floor(x * SCALE) for x in v])
                out += [(int(q_own[i]), int(q_ids[i]), s, j) for s, j in found]
        columns = zip(*out) if out else ([], [], [], [])
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["own", "query_id", "score", "vec_id"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): for each row where `queries` holds, the k best of the other rows.

    Score: inner product of floor(256 x). Ties go to the smaller id. Null ids and vectors that are null, empty or hold null or
    non-finite components take no part; vectors of different lengths are not compared. Rows with one id are that many rows: each is a query of its
    own, with ranks of its own, and a candidate of the others. Scores outside the range of a long become its nearest end. No queries or no rows: an empty result.
    """
    x = F.col("vector")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).withColumn("size", F.size(x))
    # rows are numbered once, so that a query knows its own row
    rows = stored(rows.withColumn("own", F.monotonically_increasing_id()), "rows")
    asked = rows.filter("asked")
    of_queries, of_rows = (x.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)), F.count("*")).first() for x in (asked, rows))
    n_q = max(1, -(-of_queries[0] // QUERY_VALUES))
    n_r = max(1, -(-of_rows[0] // ROW_VALUES), min(of_rows[1] // LEAST_ROWS, vectors.sparkSession.sparkContext.defaultParallelism))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # both sides' keys are longs: keys of other types would be dealt out differently

    block = F.pmod(F.xxhash64("own"), F.lit(1 << 40))
    q = asked.select("id", "own", "vector", "size", (block % n_q).alias("qb")).withColumn("rb", every(n_r))
    r = rows.select(F.col("id").alias("row_id"), F.col("own").alias("row_own"), F.col("vector").alias("row_vector"), F.col("size").alias("row_size"), (block % n_r).alias("row_rb"))
    met = q.groupBy("size", "qb", "rb").cogroup(r.withColumn("row_qb", every(n_q)).groupBy("row_size", "row_qb", "row_rb")).applyInArrow(_search(k), "own long, query_id long, score long, vec_id long")
    best = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return met.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
