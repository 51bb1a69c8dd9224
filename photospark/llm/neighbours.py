"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; every pair of blocks is a cell of
a grid and one unit of work. Inside a cell, vectors are rounded to 8-bit
integers with a scale each, tiles of integer products give all distances at
once, and the rounding errors of both vectors bound how far each can be off.
Pairs whose lower bound is beyond the k-th upper bound of their query leave;
the others are computed from the original vectors in double precision and kept
in a heap of k per query. Heaps of the cells of a query are merged at the end.
The result is exact: the bounds never drop a neighbour.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and candidates of a tile within it.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
TILE = 1024
#: Relative slack of the bounds for rounding in single precision.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not all zero, every component finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit codes, scales, lengths of the rounded vectors, lengths of the rounding errors)."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, np.sqrt((rounded * rounded).sum(axis=1)), np.sqrt(((vectors - rounded) ** 2).sum(axis=1))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, components added in order."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        gap = left[:, d] - right[:, d]
        total += gap * gap
    return np.sqrt(total)


def nearest_in_cell(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query ids, candidate ids, distances) of the k nearest candidates of each query of a cell, its own id left out."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    q8, q_scale, q_length, q_error = quantise(q)
    for at in range(0, len(cid), TILE):
        part, ids = c[at : at + TILE], cid[at : at + TILE]
        c8, c_scale, c_length, c_error = quantise(part)
        # products of 8-bit codes add up exactly in single precision up to 1,040 components, beyond that in double
        kind = np.float32 if q.shape[1] <= 1040 else np.float64
        product = (q8.astype(kind) @ c8.astype(kind).T) * q_scale[:, None] * c_scale[None, :]
        about = np.sqrt(np.maximum(q_length[:, None] ** 2 + c_length[None, :] ** 2 - 2 * product, 0))
        slack = q_error[:, None] + c_error[None, :] + SLACK * (q_length[:, None] + c_length[None, :])
        own = qid[:, None] == ids[None, :]
        upper = np.where(own, np.inf, about + slack)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(qid), np.inf)
        worst = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps])
        i, j = np.nonzero((about - slack <= np.minimum(limit, worst)[:, None]) & ~own)
        for a in range(0, len(i), 1 << 15):
            rows, columns = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            found = distances(q[rows], part[columns])
            for row, gap, name in zip(rows.tolist(), found.tolist(), ids[columns].tolist(), strict=True):
                heap = heaps[row]
                if len(heap) < k:
                    heapq.heappush(heap, (-gap, -name))
                elif (-gap, -name) > heap[0]:
                    heapq.heapreplace(heap, (-gap, -name))
    out = [(int(name), -n, -gap) for name, heap in zip(qid, heaps, strict=True) for gap, n in heap]
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest candidates of each query by Euclidean distance, ties to smaller ids.

    Both inputs have ``vec_id`` and ``embedding`` (array of numbers). Vectors
    that are not ``usable`` and rows without id take no part; vectors are
    compared with those of the same length; a query's own id is no candidate.
    Rows that repeat an id count once each on the candidate side; a repeated
    query is answered once. Counts both sides while it is built. Candidates are
    sent once per block of queries and queries once per block of candidates,
    which any exhaustive search has to do.
    """
    def side(df: DataFrame) -> DataFrame:
        rows = df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))

    asked, known = side(queries).dropDuplicates(["vec_id"]), side(candidates)
    rows, columns = (max(1, math.ceil(df.count() / block)) for df, block in ((asked, query_block), (known, candidate_block)))

    def cells(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = cells(asked, "row", rows, "column", columns).groupBy("dim", "row", "column")
    right = cells(known, "column", columns, "row", rows).groupBy("dim", "row", "column")

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        def of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(ids := t.column("vec_id").to_numpy(), kind="stable")
            return ids[order], t.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]

        out = nearest_in_cell(*of(q), *of(c), k) if q.num_rows and c.num_rows else ([], [], [])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = left.cogroup(right).applyInArrow(cell, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
