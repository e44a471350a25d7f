"""Exact top-k search by inner product: aggregation of sorted lists without random access.

Candidates lie in blocks. A block has one list for each dimension, sorted by that component; a query reads a list from the top
where its own component is positive and from the bottom where it is negative, so contributions fall along each list. All lists
are read to the same depth. A candidate's score is then bounded from above by what was read of it plus, for each list in
which it was not met, the contribution last read there, and from below by the contribution at that list's end. When few
candidates reach the k-th best lower bound, nobody else can qualify, and the rest of these few is read to have exact
scores. A block hands on its k best for each query; the best of all blocks are the result.

Bounds of all candidates and queries of a block are four matrix products at each depth. Equal vectors of a block are one
candidate with its k + 1 smallest ids, which is enough for any ranking, so a very common vector costs no more than another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    block: int = 4096
    query_block: int = 1024
    depths: tuple[float, ...] = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)
    few: int = 64


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) for each component as a double; null if the vector or a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(doubles, lambda x: F.floor(x * float(factor))))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one row an id: of rows that repeat an id the smallest vector counts."""
    ids = table["vec_id"].to_numpy()
    values = table["v"].combine_chunks()
    rows = values.flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], rows[first]


def _kind(x: np.ndarray, q: np.ndarray):
    """The narrowest numbers in which every score and bound is exact."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def candidates_of(x: np.ndarray, q: np.ndarray, want: int, p: TopKParams):
    """For each query the rows of x that can be among its ``want`` best, ties included, and their exact scores."""
    n, kind = len(x), _kind(x, q)
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(x, order, axis=0)
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    open_, rows, out = np.arange(len(q)), np.arange(n), {}
    want = min(want, n)
    for depth in p.depths:
        t = max(1, min(n, int(np.ceil(n * depth)))) if depth < 1 else n
        top, bottom, part = rank[rows] >= n - t, rank[rows] < t, x[rows]
        a, b = up[open_].T, down[open_].T
        upper = np.where(top, part, lists[n - t]).astype(kind) @ a + np.where(bottom, part, lists[t - 1]).astype(kind) @ b
        lower = np.where(top, part, lists[0]).astype(kind) @ a + np.where(bottom, part, lists[-1]).astype(kind) @ b
        level = np.sort(lower, axis=0)[-want] if kind is object else np.partition(lower, len(rows) - want, axis=0)[len(rows) - want]
        able = upper >= level
        done = (able.sum(axis=0) <= max(p.few, want)) | (t == n)
        for i in np.flatnonzero(done):
            found = rows[able[:, i]]
            query = q[open_[i]].astype(object if kind is object else np.int64)
            out[int(open_[i])] = found, x[found].astype(query.dtype) @ query
        able, open_ = able[:, ~done], open_[~done]
        if not len(open_):
            break
        rows = rows[able.any(axis=1)]
    return out


def _block_best(candidates: pa.Table, queries: pa.Table, p: TopKParams) -> pa.Table:
    ids, vectors = _matrix(candidates)
    query_ids, q = _matrix(queries)
    x, inverse = np.unique(vectors, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.lexsort((ids, inverse))
    bounds = np.searchsorted(inverse[by], np.arange(len(x) + 1))
    ids = ids[by]
    best = []
    for i, (rows, scores) in candidates_of(x, q, p.k + 1, p).items():
        pairs = [(-int(s), int(v)) for r, s in zip(rows, scores) for v in ids[bounds[r]:min(bounds[r + 1], bounds[r] + p.k + 1)]
                 if v != query_ids[i]]
        best += [(int(query_ids[i]), v, -s) for s, v in sorted(pairs)[:p.k]]
    names = ["query_id", "vec_id", "score"]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*best) if best else ([], [], []))], names=names)


def top_k(vectors: DataFrame, is_query: Column, params: TopKParams = TopKParams()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``vec_id``, integers ``v``) that is a query, its best other rows.

    Ties go to the smaller ``vec_id``. Rows whose id or vector is null take no part; vectors of different length are not
    compared. Of rows that repeat an id the smallest vector counts. Queries go over all rows in pairs of blocks of bounded
    size. An empty table gives no rows.
    """
    p = params
    rows = vectors.where("vec_id is not null and v is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"), is_query.alias("asks"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    blocks, query_blocks = max(1, -(-n // p.block)), max(1, -(-asked // p.query_block))
    place = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("dim", place(blocks).alias("c"), every(query_blocks).alias("q"), "vec_id", "v")
    right = rows.where("asks").select("dim", every(blocks).alias("c"), place(query_blocks).alias("q"), "vec_id", "v")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        return _block_best(a, b, p)

    found = left.groupBy("dim", "c", "q").cogroup(right.groupBy("dim", "c", "q")).applyInArrow(
        best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
