"""Nearest neighbours by a block matrix join with int8 bounds.

Queries and rows are dealt into blocks of bounded size; each pair of a query block and a row block
is one task's tile. In a tile, vectors quantised to int8 give all products at once; with each
vector's own quantisation error they bound the true distance from both sides. Rows whose lower
bound is above the k-th smallest upper bound cannot be among the k nearest; the others are computed
anew in double precision from the original vectors. Each tile sends a heap of k rows per query, and
the heaps are merged. The result is exact.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors meet only those of equal length; ties go to the smaller id; a query is not its own
neighbour, nor is any row with its id; repeated query rows count once, and what several vectors of one
query id find is ranked together; fewer rows than k give all of
them; no queries or an empty table give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES, ROW_BYTES = 16 << 20, 8 << 20  # of a block's vectors; rows are copied once per query block, so these are larger
TILE_QUERIES = 128  # whose bounds are held at once


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix of doubles."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the length of what quantisation changed."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # subnormal vectors
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(query, distance, id) of each query's k nearest rows in this tile, exactly."""
    qq, qs, qe = quantised(queries)
    rq, rs, re = quantised(rows)
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    rq = rq.astype(exact)
    qn = np.square(np.linalg.norm(qq.astype(np.float64), axis=1) * qs)
    rn = np.square(np.linalg.norm(rq.astype(np.float64), axis=1) * rs)
    out = []
    for at in range(0, len(query_ids), TILE_QUERIES):
        s = np.s_[at : at + TILE_QUERIES]
        products = (qq[s].astype(exact) @ rq.T).astype(np.float64) * (qs[s, None] * rs)
        size = qn[s, None] + rn
        about = np.sqrt(np.maximum(size - 2 * products, 0))
        error = qe[s, None] + re + 1e-7 * np.sqrt(size)  # the last term is for rounding
        own = query_ids[s, None] == ids
        upper = np.where(own, np.inf, about + error)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(upper), np.inf)
        survives = ~own & (about - error <= limit[:, None])
        for i in range(len(upper)):
            near = np.flatnonzero(survives[i])
            distance = np.sqrt(sum(np.square(rows[near] - queries[at + i]).T, np.zeros(len(near))))  # by component, in order
            best = heapq.nsmallest(k, zip(distance.tolist(), ids[near].tolist()))
            out += [(int(query_ids[at + i]), d, j) for d, j in best]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest rows."""
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("d"), is_query.alias("q"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.max("d").alias("d")).first()
    blocks = lambda n, size: max(1, math.ceil(8 * n * (found.d or 1) / size))
    query_blocks, row_blocks = blocks(found.q, QUERY_BYTES), blocks(found.n, ROW_BYTES)
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.filter("q").select("id", "v", "d").distinct().select("*", block(query_blocks, 1).alias("qb"), every(row_blocks).alias("rb"))
    right = rows.select("id", "v", "d", block(row_blocks, 2).alias("rb"), every(query_blocks).alias("qb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got = tile(a["id"].to_numpy(), matrix(a["v"]), b["id"].to_numpy(), matrix(b["v"]), k) if a.num_rows and b.num_rows else []
        q, d, i = zip(*got) if got else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "score": pa.array(d, pa.float64()), "vec_id": pa.array(i, pa.int64())})

    cell = ["d", "qb", "rb"]
    heaps = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, "query_id long, score double, vec_id long")
    ranked = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
