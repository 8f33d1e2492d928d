"""Exact nearest neighbours by blocks of a grid.

Vectors and queries are dealt into blocks by hash; each pair of blocks is one
group, where a matrix product scores all its pairs and the best k of each query
are kept, then the best k of those over all blocks. No side is broadcast; a
group holds two blocks, however large the tables are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
METRICS = ("cosine", "l2", "dot")


def _score(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Higher is better; l2 is negated."""
    if metric == "l2":
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T, 0))
    dots = q @ v.T
    if metric == "dot":
        return dots
    a, b = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    scale, same = a[:, None] * b[None, :], ~q.any(1)[:, None] & ~v.any(1)[None, :]  # a vector without length is like its equals only
    return np.where(scale > 0, dots / np.where(scale > 0, scale, 1), np.where(same, 1.0, 0.0))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors (id bigint, v array<float>), queries (query_id bigint, v) -> (query_id, id, score, rank): the best k of each query, from rank 0; ties go to the smaller id."""
    if metric not in METRICS:
        raise ValueError(metric)
    n_v, n_q = max(1, -(-vectors.count() // block_rows)), max(1, -(-queries.count() // block_rows))
    v = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_v).cast("bigint")).alias("vb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("qb"))
    q = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(n_q).cast("bigint")).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_v - 1).cast("bigint"))).alias("vb"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _matrix(left["v"], left.num_rows), _matrix(right["v"], right.num_rows)
        qs, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(qs) and len(ids):
            for at in range(0, len(qs), 512):
                s = _score(a[at : at + 512], b, metric)
                cut = np.partition(s, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                row, col = np.nonzero(s >= cut[:, None])  # ties with the k-th stay
                out.append((qs[at + row], ids[col], s[row, col]))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": parts[0], "id": parts[1], "score": parts[2]})

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(best, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query_id", "id", F.when(F.lit(metric == "l2"), -F.col("score")).otherwise(F.col("score")).alias("score"), (F.col("rank") - 1).cast("bigint").alias("rank"))
