"""Exact top-k inner products by vector-approximation files.

Every vector has a file of cells: each component's place among 16 quantiles of its block. Rows and
queries are packed into blocks; each pair of a row block and a query block is one task record. The scan
of the cells bounds each score from above; exact vectors are read for all bounds that reach the k-th best
score known so far (at first that of the highest bounds), so that ties are decided by the smaller id. The
k best of each task meet in a ranked merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELLS = 16
#: Queries whose bounds are made together, and pairs whose exact scores are.
CHUNK, PAIRS = 256, 1 << 15
_BLOCK = "dims int, block long, n long, ids binary, vectors binary, cells binary, low binary, high binary"


def _narrow(x: np.ndarray) -> np.dtype:
    """The narrowest of 2, 4 or 8 bytes that holds all components."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(np.dtype(k) for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max)


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dims), strict=True))
            edges = np.quantile(x, np.arange(1, CELLS) / CELLS, axis=0, method="lower") if len(x) else np.zeros((CELLS - 1, dims))
            cells = np.zeros(x.shape, dtype=np.uint8)
            low, high = np.zeros((CELLS, dims), np.int64), np.zeros((CELLS, dims), np.int64)
            for d in range(dims):
                cells[:, d] = np.searchsorted(edges[:, d], x[:, d], side="right")
                for c in range(CELLS):
                    inside = x[cells[:, d] == c, d]
                    if len(inside):
                        low[c, d], high[c, d] = inside.min(), inside.max()
            number += 1
            kind = _narrow(x)
            x, low, high = (a.astype(kind) for a in (x, low, high))
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([v], pa.int64()) for v in (number, len(ids))), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, cells, low, high))], [f.split(" ")[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts, ids = np.concatenate([[0], np.cumsum(lengths)]), batch.column(0).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                for i in range(0, len(at), size):
                    part = at[i : i + size]
                    x = flat[starts[part][:, None] + np.arange(dims)] if dims else np.zeros((len(part), 0), np.int64)
                    held.setdefault(dims, []).append((ids[part], x))
                    if sum(len(v[0]) for v in held[dims]) >= size:
                        yield packed(dims)
        for dims in list(held):
            yield packed(dims)

    return run


def _matrix(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (n * dims)}").reshape(-1, dims) if dims else np.zeros((n, 0), np.int64)


def _best(k: int, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each query number, ties to the smaller id."""
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], s[keep], i[keep]


def _scan(k: int, row: dict, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best`` (query numbers, scores, ids) after one row block has met one query block."""
    dims, ids, q_ids = row["dims"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
    vectors, queries = _matrix(row["vectors"], len(ids), dims), _matrix(row["q_vectors"], len(q_ids), dims)
    largest = lambda x: max(-int(x.min()), int(x.max()), 0) if x.size else 0
    # doubles hold these sums exactly, or else whole numbers are multiplied
    kind = np.float64 if largest(vectors) * largest(queries) * dims < 1 << 53 else np.int64
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    cells, axis = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dims), np.arange(dims)
    low, high = (np.frombuffer(row[c], f"i{len(row[c]) // (CELLS * dims)}").reshape(CELLS, dims).astype(kind)[cells, axis] if dims else vectors for c in ("low", "high"))
    exact = lambda r, q: np.concatenate([np.einsum("nd,nd->n", vectors[r[i : i + PAIRS]], queries[q[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)] or [np.empty(0, kind)])
    # the k-th best score of each query so far
    least = np.full(len(q_ids), -np.inf) if kind is np.float64 else np.full(len(q_ids), np.iinfo(np.int64).min)
    firsts, counts = np.unique(best[0], return_index=True)[1], np.unique(best[0], return_counts=True)
    full = counts[1] == k
    least[counts[0][full]] = best[1][firsts[full] + k - 1]
    seeds = min(len(ids), 4 * k)
    found = [best]
    for at in range(0, len(q_ids), CHUNK):
        own = queries[at : at + CHUNK]
        bound = np.maximum(own, 0) @ high.T + np.minimum(own, 0) @ low.T
        bar = least[at : at + CHUNK]
        new = np.flatnonzero(bar == least.dtype.type(-np.inf if kind is np.float64 else np.iinfo(np.int64).min))
        if len(new):
            top = np.argpartition(-bound[new], seeds - 1, axis=1)[:, :seeds]
            q, r = np.repeat(new, seeds), top.ravel()
            other = ids[r] != q_ids[at + q]
            q, s, _ = _best(k, q[other], exact(r[other], at + q[other]), ids[r[other]])
            starts, n = np.unique(q, return_index=True)[1], np.unique(q, return_counts=True)
            bar[n[0][n[1] == k]] = s[starts[n[1] == k] + k - 1]
        q, r = np.nonzero(bound >= bar[:, None])
        other = ids[r] != q_ids[at + q]
        q, r = q[other], r[other]
        s = exact(r, at + q)
        good = s >= bar[q]
        found.append(_best(k, at + q[good], s[good].astype(np.int64), ids[r[good]]))
    return _best(k, *(np.concatenate(c) for c in zip(*found, strict=True)))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what the task has found so far, by query block
        found: dict[int, tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                q_ids, best = found.get(row["q_block"]) or (np.frombuffer(row["q_ids"], np.int64), (np.empty(0, np.int64),) * 3)
                found[row["q_block"]] = q_ids, _scan(k, row, best)
        for q_ids, (q, s, i) in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def scaled(vector: Column, factor: float = 1024.0) -> Column:
    """floor(factor * x) of each component; null where the vector or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("bigint")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products among ``vectors``.

    Both sides have ``vec_id long, vector array<bigint>``. A query takes no part against rows with its own
    id or with another number of dimensions. Ties go to the smaller id; rows that share an id count each. Null
    vectors and ids take no part. Fewer rows than ``k`` are all returned; an empty side gives no row.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long"), "vector").filter("vec_id is not null and vector is not null")
    files = written(clean(vectors).mapInArrow(_blocks(rows), _BLOCK), "va-rows")
    # few and full blocks of queries, however many tasks read them
    asked = written(clean(queries).hint("rebalance").mapInArrow(_blocks(query_rows), _BLOCK), "va-queries").select("dims", "n", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # a block's number is its task's and its own in it
    task, own = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    sums = files.agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.max(own).alias("most")).first()
    q_sums = asked.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    # a grid of tasks: each row block meets all query blocks of its dimensions, with about as many copies moved of the one as of the other
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = min(max(1, round(math.sqrt(n * (q_sums.n or 0) / (sums.n or 1)))), max(1, q_sums.blocks))
    down = max(1, min(n // across, sums.blocks))
    places = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    files = files.withColumn("down", F.pmod(task * F.lit(sums.most or 1) + own, F.lit(down))).withColumn("across", places(across))
    asked = asked.withColumn("across", F.pmod(F.xxhash64("q_block"), F.lit(across))).withColumn("down", places(down))
    # never broadcast: Spark takes the copies' size for that of the table that they come from
    found = files.drop("block", "n").hint("merge").join(asked.drop("n"), ["dims", "down", "across"]).drop("down", "across")
    found = found.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
