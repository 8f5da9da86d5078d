"""Exact top-k inner products by no-random-access aggregation (NRA, Fagin, Lotem and Naor 2003).

Each component is a list of the candidates sorted by value: read from the top for a query's positive weights and
from the bottom for negative ones. After a list is read to some depth, a candidate seen there contributes its own value;
one not yet seen at most the value the reading has reached, and at least the list's far end. Their sums are the candidate's
upper and lower bounds. Reading stops when no outsider's upper bound reaches the k-th best lower bound, or when so
few candidates are left that their final scores can be resolved at once; else it goes deeper, in the end to the whole lists.

Candidates are read in shards of ``SHARD`` rows, and the k best of the shards before give the first threshold. Queries
are a stated set, taken in blocks of about ``QUERY_BLOCK`` rows: one block at a time is broadcast. Bounds are
computed for many queries and candidates at once with matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.session import cut_lineage

SHARD = 4096
QUERY_BLOCK = 4096
QUERY_SLICE = 512
DEPTHS = (0.5, 0.75, 0.9)
#: Stop reading where at most this share of the pairs is undecided.
RESOLVE = 0.05


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """``(id, v)``: floor(scale * x) of each component, for vectors without null or non-finite components.

    Rows with a null id or vector take no part. Of rows with the same id the least vector counts, once.
    """
    x = F.col(vec_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def matrix(rows: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of integers as a matrix; shorter vectors end in zeros."""
    lengths = np.asarray(rows.combine_chunks().value_lengths() if isinstance(rows, pa.ChunkedArray) else rows.value_lengths(), np.int64)
    out = np.zeros((len(lengths), width))
    flat = (rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows).flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


def exact_type(q: np.ndarray, c: np.ndarray) -> type:
    """The narrowest type in which all inner products are exact (beyond 2^53, 64-bit integers that wrap beyond 2^63)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class TopK:
    """The best k candidates of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def least(self, rows: slice) -> np.ndarray:
        """The k-th best score of each query so far, or minus infinity."""
        return np.array([s[-1] if len(s) == self.k else -np.inf for s, _ in self.found[rows]])

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.found[query][0], scores]), np.concatenate([self.found[query][1], ids])
        order = np.lexsort((i, -s))[:self.k]
        self.found[query] = (s[order], i[order])

    def read(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Read one shard's lists."""
        kind = exact_type(self.vectors, vectors)
        c, lists = vectors.astype(kind), np.sort(vectors, axis=0).astype(kind)  # ascending; read from either end
        for start in range(0, len(self.ids), QUERY_SLICE):
            part = slice(start, min(start + QUERY_SLICE, len(self.ids)))
            q = self.vectors[part].astype(kind)
            own = self.ids[part][:, None] == ids[None, :]
            alive = self._alive(np.maximum(q, 0), np.minimum(q, 0), c, lists, own, self.least(part))
            if alive is None:
                scores = q @ c.T  # the lists are read to their ends: bounds have met
                keep = ~own & (scores >= self._threshold(np.where(own, -np.inf, scores), self.least(part))[:, None])
                row, col = np.nonzero(keep)
                score = scores[row, col]
            else:
                row, col = np.nonzero(alive)
                score = np.einsum("ij,ij->i", q[row], c[col])  # resolve what is left
            ends = np.searchsorted(row, np.arange(q.shape[0] + 1))
            for n in range(q.shape[0]):
                if ends[n] < ends[n + 1]:
                    s = slice(ends[n], ends[n + 1])
                    self.add(start + n, score[s].astype(np.int64), ids[col[s]])

    def _threshold(self, lower: np.ndarray, least: np.ndarray) -> np.ndarray:
        n = lower.shape[1]
        return np.maximum(np.partition(lower, n - self.k, axis=1)[:, n - self.k], least) if n >= self.k else least

    def _alive(self, up, down, c, lists, own, least) -> np.ndarray | None:
        """The pairs that may still qualify once few enough are left, or None if the lists must be read whole."""
        n = len(c)
        for depth in DEPTHS:
            reach = min(n - 1, math.ceil(depth * n))
            top, bottom = lists[n - 1 - reach], lists[reach]
            upper = up @ np.maximum(c, top).T + down @ np.minimum(c, bottom).T
            lower = up @ np.where(c >= top, c, lists[0]).T + down @ np.where(c <= bottom, c, lists[-1]).T
            threshold = self._threshold(np.where(own, -np.inf, lower), least)
            alive = (upper >= threshold[:, None]) & ~own
            if alive.mean() <= RESOLVE:
                return alive
        return None


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``queries`` (a condition on ``id``) holds, the k best others.

    Rows take part as in ``quantised``; vectors of unequal length count as if the shorter ended in zeros. Ties go to the
    smaller id. An empty table, or one without queries, gives no rows.

    Scores are 64-bit integers: with n numbers a vector, components below ``sqrt(2^63 / n) / scale`` are safe (5.9e6 for 64
    numbers and scale 64). Beyond it sums may wrap around, and ``floor`` saturates from 2^63 on; the order of such vectors is undefined.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(quantised(vectors, id_col, vec_col, scale))
    shape = rows.agg(F.count(F.when(queries, 1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width, blocks = shape["width"] or 0, max(1, math.ceil(shape["n"] / QUERY_BLOCK))
    parts = []
    for block in range(blocks):
        got = rows.where(queries & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).toArrow()
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), matrix(got.column("v"), width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = TopK(*shared.value, k)
            held: list[pa.RecordBatch] = []

            def read() -> None:
                whole = pa.Table.from_batches(held)
                best.read(whole.column(0).to_numpy(), matrix(whole.column(1), width))
                held.clear()

            if len(best.ids):
                for b in batches:
                    for start in range(0, b.num_rows, SHARD):
                        held.append(b.slice(start, SHARD))
                        if sum(x.num_rows for x in held) >= SHARD:
                            read()
                if held:
                    read()
            sizes = [len(s) for s, _ in best.found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(best.ids, sizes), pa.int64())]
                + [pa.array(np.concatenate([f[i] for f in best.found] or [[]]), pa.int64()) for i in (1, 0)],
                names=["query_id", "vec_id", "score"])

        parts.append(rows.mapInArrow(run, "query_id long, vec_id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
