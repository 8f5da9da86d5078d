"""F8: word vectors whose vocabulary never meets the driver: shifted positive PMI of hashed co-occurrences, factorised at random.

Words are hashed into ``BUCKETS`` rows and, as contexts, into ``CONTEXTS`` columns, so memory is set by these and the rank, not by the vocabulary:

1. tasks count co-occurrences within ``WINDOW`` tokens and send their non-zero counts by blocks of rows, which meet by block;
2. each count becomes max(0, PMI - log(SHIFT)), contexts smoothed by the power 0.75 (Levy and Goldberg 2014); blocks do that as they are read;
3. a randomised range finder (Halko, Martinsson and Tropp 2011) takes a random matrix of the contexts' height, multiplies it by the blocks and their
   transposes a few times, each product a sum over blocks, and orthonormalises it in between. The driver holds contexts x rank numbers;
4. the Gram matrix of the blocks' projections gives the singular values, and each row's vector is its projection scaled by their roots.

The last quarter of a vector is the word's own random signs, as long as the factors on average: very frequent words have next to no PMI with anything,
and words that training never saw have no factors at all, but both still count in a text's vector, the mean over all its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.operators.chunks import CHUNK, chunks, sum_chunks
from provenance_spark.session import shuffle_partitions, workspace_path

BUCKETS = 1 << 14
CONTEXTS = 1 << 11
WINDOW = 5
SHIFT = 2.0
SMOOTH = 0.75
#: Columns beyond the rank, and products with the matrix and its transpose, that make the range exact enough.
OVERSAMPLE = 16
POWERS = 2
BLOCK = 256
#: Texts whose pairs a task holds at once.
HELD = 512
#: One in so many components is a word's own.
OWN = 4


@dataclass(frozen=True)
class WordVectors:
    """``table[bucket]`` is the vector of the words that hash there."""

    table: np.ndarray

    @property
    def dim(self) -> int:
        return self.table.shape[1]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pd.DataFrame({"bucket": np.arange(len(self.table)), "vector": [v.tolist() for v in self.table]})
        spark.createDataFrame(rows, "bucket int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> WordVectors:
        rows = spark.read.parquet(path).toPandas().sort_values("bucket")  # one row a bucket
        return WordVectors(np.array(rows["vector"].tolist()))


def bucket_ids(tokens: Column, buckets: int) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and each row's length."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths


def cooccurrences(texts: DataFrame, tokens_col: str, buckets: int, contexts: int, window: int) -> DataFrame:
    """``(block, m)``: counts of ``BLOCK`` rows by all contexts, as bytes of 64-bit integers. Blocks without counts are missing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets * contexts, np.int32)
        for column in (b.column(0).slice(at, HELD) for b in batches for at in range(0, b.num_rows, HELD)):
            ids, lengths = _arrays(column)
            text = np.repeat(np.arange(len(lengths)), lengths)
            for d in range(1, min(window, len(ids) - 1) + 1):
                same = text[:-d] == text[d:]
                left, right = ids[:-d][same], ids[d:][same]
                pairs = np.concatenate([left * contexts + right % contexts, right * contexts + left % contexts])
                pairs = np.sort(pairs.astype(np.int32))  # equal pairs meet, and the sums are visited in order
                starts = np.flatnonzero(np.diff(pairs, prepend=-1))
                sums[pairs[starts]] += np.diff(starts, append=len(pairs)).astype(np.int32)
        size = BLOCK * contexts
        for block in range(-(-buckets // BLOCK)):
            part = sums[block * size:(block + 1) * size]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                                                  pa.array([part[at]], pa.list_(pa.int32()))], names=["block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a task has about buckets / BLOCK / partitions of them
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                m = sums.setdefault(block, np.zeros(BLOCK * contexts, np.int64))
                m[b.column(1)[i].values.to_numpy()] += b.column(2)[i].values.to_numpy()
        for block, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["block", "m"])

    ids = texts.select(bucket_ids(F.col(tokens_col), buckets).alias("ids")).where(F.size("ids") > 1)
    n = shuffle_partitions(texts.sparkSession)
    ids = ids if texts.rdd.getNumPartitions() >= n else ids.repartition(n)
    parts = ids.mapInArrow(count, "block int, at array<int>, n array<int>")
    return parts.repartition(n, "block").mapInArrow(add, "block int, m binary")


def ppmi(counts: np.ndarray, columns: np.ndarray, shift: float = SHIFT) -> np.ndarray:
    """max(0, log(p(row, context) / (p(row) p'(context))) - log(shift)); ``columns`` holds the smoothed context shares."""
    rows = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log(counts / (rows * columns)) - np.log(shift)
    return np.where(counts > 0, np.maximum(out, 0), 0.0)


def _total(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], contexts: int) -> np.ndarray:
    """The sum of ``part`` over all blocks; a task adds up its own, and array chunks meet by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for m in b.column(0).to_pylist():
                total += part(np.frombuffer(m, np.int64).reshape(BLOCK, contexts))
        rows = [{"key": 0, "chunk": c, "v": v} for c, v in chunks(total.ravel()) if v.any()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int32()), ("chunk", pa.int32()), ("v", pa.list_(pa.float64()))]))

    out = np.zeros(int(np.prod(shape)))
    for _, c, v in sum_chunks(blocks.select("m").mapInArrow(run, "key int, chunk int, v array<double>")).collect():  # shape's numbers in all
        out[c * CHUNK:c * CHUNK + len(v)] = v
    return out.reshape(shape)


def fit_word_vectors(df: DataFrame, tokens_col: str, dim: int = 64, buckets: int = BUCKETS, contexts: int = CONTEXTS, window: int = WINDOW,
                     seed: int = 1) -> WordVectors:
    """Vectors from all tokens of ``df``; null and empty texts count nothing, and without any co-occurrence all factors are zero."""
    spark, own = df.sparkSession, dim // OWN
    table = np.zeros((buckets, dim))
    if factors(spark, df, tokens_col, table[:, :dim - own], contexts, window, seed):
        length = np.sqrt((table ** 2).sum(1)).mean()
    else:
        length = 1.0
    if own:
        table[:, dim - own:] = np.random.default_rng([seed, 1]).choice([-1.0, 1.0], (buckets, own)) * length / np.sqrt(own)
    return WordVectors(table)


def factors(spark: SparkSession, df: DataFrame, tokens_col: str, out: np.ndarray, contexts: int, window: int, seed: int) -> bool:
    """The factors of every bucket, written into ``out``; False if nothing co-occurs."""
    buckets, dim = out.shape
    path = workspace_path(spark, "cooccurrences")
    cooccurrences(df, tokens_col, buckets, contexts, window).write.parquet(path)
    blocks = spark.read.parquet(path)
    seen = _total(blocks, lambda m: m.sum(0).astype(float), (contexts,), contexts) ** SMOOTH
    if not seen.any():
        return False
    columns = np.where(seen > 0, seen / seen.sum(), 1.0)
    width = min(contexts, dim + OVERSAMPLE)
    basis = np.random.default_rng(seed).normal(size=(contexts, width))

    def back(m: np.ndarray) -> np.ndarray:
        a = ppmi(m, columns)
        return a.T @ (a @ basis)

    for _ in range(POWERS):
        basis = np.linalg.qr(_total(blocks, back, (contexts, width), contexts))[0]

    def gram(m: np.ndarray) -> np.ndarray:
        y = ppmi(m, columns) @ basis
        return y.T @ y

    squares, turn = np.linalg.eigh(_total(blocks, gram, (width, width), contexts))
    order = np.argsort(-squares)[:dim]
    roots = np.sqrt(np.maximum(squares[order], 0))
    with np.errstate(divide="ignore"):
        scale = np.where(roots > 1e-9 * max(roots.max(initial=0), 1e-300), roots ** -0.5, 0.0)
    final = (basis @ turn[:, order]) * scale
    final *= np.where(final[np.abs(final).argmax(0), np.arange(final.shape[1])] < 0, -1, 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = ppmi(np.frombuffer(m, np.int64).reshape(BLOCK, contexts), columns) @ final
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["block", "v"])

    for r in blocks.mapInArrow(project, "block int, v binary").collect():  # buckets x rank numbers in all
        rows = out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK]
        rows[:, :len(order)] = np.frombuffer(r["v"]).reshape(BLOCK, -1)[:len(rows)]
    return True


def mean_vectors(df: DataFrame, model: WordVectors, tokens_col: str, output_col: str = "hidden_state") -> DataFrame:
    """F8: the mean of the vectors of all a text's tokens, zero for a text without any; row-local, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model.table)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def mean(ids: pd.Series) -> pd.Series:
        table = shared.value
        rows = [np.asarray(x if x is not None else (), np.int64) for x in ids]
        return pd.Series([table[r].mean(0) if len(r) else np.zeros(table.shape[1]) for r in rows])

    return df.withColumn(output_col, mean(bucket_ids(F.col(tokens_col), len(model.table))))
