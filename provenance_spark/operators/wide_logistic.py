"""Logistic regression over wide sparse rows, all points of a grid at once (M5).

Spark's ``LogisticRegression`` makes hundreds of jobs of three stages for each point of a grid, and nearly all their time is overhead. Here a
job gives loss and gradient of all points that still need one, and few jobs are needed:

* rows are packed once into blocks of at most ``HELD`` numbers, which stay in the executors (memory, then disk);
* a task adds up its blocks' losses and gradients, which meet by chunks (``operators.chunks``); rows never move;
* the driver runs L-BFGS for each point, as Spark's own fit does: it holds weights and ``MEMORY`` pairs of 32-bit vectors, never rows.
  Steps start from the roots of the features' curvatures, which takes half the jobs of equal steps.

The minimum is that of Spark's fit with ``standardization=False`` and no intercept: a feature that never varies gets no weight. A point has
converged when its gradient is ``TOLERANCE`` of the penalty's, which bounds the relative error of the weights by the same number.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenance_spark.operators.chunks import chunks, total_of
from provenance_spark.session import shuffle_partitions

MEMORY, TOLERANCE = 25, 1e-4
#: Numbers of a block: some megabytes in a task.
HELD = 1 << 19

Point = tuple[float, np.ndarray]


@dataclass
class WideModel:
    """Class 1 iff ``x·coef > 0``; ``passes`` over the rows were made until it had converged."""
    coef: np.ndarray
    passes: int


def _arrays(df: DataFrame, features: str, label: str) -> DataFrame:
    """``(idx, val, y)`` of ML vectors, sparse or dense."""
    v = F.unwrap_udt(F.col(features))
    every = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    idx = F.when(v["type"] == 0, v["indices"]).when(F.size(v["values"]) > 0, every).otherwise(F.array().cast("array<int>"))
    return df.select(idx.alias("idx"), v["values"].alias("val"), F.col(label).cast("double").alias("y"))


def shape(df: DataFrame, features: str, label: str) -> tuple[int, int]:
    """Rows and width; no rows, null features and labels other than 0 and 1 are errors."""
    v = F.unwrap_udt(F.col(features))
    y = F.col(label)
    bad = F.col(features).isNull() | y.isNull() | ~y.isin(0, 1)
    n, wrong, width = df.agg(F.count("*"), F.count(F.when(bad, 1)), F.max(F.coalesce(v["size"], F.size(v["values"])))).first()
    if wrong:
        raise ValueError(f"{wrong} rows have no features or a label other than 0 and 1")
    if not n:
        raise ValueError("no rows to train on")
    return n, width


def packed(df: DataFrame, features: str, label: str) -> RDD:
    """Blocks ``(row lengths, ids, values, labels)`` as bytes; a block ends where its rows pass ``HELD`` numbers."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.cumsum(lengths, dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // HELD)) + 1), len(ends)]
            for at, to in zip(cuts, cuts[1:]):
                piece = b.slice(at, to - at)
                parts = [lengths[at:to], piece.column(0).flatten().to_numpy().astype(np.int32), piece.column(1).flatten().to_numpy(), piece.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["n", "idx", "val", "y"])

    blocks = _arrays(df, features, label).mapInArrow(pack, "n binary, idx binary, val binary, y binary")
    return blocks.rdd.map(tuple)


def _block(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, idx, val, y = row
    lengths = np.frombuffer(n, np.int32)
    return np.repeat(np.arange(len(lengths)), lengths), np.frombuffer(idx, np.int32).astype(np.int64), np.frombuffer(val), np.frombuffer(y)


def margins(coef: np.ndarray, rows: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, coef[idx] * val, n)


def summed(blocks: RDD, add: Callable[..., None], shape: tuple[int, ...], partitions: int) -> np.ndarray:
    """The sum over all blocks of what ``add(total, *block)`` adds to ``total``: tasks send chunks, which meet by number."""
    def run(part: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for block in map(_block, part):
            total = np.zeros(shape) if total is None else total
            add(total, *block)
        if total is not None:
            yield from chunks(total.ravel())

    return total_of(blocks.mapPartitions(run), int(np.prod(shape)), partitions).reshape(shape)


def moments(blocks: RDD, width: int, partitions: int) -> np.ndarray:
    """Sums and sums of squares of every feature."""
    def add(total: np.ndarray, rows: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray) -> None:
        total[0] += np.bincount(idx, val, width)
        total[1] += np.bincount(idx, val * val, width)

    return summed(blocks, add, (2, width), partitions)


def totals(blocks: RDD, coefs: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed losses of all rows for each row of ``coefs``, and their gradients: one job."""
    sent, (points, width) = blocks.context.broadcast(coefs), coefs.shape

    def add(total: np.ndarray, rows: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray) -> None:
        for coef, out in zip(sent.value, total):
            z = margins(coef, rows, idx, val, len(y))
            slope = 0.5 * (1 + np.tanh(0.5 * z)) - y
            out[:-1] += np.bincount(idx, slope[rows] * val, width)
            out[-1] += (np.logaddexp(0, z) - y * z).sum()

    out = summed(blocks, add, (points, width + 1), partitions)
    sent.destroy()
    return out[:, -1], out[:, :-1]


def direction(g: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray, float]], curvature: np.ndarray) -> np.ndarray:
    """The step that the gradient and the last pairs of steps and gradient changes suggest; 32 bits are enough for a suggestion."""
    move, used = -g.astype(np.float32), []
    for s, y, sy in reversed(pairs):
        used.append(float(s @ move) / sy)
        move -= used[-1] * y
    move /= curvature
    if pairs:
        _, y, sy = pairs[-1]
        move *= sy / float(y @ (y / curvature))
    for (s, y, sy), a in zip(pairs, reversed(used)):
        move += (a - float(y @ move) / sy) * s
    return move.astype(np.float64)


def minimise(coef: np.ndarray, penalty: float, curvature: np.ndarray) -> Generator[np.ndarray, Point, np.ndarray]:
    """L-BFGS with weak Wolfe steps from ``curvature``: yields weights, is sent value and gradient there (penalty included), returns the minimum."""
    f, g = yield coef
    curvature, pairs = curvature.astype(np.float32), []
    while np.linalg.norm(g) > max(TOLERANCE * penalty * np.linalg.norm(coef), 1e-13):
        move = direction(g, pairs, curvature)
        if not g @ move < 0:
            pairs, move = [], -g / curvature
        slope, low, high, step = g @ move, 0.0, np.inf, 1.0
        for _ in range(40):
            at = coef + step * move
            f_at, g_at = yield at
            if not f_at <= f + 1e-4 * step * slope:
                high = step
            elif g_at @ move < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        else:
            return coef  # no step gives less: the sums' rounding is reached
        s, y = at - coef, g_at - g
        pairs = [*pairs, (s.astype(np.float32), y.astype(np.float32), float(s @ y))][-MEMORY:]
        coef, f, g = at, f_at, g_at
    return coef


def fit(train: DataFrame, penalties: Sequence[float], features: str, label: str, max_passes: int) -> list[WideModel]:
    """The model of each penalty: minima of the mean log loss plus half the penalty times the squared weights."""
    rows, width = shape(train, features, label)
    n = shuffle_partitions(train.sparkSession)
    blocks = packed(train, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    found: list[WideModel | None] = [None] * len(penalties)
    try:
        sums, squares = moments(blocks, width, n)
        varies = squares * rows - sums * sums > 1e-12 * squares * rows
        searches = [minimise(np.zeros(width), p, np.sqrt(p + 0.1 * squares / rows)) for p in penalties]
        asked = {i: next(s) for i, s in enumerate(searches)}
        for done in range(1, max_passes + 1):
            losses, grads = totals(blocks, np.stack(list(asked.values())), n)
            if not np.isfinite(losses).all():
                raise ValueError("the features aren't finite")
            for (i, coef), loss, grad in zip(list(asked.items()), losses, grads):
                value = loss / rows + 0.5 * penalties[i] * (coef @ coef)
                try:
                    asked[i] = searches[i].send((value, varies * grad / rows + penalties[i] * coef))
                except StopIteration as end:
                    found[i] = WideModel(end.value, done)
                    del asked[i]
            if not asked:
                return found
        raise RuntimeError(f"no convergence in {max_passes} passes for penalties {[penalties[i] for i in asked]}")
    finally:
        blocks.unpersist()


def accuracies(models: Sequence[WideModel], df: DataFrame, features: str, label: str) -> list[float]:
    """Accuracy of every model, in one pass over ``df``."""
    blocks = packed(df, features, label)
    sent = blocks.context.broadcast(np.stack([m.coef for m in models]))

    def run(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        for rows, idx, val, y in map(_block, part):
            yield np.array([len(y), *[((margins(c, rows, idx, val, len(y)) > 0) == (y == 1)).sum() for c in sent.value]])

    got = blocks.mapPartitions(run).fold(np.zeros(len(models) + 1, np.int64), np.add)  # a few numbers a task
    sent.destroy()
    if not got[0]:
        raise ValueError("no rows to score: the valid or test split is empty")
    return [float(x / got[0]) for x in got[1:]]
