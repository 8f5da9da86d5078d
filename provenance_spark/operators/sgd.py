"""Out-of-core linear models (M6, X1, D3): one SGD pass per partition, then parameter mixing.

Each partition runs plain SGD, its weights touched in blocks of rows, for all five margin losses at once (sparse rows given
as index/value arrays), starting from the same weights; the partition weights are averaged
weighted by row count (parameter mixing, Zinkevich et al. 2010; McDonald et al. 2010). The average
is a distributed sum of array chunks (only chunks with non-zero weights travel) and the driver receives
one vector per loss, bounded by the feature count. ``foreachBatch`` reuses :func:`sgd_epoch` to continue from stored
weights (ST2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators.chunks import CHUNK, chunks, sum_chunks

ALPHA = 1e-4  # scale of the "optimal" learning-rate schedule (there is no penalty)


#: Rows whose weights are read and written at once. The steps are those of one row after another, whatever the block.
BLOCK = 32
#: Rows whose entries a task holds at once as arrays, several for each entry.
HELD = 256


def dloss(loss: str, p: float, y: float) -> float:
    """Derivative of the loss with respect to the prediction ``p`` for label ``y`` in {-1, 1}."""
    z = p * y
    if loss == "hinge":
        return -y if z <= 1.0 else 0.0
    if loss == "perceptron":
        return -y if z <= 0.0 else 0.0
    if loss == "log_loss":
        return -y / (math.exp(min(z, 500.0)) + 1.0)
    if loss == "modified_huber":
        return 0.0 if z >= 1.0 else -2.0 * (1.0 - z) * y if z >= -1.0 else -4.0 * y
    if loss == "squared_hinge":
        return -2.0 * (1.0 - z) * y if z < 1.0 else 0.0
    raise ValueError(loss)


def loss_value(loss: str, m: np.ndarray) -> np.ndarray:
    """X1 on numpy margins (the Column form is :func:`margin_loss`)."""
    if loss == "hinge":
        return np.maximum(0.0, 1.0 - m)
    if loss == "perceptron":
        return np.maximum(0.0, -m)
    if loss == "log_loss":
        return np.log1p(np.exp(-m))
    if loss == "modified_huber":
        return np.where(m >= -1.0, np.maximum(0.0, 1.0 - m) ** 2, -4.0 * m)
    if loss == "squared_hinge":
        return np.maximum(0.0, 1.0 - m) ** 2
    raise ValueError(loss)


def margin_loss(loss: str, m: Column) -> Column:
    """X1 as native expressions, m = y·f(x)."""
    if loss == "hinge":
        return F.greatest(F.lit(0.0), 1.0 - m)
    if loss == "perceptron":
        return F.greatest(F.lit(0.0), -m)
    if loss == "log_loss":
        return F.log(1.0 + F.exp(-m))
    if loss == "modified_huber":
        return F.when(m >= -1.0, F.pow(F.greatest(F.lit(0.0), 1.0 - m), 2)).otherwise(-4.0 * m)
    if loss == "squared_hinge":
        return F.pow(F.greatest(F.lit(0.0), 1.0 - m), 2)
    raise ValueError(loss)


def margin_slope(loss: str, m: Column) -> Column:
    """Derivative of :func:`margin_loss` by the margin; the kinks belong to the side that still learns."""
    if loss == "hinge":
        return F.when(m <= 1.0, -1.0).otherwise(0.0)
    if loss == "perceptron":
        return F.when(m <= 0.0, -1.0).otherwise(0.0)
    if loss == "log_loss":
        return -1.0 / (F.exp(m) + 1.0)
    if loss == "modified_huber":
        return F.when(m >= 1.0, 0.0).when(m >= -1.0, -2.0 * (1.0 - m)).otherwise(-4.0)
    if loss == "squared_hinge":
        return F.when(m < 1.0, -2.0 * (1.0 - m)).otherwise(0.0)
    raise ValueError(loss)


def loss_gradients(df: DataFrame, array_col: str, f: Column, y: Column, losses: Sequence[str] = fv.SGD_LOSSES) -> DataFrame:
    """``(dim, one column a loss)``: mean gradient by every weight at scores ``f`` for labels ``y`` in {-1, 1}.

    The last dim is the intercept's. Sums combine before they are shuffled, so a task sends one row a dim.
    """
    x = F.concat(F.transform(array_col, lambda e: e.cast("double")), F.array(F.lit(1.0)))
    slopes = df.select(x.alias("x"), *[(margin_slope(loss, f * y) * y).alias(loss) for loss in losses])
    each = slopes.select(*losses, F.posexplode("x").alias("dim", "v"))
    return each.groupBy("dim").agg(*[F.avg(F.col(loss) * F.col("v")).alias(loss) for loss in losses])


def _initial_t(losses: Sequence[str]) -> np.ndarray:
    """Offset of the "optimal" schedule eta_t = 1 / (alpha (t0 + t)), per loss.

    The first step is scaled by the loss's own gradient size at a typical margin, so the steep
    losses (squared hinge, modified Huber) start with proportionally smaller steps.
    """
    typw = np.sqrt(1.0 / np.sqrt(ALPHA))
    eta0 = np.array([typw / max(1.0, abs(dloss(loss, -typw, 1.0))) for loss in losses])
    return 1.0 / (eta0 * ALPHA)


class Rows:
    """Sparse rows one after another: places and values of their entries, and the row of each.

    With ``compact`` entries of the same place are summed and each row is scaled to unit length (hashed features).
    """

    def __init__(self, idx: Sequence, val: Sequence, compact: bool):
        self.n = len(idx)
        sizes = np.fromiter(map(len, idx), np.int64, self.n)
        self.of = np.repeat(np.arange(self.n), sizes)
        self.at = np.concatenate([np.asarray(i, np.int64) for i in idx]) if self.n else np.zeros(0, np.int64)
        self.val = np.concatenate([np.asarray(v, np.float64) for v in val]) if self.n else np.zeros(0)
        if compact and len(self.at):
            width = int(self.at.max()) + 1
            key, inverse = np.unique(self.of * width + self.at, return_inverse=True)
            self.of, self.at, self.val = key // width, key % width, np.bincount(inverse, self.val)
            self.val = self.val / np.sqrt(np.bincount(self.of, self.val ** 2, self.n))[self.of]
        self.start = np.searchsorted(self.of, np.arange(self.n + 1))

    def predict(self, W: np.ndarray, b: np.ndarray, first: int, last: int) -> np.ndarray:
        """Predictions of all weight vectors for the rows from ``first`` to ``last``."""
        s = slice(self.start[first], self.start[last])
        of = self.of[s] - first
        return np.stack([np.bincount(of, w, last - first) for w in W[:, self.at[s]] * self.val[s]]) + b[:, None]


def sgd_epoch(rows: pd.DataFrame, W: np.ndarray, b: np.ndarray, losses: Sequence[str], step: int,
              compact: bool = False, block: int = BLOCK) -> int:
    """One pass over ``rows`` (columns idx, val, y) updating each loss's (w, b) in place, row after row.

    Weights are read and written for ``block`` rows at a time. Within a block a row's prediction is what the weights before it give, less
    the steps of the rows before times their inner products with this one. So the result is that of single rows, while the sparse weights are touched once a block.
    """
    t0 = _initial_t(losses).tolist()
    held = Rows(rows["idx"].tolist(), rows["val"].tolist(), compact)
    y = np.where(rows["y"].to_numpy() == 1, 1.0, -1.0).tolist()
    for first in range(0, held.n, block):
        last = min(first + block, held.n)
        s = slice(held.start[first], held.start[last])
        touched, inverse = np.unique(held.at[s], return_inverse=True)
        dense = np.zeros((last - first, len(touched)))
        np.add.at(dense, (held.of[s] - first, inverse), held.val[s])
        p = W[:, touched] @ dense.T + b[:, None]
        shared = dense @ dense.T + 1.0  # the intercept is an entry of 1 in every row
        by = np.zeros((len(losses), last - first))
        for j in range(last - first):
            now = (p[:, j] - by[:, :j] @ shared[:j, j]).tolist()
            by[:, j] = [dloss(loss, q, y[first + j]) / (ALPHA * (t + step)) for loss, q, t in zip(losses, now, t0, strict=True)]
            step += 1
        W[:, touched] -= by @ dense
        b -= by.sum(1)
    return step


def pieces(rows: pd.DataFrame, block: int = BLOCK) -> Iterator[pd.DataFrame]:
    """``rows`` in whole blocks of at most ``HELD`` rows (or one block): what a task unpacks doesn't grow with its Arrow batch."""
    size = block * max(1, HELD // block)
    for at in range(0, len(rows), size):
        yield rows.iloc[at:at + size]


def mixed_sgd(df: DataFrame, dim: int, losses: Sequence[str] = fv.SGD_LOSSES,
               init: tuple[np.ndarray, np.ndarray] | None = None,
              compact: bool = False, step: int = 0, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Fit all losses in one scan of ``df`` (idx array<int>, val array<double>, y int).

    ``step`` is the number of steps already made, so the learning rate goes on where the pass before
    ended; the third result is the number after this pass: ``step`` and the mean rows of a
    partition. On one partition, passes over two halves equal one pass over both.
    """
    n_l = len(losses)
    W0 = np.zeros((n_l, dim)) if init is None else init[0]
    b0 = np.zeros(n_l) if init is None else init[1]
    sc = df.sparkSession.sparkContext
    start = sc.broadcast((W0, b0))

    def fit_partition(batches):
        W, b = start.value[0].copy(), start.value[1].copy()
        n, t = 0, step
        for pdf in batches:
            for part in pieces(pdf, block):
                t = sgd_epoch(part, W, b, losses, t, compact, block)
            n += len(pdf)
        if n == 0:
            return
        rows = [(k, c, piece) for k in range(n_l) for c, piece in chunks(W[k] * n) if piece.any()]
        rows += [(k, -1, np.array([b[k] * n, n, 1.0])) for k in range(n_l)]
        yield pd.DataFrame(rows, columns=["key", "chunk", "v"])

    parts = df.select("idx", "val", "y").mapInPandas(fit_partition, "key long, chunk long, v array<double>")
    # every partition with rows sends one chunk -1 per loss: its intercept, its rows and a 1
    sums = sum_chunks(parts).collect()  # at most losses x (features / CHUNK + 2) rows
    start.unpersist()
    if not sums:  # no rows at all: nothing moves
        return W0, b0, step
    ends = {r["key"]: r["v"] for r in sums if r["chunk"] < 0}
    rows, tasks = int(ends[0][1]), int(ends[0][2])
    W, b = np.zeros((n_l, dim)), np.array([ends[k][0] / rows for k in range(n_l)])
    # partitions that saw no rows keep the start weights out of the average by construction
    for r in sums:
        if r["chunk"] >= 0:
            W[r["key"], r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(r["v"])] = np.array(r["v"]) / rows
    return W, b, step + -(-rows // tasks)


def evaluate(df: DataFrame, W: np.ndarray, b: np.ndarray, losses: Sequence[str] = fv.SGD_LOSSES,
             by: str = "split", compact: bool = False) -> DataFrame:
    """Per (group, loss): accuracy and mean loss of every fitted weight vector, in one scan."""
    sc = df.sparkSession.sparkContext
    model = sc.broadcast((W, b))

    def score(batches):
        Wm, bm = model.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            out = []
            for g, part in pdf.groupby(by):
                y = np.where(part["y"].to_numpy() == 1, 1.0, -1.0)
                f = np.concatenate([Rows(p["idx"].tolist(), p["val"].tolist(), compact).predict(Wm, bm, 0, len(p)) for p in pieces(part)], axis=1)
                for k, loss in enumerate(losses):
                    m = f[k] * y
                    out.append((g, loss, int(((f[k] > 0).astype(int) == (y > 0)).sum()),
                                float(loss_value(loss, m).sum()), len(y)))
            yield pd.DataFrame(out, columns=[by, "loss", "ok", "loss_sum", "n"])

    schema = f"{by} string, loss string, ok long, loss_sum double, n long"
    res = (df.select(by, "idx", "val", "y").mapInPandas(score, schema)
           .groupBy(by, "loss").agg((F.sum("ok") / F.sum("n")).alias("accuracy"),
                                    (F.sum("loss_sum") / F.sum("n")).alias("mean_loss")))
    return res
