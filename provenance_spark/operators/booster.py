"""Linear booster (M11): rounds of second-order coordinate descent, blocks of features side by side, a whole L2 grid in one pass.

The objective of each ``lambda`` is the mean loss plus ``lambda / 2 * |w|^2``; the intercept is not penalised. A round is one pass over
the rows: tasks sum the loss, the gradient and, for each block of features, the second derivatives among its own features, for all
lambdas at once; these meet on Spark in chunks. For each block the driver then steps coordinate after coordinate through the block's
quadratic model until they rest; the intercept belongs to the first block. Blocks don't know of each other, so their joint
step may overshoot: where the next pass finds a higher objective the step is halved and the round repeated, and later rounds double it back. A lambda is
done when its largest step is below ``tol``; it is an error if that isn't reached in ``rounds`` passes.

Up to ``block`` features there is one block and few passes; features of different blocks that depend on each other
strongly take many (the bound is ``rounds``).

The driver holds ``block * d`` numbers a lambda, never rows. Rows with null features or label take no part; an empty train
split is an error. At lambda 0 on separable classes no optimum exists; such a fit ends when its objective no longer falls by ``tol``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenance_spark.operators.chunks import chunks, sum_chunks
from provenance_spark.operators.heads import LABEL, GridPoint, RidgeModel, SearchResult, ridge_accuracies

LAMBDAS = tuple(k / 10 for k in range(15))
BLOCK, ROUNDS, TOL = 256, 200, 1e-8
#: Sweeps over a block's coordinates and the change at which they rest.
SWEEPS, REST = 1000, 1e-12
#: Least curvature of a coordinate: a feature that is zero everywhere stays at zero.
FLAT = 1e-12


def blocks_of(dim: int, block: int) -> list[np.ndarray]:
    """Positions of each block's features; the last position, ``dim``, is the intercept's."""
    cut = [np.arange(a, min(a + block, dim)) for a in range(0, dim, block)]
    return [np.append(cut[0], dim), *cut[1:]]


def loss_parts(z: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative by the margin; ``y`` is 0 or 1 (logistic) or any number (squared)."""
    if loss == "squared":
        return 0.5 * (z - y) ** 2, z - y, np.ones_like(z)
    p = 0.5 * (1 + np.tanh(0.5 * z))
    return np.logaddexp(0, z) - y * z, p - y, p * (1 - p)


def moments(train: DataFrame, w: np.ndarray, groups: list[np.ndarray], loss: str) -> list[tuple[float, np.ndarray, list[np.ndarray]]]:
    """For each row of ``w`` the mean loss, its gradient and its second derivatives within each block; one pass."""
    k, d = w.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.column_stack([np.stack(pdf["x"].to_numpy()), np.ones(len(pdf))])
            parts = []
            for i in range(k):
                value, g, h = loss_parts(x @ w[i], pdf["y"].to_numpy(), loss)
                parts += [[value.sum()], x.T @ g, *[(x[:, b].T @ (x[:, b] * h[:, None])).ravel() for b in groups]]
            vec = np.concatenate([*parts, [len(pdf)]])
            acc = vec if acc is None else acc + vec
        if acc is not None:
            yield pd.DataFrame([("m", c, v) for c, v in chunks(acc)], columns=["key", "chunk", "v"])

    summed = sorted(sum_chunks(train.mapInPandas(run, "key string, chunk long, v array<double>")).collect(), key=lambda r: r["chunk"])
    if not summed:
        raise ValueError("no rows to train on")
    vec = np.concatenate([r["v"] for r in summed])
    vec, out, at = vec[:-1] / vec[-1], [], 0
    for _ in range(k):
        value, grad, at = vec[at], vec[at + 1:at + 1 + d], at + 1 + d
        second = []
        for b in groups:
            second.append(vec[at:at + len(b) ** 2].reshape(len(b), len(b)))
            at += len(b) ** 2
        out.append((float(value), grad, second))
    return out


def coordinate_steps(grad: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The step to the least value of ``grad . s + s' second s / 2``, coordinate after coordinate."""
    s, slope = np.zeros(len(grad)), grad.copy()
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(s)):
            if second[j, j] > FLAT:
                move = -slope[j] / second[j, j]
                s[j] += move
                slope += move * second[j]
                most = max(most, abs(move))
        if most < REST:
            break
    return s


def fit(train: DataFrame, lambdas: Sequence[float] = LAMBDAS, *, loss: str = "logistic", block: int = BLOCK, rounds: int = ROUNDS,
        tol: float = TOL) -> list[RidgeModel]:
    """A linear model for each lambda; ``train`` has ``x`` array<double> and ``y`` double."""
    first = train.first()
    if first is None:
        raise ValueError("no rows to train on")
    d = len(first["x"])
    groups, penalty = blocks_of(d, block), np.append(np.ones(d), 0.0)
    w = np.zeros((len(lambdas), d + 1))
    best, step, scale = [np.inf] * len(lambdas), np.zeros_like(w), np.ones(len(lambdas))
    live = list(range(len(lambdas)))
    for _ in range(rounds):
        tried = w + scale[:, None] * step
        found = dict(zip(live, moments(train, tried[live], groups, loss)))
        for i in list(live):
            value, grad, second = found[i]
            lam = lambdas[i] * penalty
            objective = value + 0.5 * float(lam @ tried[i] ** 2)
            gain = best[i] - objective
            if gain < 0 and scale[i] * np.abs(step[i]).max() >= tol:
                scale[i] /= 2  # the blocks' joint step went too far
                continue
            if gain >= 0:
                w[i], best[i] = tried[i], objective
            grad = grad + lam * tried[i]
            step[i] = 0.0
            for b, h in zip(groups, second):
                step[i, b] = coordinate_steps(grad[b], h + np.diag(lam[b]))
            scale[i] = min(1.0, 2 * scale[i])
            if np.abs(step[i]).max() < tol or gain < 0 or (lambdas[i] == 0 and gain < tol):
                live.remove(i)
        if not live:
            return [RidgeModel(w[i, :-1].copy(), float(w[i, -1]), float(lam)) for i, lam in enumerate(lambdas)]
    raise RuntimeError(f"no rest after {rounds} rounds for lambda {[lambdas[i] for i in live]}")


def booster_head(train: DataFrame, valid: DataFrame, test: DataFrame, array_col: str, lambdas: Sequence[float] = LAMBDAS,
                 label: str = LABEL, **settings) -> SearchResult:
    """Lambda chosen on valid (the first best), scored once on test."""
    known = F.col(array_col).isNotNull() & F.col(label).isNotNull()
    rows = train.where(known).select(F.col(array_col).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        models = fit(rows, lambdas, **settings)
    finally:
        rows.unpersist()
    scores = ridge_accuracies(valid.where(known), array_col, models, label)
    if np.isnan(scores[0]):
        raise ValueError("no rows to score: the valid or test split is empty")
    top = int(np.argmax(scores))
    res = SearchResult("linear_booster", [GridPoint("linear_booster", f"lambda={x:.4g}", s) for x, s in zip(lambdas, scores)], models[top])
    res.points[top].chosen = True
    res.points[top].test_accuracy = ridge_accuracies(test.where(known), array_col, [models[top]], label)[0]
    return res
