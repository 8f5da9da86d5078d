"""Classifier heads and predefined-split model selection.

Every head is fitted on Spark: ``LogisticRegression``, ``LinearSVC``, ``RandomForestClassifier``
and ``MultilayerPerceptronClassifier`` aggregate gradients with ``treeAggregate``; the ridge head
sums sufficient statistics (XᵀX, Xᵀy, sums, n) per split in one ``mapInPandas`` pass and solves the
d x d systems on the driver (driver memory holds only d² numbers).

Model selection follows a predefined split: fit each grid point on ``train``, score accuracy on
``valid``, the first best wins ties; the chosen model is scored once on ``test``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators import wide_logistic
from provenance_spark.operators.chunks import chunks, sum_chunks

LABEL = "AI"


@dataclass
class GridPoint:
    head: str
    param: str
    valid_accuracy: float
    test_accuracy: float | None = None
    chosen: bool = False


@dataclass
class SearchResult:
    head: str
    points: list[GridPoint] = field(default_factory=list)
    model: object = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = "head string, param string, valid_accuracy double, test_accuracy double, chosen boolean"
        return spark.createDataFrame([(p.head, p.param, p.valid_accuracy, p.test_accuracy, p.chosen)
                                      for p in self.points], schema)


def as_vectors(df: DataFrame, array_col: str, output_col: str = "features") -> DataFrame:
    """Dense ML vectors from an ``array<float>`` column (JVM-side)."""
    return df.withColumn(output_col, array_to_vector(F.col(array_col)))


def accuracies(models: Sequence, df: DataFrame, label: str = LABEL) -> list[float]:
    """Accuracy of every model, in one pass over ``df``."""
    out = df
    for i, model in enumerate(models):
        m = model.copy()
        m.setPredictionCol(f"_p{i}")
        m.setRawPredictionCol(f"_r{i}")
        if m.hasParam("probabilityCol"):
            m.setProbabilityCol(f"_q{i}")
        out = m.transform(out).drop(f"_r{i}", f"_q{i}")
    row = out.agg(*[F.avg((F.col(f"_p{i}") == F.col(label)).cast("double")) for i in range(len(models))]).first()
    if row[0] is None:
        raise ValueError("no rows to score: the valid or test split is empty")
    return [float(x) for x in row]


def choose(head: str, models: list, labels: Sequence[str], valid: DataFrame, test: DataFrame, label: str = LABEL,
           score: Callable[[Sequence, DataFrame, str], list[float]] = accuracies) -> SearchResult:
    """The first best model by valid accuracy, scored once on test."""
    scores = score(models, valid, label)
    best = int(np.argmax(scores))  # first maximum wins ties
    res = SearchResult(head, [GridPoint(head, labels[i], scores[i]) for i in range(len(models))], models[best])
    res.points[best].chosen = True
    res.points[best].test_accuracy = score([models[best]], test, label)[0]
    return res


#: Grid points that are fitted at the same time; each is a job of its own on the cluster.
FITS_AT_ONCE = 4


def fit_grid(estimator, param_maps: list, train: DataFrame) -> list:
    """A model for each grid point."""
    train = train.persist()
    try:
        models: list = [None] * len(param_maps)
        fits = estimator.fitMultiple(train, param_maps)
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            for i, m in pool.map(lambda _: next(fits), param_maps):
                models[i] = m
    finally:
        train.unpersist()
    return models


def predefined_split_search(head: str, estimator, param_maps: list, labels: Sequence[str],
                            train: DataFrame, valid: DataFrame, test: DataFrame,
                            label: str = LABEL) -> SearchResult:
    """M4: fit every grid point on train (``fitMultiple``), pick the first best by valid accuracy."""
    return choose(head, fit_grid(estimator, param_maps, train), labels, valid, test, label)


def logistic_head(train, valid, test, c_grid=fv.LR_C_GRID, features="features", label=LABEL,
                  penalize_intercept: bool = False, max_iter: int = 5000) -> SearchResult:
    """M1 (and M5 with ``penalize_intercept``): C grid mapped to ``regParam = 1 / (C * n_train)``.

    With ``penalize_intercept`` a constant feature replaces the free intercept (liblinear's rule), and all grid points are fitted together
    (:mod:`provenance_spark.operators.wide_logistic`). A constant gets no weight there, as in Spark's fit, so none is added.
    """
    n = train.count()
    names = [f"C={c:g}" for c in c_grid]
    if penalize_intercept:
        models = wide_logistic.fit(train, [1.0 / (c * max(n, 1)) for c in c_grid], features, label, max_iter)
        return choose("lr", models, names, valid, test, label, lambda m, df, y: wide_logistic.accuracies(m, df, features, y))
    lr = LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=1e-8)
    maps = [{lr.regParam: 1.0 / (c * n)} for c in c_grid]
    return predefined_split_search("lr", lr, maps, names, train, valid, test, label)


def svc_head(train, valid, test, c_grid=fv.SVC_C_GRID, features="features", label=LABEL, max_iter: int = 5000) -> SearchResult:
    """M9: linear SVM over a C grid; the points name the iterations to convergence, and it is an error if ``max_iter`` don't reach it."""
    n = train.count()
    svc = LinearSVC(featuresCol=features, labelCol=label, standardization=False, maxIter=max_iter)
    models = fit_grid(svc, [{svc.regParam: 1.0 / (c * n)} for c in c_grid], train)
    taken = [m.summary().totalIterations for m in models]
    if max(taken) >= max_iter:
        raise RuntimeError(f"no convergence in {max_iter} iterations for C {[c for c, t in zip(c_grid, taken) if t >= max_iter]}")
    return choose("svc", models, [f"C={c:g},iterations={t}" for c, t in zip(c_grid, taken)], valid, test, label)


def forest_head(train, valid, test, n_candidates: int = 5, seed: int = 1, features="features", label=LABEL,
                trees: Sequence[int] = fv.FOREST_TREES, depths: Sequence[int] = fv.FOREST_DEPTHS) -> SearchResult:
    """Random forest, random search over a seeded subset of a (trees x depth) grid.

    Spark grows trees to depth 30 at most, which is where the published grid's deeper settings end.
    """
    grid = [(t, d) for t in trees for d in depths]
    picked = random.Random(seed).sample(grid, min(n_candidates, len(grid)))
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed)
    maps = [{rf.numTrees: t, rf.maxDepth: d} for t, d in picked]
    return predefined_split_search("forest", rf, maps, [f"trees={t},depth={d}" for t, d in picked],
                                   train, valid, test, label)


def dense_head(train, valid, test, hidden: Sequence[int] = (64, 64), iters: Sequence[int] = (50, 100, 150),
               seed: int = 1, features="features", label=LABEL, head: str = "nn") -> SearchResult:
    """M3 / M8: feed-forward network; early stopping becomes growing numbers of iterations scored on
    valid, each going on from the weights of the one before."""
    dim = len(train.select(features).first()[0])
    train = train.persist()
    models, done, weights = [], 0, None
    try:
        for k in iters:
            mlp = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[dim, *hidden, 2],
                                                 seed=seed, blockSize=32, maxIter=k - done)
            if weights is not None:
                mlp.setInitialWeights(weights)
            models.append(mlp.fit(train))
            done, weights = k, models[-1].weights
    finally:
        train.unpersist()
    return choose(head, models, [f"layers={list(hidden)},iters={k}" for k in iters], valid, test, label)


# ---------------------------------------------------------------- M2 ridge via sufficient statistics


@dataclass
class RidgeModel:
    """Decision ``d = x·w + b``; class 1 iff ``d > 0``; pseudo-probability ``sigmoid(k·d)``."""
    coef: np.ndarray
    intercept: float
    alpha: float

    def decision(self, features: F.Column) -> F.Column:
        w = F.lit([float(x) for x in self.coef])
        dot = F.aggregate(F.zip_with(features, w, lambda a, b: a.cast("double") * b), F.lit(0.0),
                          lambda acc, x: acc + x)
        return dot + F.lit(float(self.intercept))


def ridge_statistics(df: DataFrame, array_col: str, label: str = LABEL, split_col: str = "split") -> dict:
    """One pass: per split n, Σy, Σx, Xᵀy, XᵀX with targets ±1; a vector per partition, summed on Spark in chunks."""
    def partials(batches):
        acc: dict[str, list] = {}
        for pdf in batches:
            for split, g in pdf.groupby(split_col):
                x = np.stack(g[array_col].to_numpy()).astype(np.float64)
                y = np.where(g[label].to_numpy() == 1, 1.0, -1.0)
                vec = np.concatenate([[len(y), y.sum()], x.sum(0), x.T @ y, (x.T @ x).ravel()])
                acc[split] = vec if split not in acc else acc[split] + vec
        rows = [(split, c, piece) for split, vec in acc.items() for c, piece in chunks(vec)]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "chunk", "v"])

    parts = df.select(split_col, array_col, label).mapInPandas(partials, "key string, chunk long, v array<double>")
    summed = sorted(sum_chunks(parts).collect(), key=lambda r: r["chunk"])  # d² / CHUNK rows a split
    return {s: np.concatenate([r["v"] for r in summed if r["key"] == s]) for s in {r["key"] for r in summed}}


def _unpack(vec: np.ndarray):
    # layout: n, sy, sx (d), xty (d), xtx (d*d)
    d = int((-2 + np.sqrt(4 + 4 * (len(vec) - 2))) / 2)
    n, sy = vec[0], vec[1]
    sx, xty = vec[2:2 + d], vec[2 + d:2 + 2 * d]
    xtx = vec[2 + 2 * d:].reshape(d, d)
    return n, sy, sx, xty, xtx


def solve_ridge(vec: np.ndarray, alpha: float) -> RidgeModel:
    """Centered closed form: (Sxx + αI) w = Sxy, b = ȳ - μ·w (the intercept is not penalised)."""
    n, sy, sx, xty, xtx = _unpack(vec)
    mu, ybar = sx / n, sy / n
    sxx = xtx - n * np.outer(mu, mu)
    sxy = xty - n * mu * ybar
    w = np.linalg.solve(sxx + alpha * np.eye(len(mu)), sxy)
    return RidgeModel(w, float(ybar - mu @ w), alpha)


def ridge_accuracies(df: DataFrame, array_col: str, models: Sequence[RidgeModel], label: str = LABEL) -> list[float]:
    """Accuracy of several ridge models in one pass (numpy per Arrow batch, partial sums on Spark)."""
    W = np.stack([m.coef for m in models])
    b = np.array([m.intercept for m in models])

    def score(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[array_col].to_numpy()).astype(np.float64)
            pred = ((x @ W.T + b) > 0).astype(int)
            ok = (pred == pdf[label].to_numpy()[:, None]).sum(0)
            yield pd.DataFrame({"m": np.arange(len(models)), "ok": ok, "n": len(pdf)})

    rows = (df.select(array_col, label).mapInPandas(score, "m long, ok long, n long")
            .groupBy("m").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect())
    acc = {r["m"]: r["ok"] / r["n"] for r in rows}
    return [acc.get(i, float("nan")) for i in range(len(models))]


def ridge_head(df: DataFrame, array_col: str, alphas=fv.RIDGE_ALPHA_GRID, label: str = LABEL) -> SearchResult:
    """M2: alpha chosen on valid; the final model is refit on train + valid (statistics added)."""
    stats = ridge_statistics(df.where(F.col("split").isin("train", "valid")), array_col, label)
    models = [solve_ridge(stats["train"], a) for a in alphas]
    valid = df.where(F.col("split") == "valid")
    scores = ridge_accuracies(valid, array_col, models, label)
    best = int(np.nanargmax(scores))
    final = solve_ridge(stats["train"] + stats["valid"], alphas[best])
    test_acc = ridge_accuracies(df.where(F.col("split") == "test"), array_col, [final], label)[0]
    res = SearchResult("ridge", [GridPoint("ridge", f"alpha={a:g}", s) for a, s in zip(alphas, scores)], final)
    res.points[best].chosen = True
    res.points[best].test_accuracy = test_acc
    return res


HEADS = ("lr", "ridge", "nn")


def check_head(name: str) -> str:
    """Only known heads are accepted."""
    if name not in HEADS:
        raise ValueError(f"model_head must be one of {HEADS}, got {name!r}")
    return name
