"""Linear booster (M11): closed-form and zero-gradient optima, blocks, grid, awkward rows."""

from __future__ import annotations

import numpy as np
import pytest

from provenance_spark.operators import booster

SCHEMA = "x array<double>, y double"


def rows(n=200, d=7, seed=1, squared=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 0.4 * rng.normal(size=(n, 1))  # features that depend on each other
    z = x @ rng.normal(size=d) / 3 + 0.4
    y = z + rng.normal(size=n) if squared else (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("block", [3, 100])
def test_squared_loss_reaches_the_closed_form(spark, block):
    x, y = rows(squared=True)
    lambdas = (0.1, 0.5, 1.4)
    models = booster.fit(table(spark, x, y), lambdas, loss="squared", block=block, tol=1e-6)
    xc, yc = x - x.mean(0), y - y.mean()
    for lam, m in zip(lambdas, models):
        want = np.linalg.solve(xc.T @ xc / len(y) + lam * np.eye(x.shape[1]), xc.T @ yc / len(y))
        assert np.allclose(m.coef, want, atol=1e-5)
        assert m.intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-5)


@pytest.mark.parametrize("block", [3, 100])
def test_logistic_gradient_is_zero(spark, block):
    x, y = rows()
    lambdas = (0.1, 1.0)
    for lam, m in zip(lambdas, booster.fit(table(spark, x, y), lambdas, block=block, tol=1e-6)):
        r = 1 / (1 + np.exp(-(x @ m.coef + m.intercept))) - y
        assert np.abs(x.T @ r / len(y) + lam * m.coef).max() < 1e-5 and abs(r.mean()) < 1e-5


def test_moments_equal_numpy(spark):
    x, y = rows(50, 5)
    w = np.random.default_rng(3).normal(size=(2, 6))
    groups = booster.blocks_of(5, 2)
    assert [list(g) for g in groups] == [[0, 1, 5], [2, 3], [4]]
    one = np.column_stack([x, np.ones(50)])
    for k, (value, grad, second) in enumerate(booster.moments(table(spark, x, y), w, groups, "logistic")):
        p = 1 / (1 + np.exp(-one @ w[k]))
        assert value == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        assert np.allclose(grad, one.T @ (p - y) / 50)
        whole = one.T @ (one * (p * (1 - p))[:, None]) / 50
        assert all(np.allclose(h, whole[np.ix_(b, b)]) for b, h in zip(groups, second))


def test_separable_classes_flat_features_and_errors(spark):
    x, _ = rows(60, 3)
    x[:, 1] = 0.0  # a feature that is always zero
    y = (x[:, 0] > 0).astype(float)
    free, held = booster.fit(table(spark, x, y), (0.0, 0.2))
    assert free.coef[1] == held.coef[1] == 0 and ((x @ free.coef + free.intercept > 0) == y).all()
    with pytest.raises(ValueError, match="no rows to train"):
        booster.fit(spark.createDataFrame([], SCHEMA))
    with pytest.raises(RuntimeError, match="no rest"):
        booster.fit(table(spark, x, y), (0.2,), rounds=1)


def test_head_chooses_on_valid(spark):
    x, y = rows(150, 4)
    df = table(spark, x, y).selectExpr("x AS h", "CAST(y AS INT) AS AI")
    odd = df.unionByName(spark.createDataFrame([(None, 1), ([0.0] * 4, None)], df.schema))
    res = booster.booster_head(odd, odd, df, "h", lambdas=(0.1, 1.0))
    scores = [p.valid_accuracy for p in res.points]
    best = [p for p in res.points if p.chosen]
    assert len(best) == 1 and best[0].valid_accuracy == max(scores) == best[0].test_accuracy
    with pytest.raises(ValueError, match="no rows to score"):
        booster.booster_head(df, df.limit(0), df, "h", lambdas=(0.1,))
