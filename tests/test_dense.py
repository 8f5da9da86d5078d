"""Dense head by mini-batch Adam (M3, M8): gradient, a plain loop, any partitioning, patience, storage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenance_spark.operators import dense
from provenance_spark.operators.detector import DetectorModel


def table(spark, n=300, d=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no linear model can tell these apart
    return spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "features array<double>, AI int")


def test_gradient_is_the_derivative_of_the_loss():
    rng = np.random.default_rng(1)
    layers = (4, 5, 3, 1)
    theta = dense.initial_weights(layers, 3) + 0.1 * rng.normal(size=dense.n_weights(layers))
    x, y = rng.normal(size=(7, 4)), (rng.random(7) < 0.5).astype(float)
    masks = [(rng.random((7, n)) >= 0.3) / 0.7 for n in layers[1:-1]]
    for used in ([], masks):
        _, got = dense.gradient(x, y, theta, layers, used)
        for k in range(len(theta)):
            step = np.zeros_like(theta)
            step[k] = 1e-6
            slope = (dense.gradient(x, y, theta + step, layers, used)[0] - dense.gradient(x, y, theta - step, layers, used)[0]) / 2e-6
            assert got[k] == pytest.approx(slope, abs=1e-7)


def test_one_replica_equals_adam_written_plainly(spark):
    df = table(spark, 100)
    got = dense.fit(df, df, (5,), dropout=0.0, epochs=3, patience=9, seed=4, batch=16)
    rows = sorted(dense.replicas(dense._rows(df, "features", "AI"))[0].collect(), key=lambda r: r["_pos"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    w = dense.initial_weights((6, 5, 1), 4)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    accuracy, kept = [], []
    for epoch in range(3):
        order = np.random.default_rng([4, epoch, 0]).permutation(100)
        for at in range(0, 100, 16):
            g = dense.gradient(x[order[at:at + 16]], y[order[at:at + 16]], w, (6, 5, 1))[1]
            rate = 1e-3 * 0.9 ** (t / 6)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            # Keras' form: the correction of both moments goes into the step
            w = w - rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m / (np.sqrt(v) + 1e-7)
        accuracy.append(float(((dense.probabilities(x, w, (6, 5, 1)) > 0.5) == y).mean()))
        kept.append(w)
    assert got.history == pytest.approx(accuracy)
    assert np.allclose(got.theta, kept[int(np.argmax(accuracy))], atol=1e-9)


def test_partitions_and_tasks_do_not_matter(spark):
    df = table(spark)
    settings = dict(epochs=2, replica_rows=80, seed=3)  # four replicas, with dropout
    assert dense.replicas(dense._rows(df, "features", "AI"), 80)[1] == 4
    a, b = (dense.fit(df.repartition(k), df, (5,), **settings) for k in (1, 5))
    assert a.history == b.history and np.allclose(a.theta, b.theta, atol=1e-9)
    one = dense.fit(df, df, (5,), epochs=2, seed=3)
    assert not np.allclose(one.theta, a.theta)  # replicas are averaged, which is another result


def test_replicas_are_even_although_rows_repeat(spark):
    df = table(spark, 60).unionByName(spark.createDataFrame([([0.0] * 6, 1)] * 40, "features array<double>, AI int"))
    dealt, r = dense.replicas(dense._rows(df, "features", "AI"), 10)
    assert r == 10 and {x["count"] for x in dealt.groupBy("_replica").count().collect()} == {10}


def test_patience_keeps_the_best_epoch_and_learns(spark):
    df = table(spark, 400)
    valid = table(spark, 200, seed=8)
    res = dense.adam_head(df, valid, valid, hidden=(16, 16), rate=0.02, decay=1.0, dropout=0.0, patience=3, epochs=30, seed=1)
    h = res.model.history
    best = h.index(max(h))
    assert max(h) > 0.85 and (len(h) == 30 or len(h) - 1 - best == 3)
    assert res.points[0].valid_accuracy == max(h) == pytest.approx(res.points[0].test_accuracy)
    assert f"epochs={len(h)},best={best + 1}" in res.points[0].param


def test_nulls_and_empty_splits(spark):
    df = table(spark, 50)
    odd = df.unionByName(spark.createDataFrame([(None, 1), ([1.0] * 6, None)], df.schema))
    a, b = (dense.fit(d, df, (3,), epochs=1) for d in (df, odd))
    assert np.allclose(a.theta, b.theta)
    scored = a.transform(odd).where("features is null").first()
    assert scored["probability"] is None and scored["prediction"] is None
    with pytest.raises(ValueError, match="no rows to train"):
        dense.fit(df.limit(0), df, (3,))
    with pytest.raises(ValueError, match="no rows to score"):
        dense.fit(df, df.limit(0), (3,))


def test_network_is_stored_and_scores_texts(spark):
    from provenance_spark.operators.word_vectors import fit_word_vectors
    from provenance_spark.session import workspace_path
    from provenance_spark.sources.registry import ModelRegistry
    df = table(spark, 50)
    model = dense.fit(df, df, (3,), epochs=2)
    reg = ModelRegistry(spark, workspace_path(spark, "registry"))
    assert reg.record("nn", "c", 1, 0.9, model)
    back = reg.load("nn", "c", 1)
    assert back.layers == model.layers and np.array_equal(back.theta, model.theta) and back.history == model.history
    words = fit_word_vectors(spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],)], "t array<string>"), "t", 6)
    out = DetectorModel(words, "nn", back).transform(spark.createDataFrame([("a b",), ("",)], "text string")).collect()
    assert all(0 <= r["Probability"] <= 1 and r["Prediction"] for r in out) and len(out) == 2


def test_partitions_hold_as_many_replicas_each(spark):
    df = table(spark, 240)
    blocks = dense.held(*dense.replicas(dense._rows(df, "features", "AI"), 40))
    assert blocks.mapPartitions(lambda part: [len(list(part))]).collect() == [1] * 6
