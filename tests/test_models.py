"""Training and scoring invariants: ridge vs closed form, G3, X1, M6, head dispatch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

import __spark_entry__ as entry
from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators import heads, sgd
from provenance_spark.operators.detector import DetectorModel, class_label, sigmoid
from provenance_spark.sources.tables import read_table


@pytest.fixture(scope="module")
def emb(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    split = F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "valid").otherwise("test")
    return e.select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("AI"),
                    split.alias("split")).cache()


def test_ridge_matches_numpy_closed_form(emb):
    stats = heads.ridge_statistics(emb, "embedding")
    rows = [r for r in emb.collect() if r["split"] == "train"]
    X = np.array([r["embedding"] for r in rows], dtype=np.float64)
    y = np.where(np.array([r["AI"] for r in rows]) == 1, 1.0, -1.0)
    alpha = 0.04
    m = heads.solve_ridge(stats["train"], alpha)
    mu, ybar = X.mean(0), y.mean()
    Xc = X - mu
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ (y - ybar))
    assert np.allclose(m.coef, w, atol=1e-8)
    assert m.intercept == pytest.approx(ybar - mu @ w, abs=1e-8)


def test_ridge_statistics_add_up_across_partitions(emb):
    a = heads.ridge_statistics(emb.repartition(1), "embedding")
    b = heads.ridge_statistics(emb.repartition(7), "embedding")
    for s in a:
        assert np.allclose(a[s], b[s])


def test_ridge_probability_classes_agree_for_both_k(spark):
    rows = entry.queries()["ridge_probability"](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        assert (r["proba"] > 0.5) == (r["proba_k1"] > 0.5) == (r["decision"] > 0)


def test_sigmoid_is_finite_at_extremes(spark):
    df = spark.createDataFrame([(1e6,), (-1e6,), (0.0,)], "d double")
    got = [r[0] for r in df.select(sigmoid(F.col("d"), 2.0)).collect()]
    assert got == [1.0, 0.0, 0.5]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,)], "p double")
    got = [r[0] for r in df.select(class_label(F.col("p"))).collect()]
    assert got == [fv.HUMAN_CLASS, fv.AI_CLASS]


@pytest.mark.parametrize("loss", fv.SGD_LOSSES)
def test_margin_loss_column_equals_numpy(spark, loss):
    ms = [-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.5]
    df = spark.createDataFrame([(m,) for m in ms], "m double")
    got = [r[0] for r in df.select(sgd.margin_loss(loss, F.col("m"))).collect()]
    assert np.allclose(got, sgd.loss_value(loss, np.array(ms)))


def test_unknown_head_is_rejected():
    with pytest.raises(ValueError):
        heads.check_head("svm")
    with pytest.raises(ValueError):
        DetectorModel(encoder=None, head="forest", model=None)


def test_mixed_sgd_learns_separable_data(spark):
    rng = np.random.default_rng(0)
    n, d = 400, 20
    X = rng.normal(size=(n, d))
    X /= np.linalg.norm(X, axis=1, keepdims=True)  # unit rows, as the hashed features are fed
    w_true = rng.normal(size=d)
    y = (X @ w_true > 0).astype(int)
    rows = [(list(range(d)), [float(v) for v in X[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "idx array<int>, val array<double>, y int").repartition(4)
    W, b, _ = sgd.mixed_sgd(df, d, fv.SGD_LOSSES, compact=True)
    majority = max(y.mean(), 1 - y.mean())
    for k, loss in enumerate(fv.SGD_LOSSES):
        acc = (((X @ W[k] + b[k]) > 0).astype(int) == y).mean()
        assert acc > max(0.8, majority), (loss, acc)
    W1, b1, _ = sgd.mixed_sgd(df.coalesce(1), d, fv.SGD_LOSSES)  # one partition = plain SGD
    assert W1.shape == W.shape


def test_blocks_equal_single_rows():
    # Few rows and small steps: the steep losses of long passes double rounding errors with every row, in any order of summation.
    import pandas as pd
    rng = np.random.default_rng(5)
    losses, dim = list(fv.SGD_LOSSES), 300
    rows = pd.DataFrame([(rng.choice(dim, n := int(rng.integers(0, 12)), replace=False), 0.3 * rng.normal(size=n), int(rng.random() < 0.5)) for _ in range(60)], columns=["idx", "val", "y"])
    for compact in (False, True):
        want, bias = np.zeros((5, dim)), np.zeros(5)
        t0, t = sgd._initial_t(losses), 0
        for idx, val, y in zip(rows["idx"], rows["val"], rows["y"], strict=True):  # plainly, row after row
            val = val / np.linalg.norm(val) if compact and len(val) else val
            g = [sgd.dloss(loss, float(w[idx] @ val + c), 1.0 if y else -1.0) / (sgd.ALPHA * (u + t)) for loss, w, c, u in zip(losses, want, bias, t0, strict=True)]
            for k in range(5):
                want[k, idx] -= g[k] * val
                bias[k] -= g[k]
            t += 1
        for block in (1, 7, 32, 1000):
            W, b = np.zeros((5, dim)), np.zeros(5)
            assert sgd.sgd_epoch(rows, W, b, losses, 0, compact, block) == 60
            assert np.allclose(W, want, rtol=1e-6, atol=1e-6) and np.allclose(b, bias, rtol=1e-6, atol=1e-6)


def test_two_batches_equal_one_continued_pass(spark):
    rng = np.random.default_rng(3)
    rows = [([0, 1, 2], [float(x) for x in rng.normal(size=3)], int(rng.random() < 0.5)) for _ in range(200)]
    schema = "idx array<int>, val array<double>, y int"
    whole = sgd.mixed_sgd(spark.createDataFrame(rows, schema).coalesce(1), 3)
    W, b, step = sgd.mixed_sgd(spark.createDataFrame(rows[:100], schema).coalesce(1), 3)
    assert step == 100
    W, b, step = sgd.mixed_sgd(spark.createDataFrame(rows[100:], schema).coalesce(1), 3, init=(W, b), step=step)
    assert step == whole[2] == 200 and np.allclose(W, whole[0]) and np.allclose(b, whole[1])


def test_logistic_gradient_is_zero_at_the_solution(emb):
    from provenance_spark.operators.heads import as_vectors, logistic_head
    v = as_vectors(emb, "embedding").cache()
    parts = [v.where(F.col("split") == s) for s in ("train", "valid", "test")]
    m = logistic_head(*parts, c_grid=(1.0,)).model
    rows = parts[0].collect()
    X, y = np.array([r["embedding"] for r in rows], float), np.array([r["AI"] for r in rows], float)
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(X @ w + b)))
    grad = X.T @ (p - y) / len(y) + w / len(y)  # C = 1
    assert np.abs(grad).max() < 1e-4 and abs((p - y).mean()) < 1e-4


def test_models_of_every_head_are_saved_and_loaded(spark, emb):
    from provenance_spark.operators.heads import as_vectors, dense_head, logistic_head, ridge_head
    from provenance_spark.session import workspace_path
    from provenance_spark.sources.registry import ModelRegistry
    v = as_vectors(emb, "embedding").cache()
    parts = [v.where(F.col("split") == s) for s in ("train", "valid", "test")]
    reg = ModelRegistry(spark, workspace_path(spark, "registry"))
    found = {"lr": logistic_head(*parts, c_grid=(1.0,)), "nn": dense_head(*parts, hidden=(4,), iters=(5,)), "ridge": ridge_head(v, "embedding", alphas=(0.1,))}
    for head, res in found.items():
        assert not reg.has_model(head, "c", 1) and reg.record(head, "c", 1, 0.9, res.model) and reg.has_model(head, "c", 1)
        back = reg.load(head, "c", 1)
        if head == "ridge":
            assert np.array_equal(back.coef, res.model.coef) and back.intercept == res.model.intercept
        else:
            a, b = ([r["probability"] for r in m.transform(parts[2]).orderBy("vec_id").collect()] for m in (res.model, back))
            assert a == b


def test_empty_split_is_a_clear_error(emb):
    from provenance_spark.operators.heads import as_vectors, logistic_head
    v = as_vectors(emb, "embedding")
    with pytest.raises(ValueError, match="no rows to score"):
        logistic_head(v, v.limit(0), v, c_grid=(1.0,))


@pytest.mark.parametrize("loss", fv.SGD_LOSSES)
def test_margin_slope_is_the_derivative_of_the_loss(spark, loss):
    ms = [-3.0, -1.5, -0.5, 0.3, 0.9, 1.7]
    df = spark.createDataFrame([(m,) for m in ms], "m double")
    got = [r[0] for r in df.select(sgd.margin_slope(loss, F.col("m"))).collect()]
    h = 1e-6
    want = [(sgd.loss_value(loss, np.array([m + h])) - sgd.loss_value(loss, np.array([m - h])))[0] / (2 * h) for m in ms]
    assert np.allclose(got, want, atol=1e-5)
    assert np.allclose(got, [sgd.dloss(loss, m, 1.0) for m in ms])


def test_sequence_predict_equals_the_fitted_model(spark):
    """A logistic model over id counts: its class is the larger score, ties and empty sequences included."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    from provenance_spark.operators.detector import sequence_predict
    rng = np.random.default_rng(5)
    rows = [(n, [int(i) for i in rng.integers(1, 6, size=n % 7)] + [0] * (7 - n % 7), int(rng.random() < 0.5)) for n in range(80)]
    df = spark.createDataFrame(rows, "id int, padded array<int>, AI int")
    ids = df.withColumn("ids", F.transform(F.filter("padded", lambda x: x != 0), lambda x: x.cast("string")))
    cv = CountVectorizerModel.from_vocabulary([str(i) for i in range(1, 6)], inputCol="ids", outputCol="features")
    model = LogisticRegression(labelCol="AI", regParam=0.01).fit(cv.transform(ids))
    want = {r["id"]: int(r["prediction"]) for r in model.transform(cv.transform(ids)).collect()}
    weights = [[0.0] * 6, [0.0, *model.coefficients.toArray()]]
    got = {r["id"]: r["class"] for r in sequence_predict(df, weights, [0.0, model.intercept]).collect()}
    assert got == want
    tie = sequence_predict(df.where("id = 0"), [[0.0] * 6, [0.0] * 6], [0.5, 0.5]).first()
    assert tie["class"] == 0 and tie["scores"] == [0.5, 0.5]


def test_chunked_sums_equal_plain_ones(spark):
    from provenance_spark.operators.chunks import CHUNK, chunks, sum_chunks
    vecs = [np.arange(CHUNK + 10, dtype=float) * k for k in (1, 2, 3)]
    rows = [("a", c, [float(x) for x in v]) for vec in vecs for c, v in chunks(vec)] + [("b", 0, [1.0])]
    got = {(r["key"], r["chunk"]): r["v"] for r in sum_chunks(spark.createDataFrame(rows, "key string, chunk long, v array<double>")).collect()}
    assert np.allclose(np.concatenate([got["a", 0], got["a", 1]]), sum(vecs)) and got["b", 0] == [1.0] and len(got) == 3
    assert sum_chunks(spark.createDataFrame([], "key string, chunk long, v array<double>")).isEmpty()


def test_vectors_longer_than_a_chunk_train_alike_on_any_partitioning(spark):
    rng = np.random.default_rng(9)
    dim = 10_000
    rows = [(sorted(int(i) for i in rng.choice(dim, 5, replace=False)), [float(x) for x in rng.normal(size=5)], int(rng.random() < 0.5)) for _ in range(60)]
    df = spark.createDataFrame(rows, "idx array<int>, val array<double>, y int")
    W, b, step = sgd.mixed_sgd(df.coalesce(1), dim)
    want, bias, losses = np.zeros((5, dim)), np.zeros(5), list(fv.SGD_LOSSES)
    sgd.sgd_epoch(df.toPandas(), want, bias, losses, 0)
    assert step == 60 and np.allclose(W, want) and np.allclose(b, bias) and W.any()
    ev = {(r["split"], r["loss"]): r["accuracy"] for r in sgd.evaluate(df.withColumn("split", F.lit("train")), W, b).collect()}
    X = np.zeros((60, dim))
    for n, (i, v, _) in enumerate(rows):
        X[n, i] = v
    y = np.array([r[2] for r in rows])
    for k, loss in enumerate(losses):
        assert ev["train", loss] == pytest.approx((((X @ W[k] + b[k]) > 0).astype(int) == y).mean())
