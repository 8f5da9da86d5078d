"""M5: all points of a grid in one pass give the weights of Spark's own fit, in few jobs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from provenance_spark.operators import wide_logistic
from provenance_spark.operators.heads import logistic_head

WIDTH, GRID = 400, (8.0, 16.0, 32.0)


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, WIDTH + 1)
    rows = []
    for i in range(900):
        idx = np.sort(rng.choice(WIDTH, 0 if i == 7 else int(rng.integers(3, 30)), False, share / share.sum()))
        val = rng.random(len(idx)) + 0.1
        val /= np.sqrt(val @ val) or 1
        rows.append((i, ("train", "valid", "test")[i % 3], int(val @ np.sin(idx) + rng.normal(scale=0.3) > 0), Vectors.sparse(WIDTH, idx, val)))
    df = spark.createDataFrame(rows, ["id", "split", "AI", "features"]).repartition(5).localCheckpoint()
    return [df.where(F.col("split") == s) for s in ("train", "valid", "test")]


def _jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_grid_is_fitted_in_shared_passes_with_the_weights_of_sparks_fit(spark, parts):
    train, valid, _ = parts
    before = _jobs(spark)
    got = logistic_head(*parts, c_grid=GRID, penalize_intercept=True)
    jobs = _jobs(spark) - before
    n = train.count()
    lr = LogisticRegression(labelCol="AI", standardization=False, fitIntercept=False, maxIter=5000, tol=1e-12)
    models = wide_logistic.fit(train, [1 / (c * n) for c in GRID], "features", "AI", 5000)
    for c, point, mine in zip(GRID, got.points, models):
        theirs = lr.copy({lr.regParam: 1 / (c * n)}).fit(train)
        w = theirs.coefficients.toArray()
        assert np.linalg.norm(mine.coef - w) < 1e-3 * np.linalg.norm(w)
        assert point.valid_accuracy == pytest.approx(theirs.transform(valid).agg(F.avg((F.col("prediction") == F.col("AI")).cast("double"))).first()[0])
    assert jobs <= max(m.passes for m in models) + 8
    assert [p.chosen for p in got.points].count(True) == 1


def test_blocks_of_few_numbers_and_dense_vectors_give_the_same_weights(spark, parts, monkeypatch):
    dense = F.udf(lambda v: Vectors.dense(v.toArray()), parts[0].schema["features"].dataType)
    train = parts[0].withColumn("features", dense("features"))
    want = wide_logistic.fit(parts[0], [0.01], "features", "AI", 500)[0].coef
    monkeypatch.setattr(wide_logistic, "HELD", 64)
    assert np.allclose(wide_logistic.fit(train, [0.01], "features", "AI", 500)[0].coef, want, atol=1e-3)


def test_constant_features_get_no_weight_and_bad_rows_are_errors(spark, parts):
    train = parts[0].select("AI", F.udf(lambda v: Vectors.dense([1.0, v[1]]), parts[0].schema["features"].dataType)("features").alias("features"))
    assert wide_logistic.fit(train, [0.01], "features", "AI", 500)[0].coef[0] == 0
    with pytest.raises(ValueError, match="1 rows have no features"):
        wide_logistic.shape(train.withColumn("AI", F.when(F.lit(True), F.lit(2))).limit(1), "features", "AI")
    with pytest.raises(ValueError, match="split is empty"):
        logistic_head(parts[0], parts[1].limit(0), parts[2], c_grid=(1.0,), penalize_intercept=True)
