"""Exact selection against numpy: many groups and ranks, rounds, ties, nulls, infinities."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenance_spark.operators import profile, selection


def table(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"g string, x {kind}")


@pytest.mark.parametrize("few", [1, 20, 10 ** 6])
def test_ranks_of_many_groups(spark, few):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(-50, 50, 900), "b": rng.integers(-2 ** 62, 2 ** 62, 700), "c": np.array([5] * 400), "d": np.array([3]), None: rng.integers(0, 9, 100)}
    rows = [(g, int(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    ranks = [(g, t, r) for g, vs in groups.items() for t, r in enumerate((0, len(vs) // 3, len(vs) - 1, len(vs)))]
    targets = spark.createDataFrame(ranks, "g string, t int, rank long")
    got = {(r["g"], r["t"]): r["x"] for r in selection.select_ranks(table(spark, rows).repartition(5), "x", ["g"], targets, few, 8).collect()}
    assert got == {(g, t): int(np.sort(groups[g])[r]) for g, t, r in ranks if r < len(groups[g])}


def test_outliers_and_infinities(spark):
    values = [1e300, -1e300, float("inf"), float("-inf"), float("nan")] + [i / 7 for i in range(300)]
    targets = spark.createDataFrame([(t, r) for t, r in enumerate((0, 1, 2, 150, 301, 302, 304))], "t int, rank long")
    got = {r["t"]: r["x"] for r in selection.select_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x", [], targets, 10, 16).collect()}
    order = sorted(float("inf") if v != v else v for v in values)
    assert got == {t: order[r] for t, r in enumerate((0, 1, 2, 150, 301, 302, 304))}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {g: rng.integers(0, 1000, n) for g, n in (("a", 1), ("b", 2), ("c", 57), ("d", 400))}
    df = table(spark, [(g, int(v)) for g, vs in groups.items() for v in vs] + [("d", None), ("z", None)])
    for few in (3, 1000):
        got = {r["g"]: r for r in selection.percentiles(df, "x", ["g"], (0.25, 0.5, 0.75), few).collect()}
        for g, vs in groups.items():
            assert [got[g][f"q{i}"] for i in range(3)] == pytest.approx(list(np.percentile(vs, [25, 50, 75])))
        assert (got["d"]["n"], got["z"]["n"], got["z"]["q1"]) == (401, 1, None)
    assert selection.percentiles(df.limit(0), "x", ["g"], (0.5,)).count() == 0


def test_sketch_is_near(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.col("id").alias("x"))
    r = profile.quartiles(df, "x", ["g"], accuracy=1000).first()
    assert abs(r["q1"] - 5000) <= 40 and abs(r["median"] - 10_000) <= 40 and abs(r["q3"] - 15_000) <= 40 and r["n"] == 20_000
