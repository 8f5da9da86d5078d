"""Scores and the best-score gate (A9-A12, S12) as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correct(pred: Column, label: Column) -> Column:
    return (pred == label).cast("int")


def accuracy(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean of ``pred == label`` per group (A12 groups by ``version``)."""
    return df.groupBy(*by).agg(F.round(F.avg(correct(F.col(pred), F.col(label))), digits).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


def mean_of_accuracies(valid_acc: Column, test_acc: Column) -> Column:
    """A10: mean of the validation and test accuracies (not the pooled-row accuracy)."""
    return (valid_acc + test_acc) / 2


def best_score_gate(runs: DataFrame, head: str, run: str, score: str) -> DataFrame:
    """A run is saved iff its score beats every earlier run of the head (start at 0)."""
    w = Window.partitionBy(head).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max(score).over(w), F.lit(0.0))
    return runs.withColumn("best_before", best).withColumn("saved", F.col(score) > F.col("best_before"))
