"""Profiling (A1-A8): value counts, class balance, column profile, quartiles, bands, histogram, box plot.

All are partial/final hash aggregates. Quartiles are exact order statistics (:mod:`provenance_spark.operators.selection`), or come from a
sketch where that is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.operators.selection import percentiles
from provenance_spark.session import checked_broadcast


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: rows per value (order: count desc, then value - apply at presentation)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, by: str, label: str, digits: int = 6) -> DataFrame:
    """A2: normalised value counts of ``label`` within each ``by`` group."""
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("share", F.round(F.col("n") / total, digits))


def column_profile(df: DataFrame) -> DataFrame:
    """A5: per column its type, non-null and null counts, and the row count - one scan."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    pieces = ", ".join(f"'{c}', '{t}', _nn{i}" for i, (c, t) in enumerate(df.dtypes))
    stacked = one.selectExpr("_rows", f"stack({len(df.columns)}, {pieces}) AS (`column`, dtype, non_null)")
    return stacked.select("column", "dtype", "non_null", (F.col("_rows") - F.col("non_null")).alias("nulls"),
                          F.col("_rows").alias("n_rows"))


def quartiles(df: DataFrame, value: str, by: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """A3: exact 25/50/75 percentiles with linear interpolation (numpy's default).

    With ``accuracy`` they come from a mergeable sketch instead, in one pass: values whose rank is off by at most
    1 / accuracy of the group's rows, without interpolation.
    """
    if accuracy is not None:
        q = F.percentile_approx(F.col(value), [0.25, 0.5, 0.75], accuracy)
        return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("_q"))
                .select(*by, "n", *[F.col("_q")[i].cast("double").alias(c) for i, c in enumerate(("q1", "median", "q3"))]))
    q = percentiles(df, value, by, (0.25, 0.5, 0.75))
    return q.select(*by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))


def length_band(value: Column, q1: Column, q3: Column) -> Column:
    """``< q1`` small, ``q1 <= x <= q3`` medium (both ends inclusive), ``> q3`` large."""
    return F.when(value < q1, "small").when(value <= q3, "medium").otherwise("large")


def length_bands(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """A4: every row labelled with its band against its group's quartiles (one DF, not three)."""
    q = checked_broadcast(quartiles(df, value, by).select(*by, "q1", "q3"))
    return (df.join(q, list(by))
            .withColumn("band", length_band(F.col(value), F.col("q1"), F.col("q3")))
            .drop("q1", "q3"))


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 100, digits: int = 6) -> DataFrame:
    """Equal-width bins over each group's own [min, max]; the last bin is closed; empty bins kept."""
    stats = checked_broadcast(df.groupBy(*by).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx")))
    width = F.col("_mx") - F.col("_mn")
    raw = F.floor(F.try_divide((F.col(value) - F.col("_mn")) * bins, width))
    bin_ = F.when(width > 0, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = (df.join(stats, list(by)).withColumn("bin", bin_)
              .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lo = F.col("_mn") + F.col("bin") * width / bins
    hi = F.col("_mn") + (F.col("bin") + 1) * width / bins
    return (grid.join(counts, [*by, "bin"], "left")
            .select(*by, "bin", F.round(lo, digits).alias("lo"), F.round(hi, digits).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def boxplot_stats(df: DataFrame, value: str, by: Sequence[str], whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the most extreme datum within ``whis`` x IQR, outlier count."""
    q = quartiles(df, value, by).withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_lim = F.col("q1") - whis * F.col("iqr")
    hi_lim = F.col("q3") + whis * F.col("iqr")
    x = F.col(value)
    joined = df.join(checked_broadcast(q.select(*by, "q1", "median", "q3", "iqr")), list(by))
    return joined.groupBy(*by, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(x >= lo_lim, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi_lim, x)).alias("whisker_hi"),
        F.count(F.when((x < lo_lim) | (x > hi_lim), 1)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def boxplot_outliers(df: DataFrame, value: str, by: Sequence[str], whis: float = 1.5) -> DataFrame:
    """The rows beyond ``whis`` x IQR of their group's quartiles, with the ``side`` they lie on."""
    q = checked_broadcast(quartiles(df, value, by).select(*by, "q1", "q3"))
    x, reach = F.col(value), whis * (F.col("q3") - F.col("q1"))
    side = F.when(x < F.col("q1") - reach, "low").when(x > F.col("q3") + reach, "high")
    return df.join(q, list(by)).withColumn("side", side).where(F.col("side").isNotNull()).drop("q1", "q3")
