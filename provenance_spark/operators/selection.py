"""Exact order statistics of many groups and ranks at once, without sorting or a map of values.

Each (group, rank) keeps an interval of values that must hold its answer. A round cuts the intervals into ``BUCKETS`` equal parts and counts the rows
of each; the part with the rank becomes the interval, narrowed to the least and greatest value found in it. Counts combine before they are
shuffled, so a task sends at most ``BUCKETS`` rows a target, however its rows fall on groups. Once an interval holds few rows, or one value, its rows are
ranked. Rounds grow with the logarithm of the values' range (six at most for 64-bit integers), not with the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.session import cut_lineage

BUCKETS = 1024
#: Rows of an interval that are ranked as they are.
FEW = 50_000
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _same(by: Sequence[str], state: DataFrame, rows: DataFrame) -> Column:
    cond = F.lit(True)
    for g in by:
        cond = cond & rows[g].eqNullSafe(state[f"_g_{g}"])
    return cond


def _held(small: DataFrame, limit: int = 100_000) -> DataFrame:
    """A checkpointed table of targets, broadcast if it has at most ``limit`` rows."""
    return F.broadcast(small) if small.count() <= limit else small


def select_ranks(df: DataFrame, value: str, by: Sequence[str], targets: DataFrame, few: int = FEW, buckets: int = BUCKETS,
                 staged: bool = False) -> DataFrame:
    """``targets`` (the columns ``by``, ``t``, and ``rank`` from 0) with ``value`` at that rank of the group's values in rising order.

    Null values don't count, null groups do. Ranks outside a group have no row. NaN stands above all numbers and counts as infinity.
    The two columns are read several times, so they are checkpointed first unless ``df`` is ``staged`` already.
    """
    keys = [f"_g_{g}" for g in by]
    x = F.col(value)
    if dict(df.dtypes)[value] in ("float", "double"):
        x = F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x)
    rows = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    rows = rows if staged else cut_lineage(rows)
    bounds = rows.groupBy(*[F.col(g).alias(f"_g_{g}") for g in by]).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"))
    named = targets.select(*by, "t", F.col("rank").cast("long").alias("rank"))
    state = named.join(bounds, _same(by, bounds, named)).where((F.col("rank") >= 0) & (F.col("rank") < F.col("_n")))
    state = cut_lineage(state.select(*keys, "t", "rank", "_lo", "_hi", "_n", F.lit(0).cast("long").alias("_below")))
    open_ = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
    while not state.where(open_).isEmpty():
        held = _held(state.where(open_))
        inside = rows.join(held, _same(by, held, rows) & F.col("_x").between(F.col("_lo"), F.col("_hi")))
        lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
        # halves keep the width finite; a part is never empty at both ends, so every round leaves fewer rows
        share = F.try_divide(F.col("_x").cast("double") / 2 - lo / 2, hi / 2 - lo / 2)
        part = F.when(F.col("_x") == F.col("_hi"), F.lit(buckets)).when(F.col("_x") == F.col("_lo"), F.lit(-1)).otherwise(
            F.greatest(F.lit(0), F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets).cast("int"), F.lit(buckets - 1))))
        counts = inside.groupBy(*keys, "t", "rank", "_below", part.alias("_b")).agg(
            F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "t").orderBy("_b")) + F.col("_below")
        found = counts.withColumn("_upto", upto).where((F.col("_upto") - F.col("_n") <= F.col("rank")) & (F.col("rank") < F.col("_upto")))
        found = found.withColumn("_below", F.col("_upto") - F.col("_n")).select(*state.columns)
        state = cut_lineage(found.unionByName(state.where(~open_)))
    named = [F.col(f"_g_{g}").alias(g) for g in by]
    one = state.where("_lo = _hi").select(*named, "t", "rank", F.col("_lo").alias(value))
    held = _held(state.where("_lo < _hi"))
    inside = rows.join(held, _same(by, held, rows) & F.col("_x").between(F.col("_lo"), F.col("_hi")))
    place = F.row_number().over(Window.partitionBy(*keys, "t").orderBy("_x"))
    few_ = inside.withColumn("_at", place).where(F.col("_at") == F.col("rank") - F.col("_below") + 1)
    return one.unionByName(few_.select(*named, "t", "rank", F.col("_x").alias(value)))


def percentiles(df: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], few: int = FEW) -> DataFrame:
    """(by, n, q0, q1, ...): rows and exact percentiles of each group, with linear interpolation between neighbours (numpy's default)."""
    rows = cut_lineage(df.select(*by, value))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("_m"))
    at = [F.lit(p) * (F.col("_m") - 1) for p in shares]
    wanted = F.explode(F.array(*[F.struct(F.lit(2 * i + j).alias("t"), F.floor(a + j).cast("long").alias("rank")) for i, a in enumerate(at) for j in (0, 1)]))
    targets = sizes.select(*by, wanted.alias("_w")).select(*by, "_w.t", "_w.rank")
    found = select_ranks(rows, value, by, targets, few, staged=True)
    keys = [F.col(g).alias(f"_g_{g}") for g in by]
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == t, F.col(value))).cast("double").alias(f"_v{t}") for t in range(2 * len(shares))])
    joined = sizes.join(wide, _same(by, wide, sizes), "left")
    out = []
    for i, a in enumerate(at):
        low, part = F.col(f"_v{2 * i}"), a - F.floor(a)
        out.append(F.when(part == 0, low).otherwise(low + (F.col(f"_v{2 * i + 1}") - low) * part).alias(f"q{i}"))
    return joined.select(*by, "n", *out)
