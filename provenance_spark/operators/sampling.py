"""Seeded, exact, stratified sampling without replacement.

Semantics: within each stratum, rows are ordered by ``md5(seed || ':' || id)`` (tie-break ``id``)
and the first ``n`` are kept - exact counts, deterministic in (seed, id), independent of the
partition count. The SQL oracle is a ``row_number()`` over that order.

Execution at scale never ranks a whole stratum (a stratum may hold a third of all rows):

1. histogram: count rows per (stratum, first ``prefix_len`` hex digits of the hash) - a partial
   aggregate bounded by strata x 16^prefix_len rows;
2. a running sum over each stratum's histogram (at most 16^prefix_len rows per stratum) finds the
   boundary bucket where the quota is reached and how many rows are still needed from it;
3. the full table is joined to that one-row-per-stratum table (broadcast, bounded by the number of
   strata); rows in earlier buckets are kept by a plain filter and only the rows of the boundary
   bucket (about 16^-prefix_len of the stratum) are ranked with a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.functions import fixed_values as fv
from provenance_spark.session import checked_broadcast

DEFAULT_PREFIX = 4


def seeded_hash(row_id: Column, seed: int | str) -> Column:
    """md5 hex of ``'{seed}:{id}'``: the shuffle order of a seeded sample (L1)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def balanced_quotas(counts: DataFrame, split_col: str = "split", version_col: str = "version",
                    total: Mapping[str, int] | None = None) -> DataFrame:
    """Per (split, version) quota with the 4:1:1:2 mix (human, gpt2, gpt3, gpt3.5).

    ``total`` fixes the sample size of a split (a multiple of 8); splits absent from ``total`` get
    the largest size their strata support: 8 x min(count // part), and one part at least, so that a
    stratum that is missing or too short raises in :func:`stratified_sample` and no split vanishes.
    ``counts`` has columns (split, version, n).
    """
    parts = F.create_map(*[x for v, p in fv.VERSION_PARTS for x in (F.lit(v), F.lit(p))])
    grid = counts.select(split_col).distinct().withColumn(version_col, F.explode(F.array(*[F.lit(v) for v, _ in fv.VERSION_PARTS])))
    every = grid.join(counts, [split_col, version_col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    with_part = every.withColumn("_part", F.element_at(parts, F.col(version_col)))
    unit_auto = with_part.groupBy(split_col).agg(
        F.greatest(F.min(F.floor(F.col("n") / F.col("_part"))), F.lit(1)).alias("_unit_auto"))
    unit = F.col("_unit_auto")
    if total:
        fixed = F.create_map(*[x for s, t in total.items() for x in (F.lit(s), F.lit(t // fv.PARTS_TOTAL))])
        unit = F.coalesce(F.element_at(fixed, F.col(split_col)), unit)
    return (with_part.join(unit_auto, split_col)
            .select(split_col, version_col, "n", (unit * F.col("_part")).cast("long").alias("_quota")))


def stratified_sample(df: DataFrame, strata: Sequence[str], quotas: DataFrame, id_col: str = "id",
                      seed: int = 1, prefix_len: int = DEFAULT_PREFIX, check_short: bool = True) -> DataFrame:
    """Exactly ``_quota`` rows per stratum (``quotas`` has the strata columns and ``_quota``).

    With ``check_short`` a stratum with fewer rows than its quota raises at execution (the way
    pandas ``sample(n)`` refuses), instead of silently returning fewer rows.
    """
    h = seeded_hash(F.col(id_col), seed)
    keyed = df.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, prefix_len))
    hist = keyed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    run = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(run))
    totals = hist.groupBy(*strata).agg(F.max("_cum").alias("_total"))
    q = checked_broadcast(quotas.select(*strata, "_quota"))
    # boundary bucket: first bucket whose running count reaches the quota
    bound = (hist.join(q, list(strata))
             .where((F.col("_cum") >= F.col("_quota")) & (F.col("_cum") - F.col("_cnt") < F.col("_quota")))
             .select(*strata, F.col("_bucket").alias("_bbucket"),
                     (F.col("_quota") - (F.col("_cum") - F.col("_cnt"))).alias("_need")))
    plan = totals.join(q, list(strata), "right").join(bound, list(strata), "left")
    if check_short:
        # a filter on the (small, broadcast) plan table runs for every stratum, so the error fires
        # even when no stratum has a boundary bucket and nothing downstream reads ``_need``
        short = F.coalesce(F.col("_total"), F.lit(0)) < F.col("_quota")
        plan = plan.where(F.when(short, F.raise_error(F.concat(
            F.lit("stratum too small for its quota: "),
            F.to_json(F.struct(*strata, "_quota", "_total"))))).otherwise(F.lit(True)))
    plan = checked_broadcast(plan.where(F.col("_quota") > 0).select(*strata, "_bbucket", "_need"))
    joined = keyed.join(plan, list(strata))
    inside = joined.where(F.col("_bucket") < F.col("_bbucket"))
    edge = joined.where(F.col("_bucket") == F.col("_bbucket"))
    rank = Window.partitionBy(*strata).orderBy("_h", id_col)
    edge = edge.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= F.col("_need")).drop("_r")
    return inside.unionByName(edge).drop("_h", "_bucket", "_bbucket", "_need")


def seeded_pick(df: DataFrame, id_col: str, seed: int = 1) -> DataFrame:
    """L3: one reproducible "random" row: the smallest seeded hash (a top-1, so partial per partition)."""
    h = seeded_hash(F.col(id_col), seed)
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(1).drop("_h")
