"""Exact row positions at scale (W1, S6, P11, L4) without sorting a group inside one task.

A plain ``row_number().over(Window.partitionBy(g).orderBy(k))`` sends every row of a group through
one task; a group may hold a third of all rows. Instead:

1. range-partition the *narrow* key columns on ``(group, order)`` so a hot group is spread over
   many partitions, sort within partitions and tag each row with
   ``(spark_partition_id, monotonically_increasing_id)``;
2. checkpoint that narrow table (reliable checkpoint in the shared ``spark.checkpoint.dir``) so the
   tags are fixed and survive lost executors;
3. count rows per ``(partition, group)`` - at most ``partitions + groups`` rows - and turn the counts
   into running offsets with a window over that small table;
4. join the offsets back (broadcast: the table is bounded by partitions + groups) and add them to
   the in-partition index.

Slices by position then become key filters: the keys at the slice boundaries (one row per group)
are joined back by group (broadcast after a size check) and compared, so wide rows (texts) are never
shuffled for positioning and the plan does not grow with the number of groups. A single numeric key needs
no positions for that: its boundaries are exact order statistics, found by counting.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.operators.selection import NUMERIC, select_ranks
from provenance_spark.session import checked_broadcast, cut_lineage, ensure_checkpoint_dir, shuffle_partitions

#: Names of the positioning columns of narrow key tables.
POS, SIZE = "_position", "_group_rows"


def with_positions(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (),
                   pos_col: str = "pos", size_col: str | None = None,
                   descending: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row within its group under ``order_by``.

    ``order_by`` must be a total order within a group (end it with a unique column); columns named
    in ``descending`` sort high to low. ``group_by`` must be low-cardinality (splits, classes,
    languages): the broadcast offset table has one row per (partition, group) pair. Pass only the
    columns needed downstream (narrow keys).
    """
    if pos_col in df.columns or size_col in df.columns:
        raise ValueError(f"the table already has a column {pos_col} or {size_col}")
    spark = df.sparkSession
    n_parts = num_partitions or shuffle_partitions(spark)
    keys = [F.col(g).asc_nulls_first() for g in group_by]
    keys += [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_first()
             for c in order_by]
    ensure_checkpoint_dir(spark)
    tagged = (df.repartitionByRange(n_parts, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    stats = tagged.groupBy("_pid", *group_by).agg(F.count(F.lit(1)).alias("_cnt"),
                                                  F.min("_mid").alias("_first"))
    grp = Window.partitionBy(*[F.col(g) for g in group_by]) if group_by else Window.partitionBy(F.lit(0))
    before = grp.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn("_size", F.sum("_cnt").over(grp))
    extra = ["_size"] if size_col else []
    offsets = checked_broadcast(offsets.select(*[F.col(g).alias(f"_o_{g}") for g in group_by],
                                               F.col("_pid").alias("_o_pid"), "_off", "_first", *extra))
    cond = tagged["_pid"] == offsets["_o_pid"]
    for g in group_by:
        cond = cond & tagged[g].eqNullSafe(offsets[f"_o_{g}"])
    joined = tagged.join(offsets, cond, "inner")
    out = [F.col(c) for c in df.columns]
    out.append((F.col("_off") + F.col("_mid") - F.col("_first")).alias(pos_col))
    if size_col:
        out.append(F.col("_size").alias(size_col))
    return joined.select(*out)


#: From a group's number of rows (a column) to its cut positions, as many for every group.
CutFn = Callable[[Column], Sequence[Column | int]]


def boundary_key(df: DataFrame, order_by: Sequence[str], cut: int, descending: Sequence[str] = ()) -> tuple | None:
    """The order key found at position ``cut`` of the whole table (``None`` past its end): one row to the driver."""
    narrow = with_positions(df.select(*order_by), order_by, (), pos_col=POS, descending=descending)
    row = narrow.where(F.col(POS) == max(int(cut), 0)).first()
    return None if row is None else tuple(row[k] for k in order_by)


def _before(order_by: Sequence[str], key: Sequence[Column], descending: Sequence[str]) -> Column:
    """Row-value comparison ``(order_by) < key`` in the positioning order."""
    cond = None
    for i in reversed(range(len(order_by))):
        c, v = F.col(order_by[i]), key[i]
        strict = c > v if order_by[i] in descending else c < v
        cond = strict if cond is None else strict | ((c == v) & cond)
    return cond


def rows_before(df: DataFrame, order_by: Sequence[str], key: tuple | None, descending: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` before an order key (all of them before ``None``)."""
    return df if key is None else df.where(_before(order_by, [F.lit(v) for v in key], descending))


def label_slices(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str], cut_fn: CutFn,
                 label: str, descending: Sequence[str] = ()) -> DataFrame:
    """``df`` with the index of each row's positional slice: slice ``i`` is ``[cut[i-1], cut[i])``.

    ``cut_fn(n)`` gives the cut positions of a group of ``n`` rows, as many for every group; sizes, cuts and the keys found there stay in
    Spark. A single numeric key is looked up by exact selection (:func:`select_ranks`), other keys in the sorted positions.
    """
    n_cuts = len(cut_fn(F.col(SIZE)))
    sizes = df.groupBy(*group_by).agg(F.count("*").alias(SIZE), F.count(order_by[0]).alias("_keyed"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.greatest(F.lit(0), (F.lit(c) if isinstance(c, int) else c)).cast("long").alias("rank"))
                             for i, c in enumerate(cut_fn(F.col(SIZE)))]))
    targets = cut_lineage(sizes.select(*group_by, SIZE, "_keyed", at.alias("_w")).select(*group_by, SIZE, "_keyed", "_w.t", "_w.rank"))
    selected = len(order_by) == 1 and not descending and dict(df.dtypes)[order_by[0]] in NUMERIC
    if selected:
        nulls = F.col(SIZE) - F.col("_keyed")  # null keys come first
        found = select_ranks(df, order_by[0], group_by, targets.withColumn("rank", F.col("rank") - nulls)).withColumn("_key", F.struct(order_by[0]))
    else:
        keys = [*group_by, *order_by]
        narrow = with_positions(df.select(*keys), order_by, group_by, pos_col=POS, descending=descending)
        wanted = checked_broadcast(targets.select(*[F.col(g).alias(f"_g_{g}") for g in group_by], "t", "rank"))
        same = narrow[POS] == wanted["rank"]
        for g in group_by:
            same = same & narrow[g].eqNullSafe(wanted[f"_g_{g}"])
        found = narrow.join(wanted, same).withColumn("_key", F.struct(*order_by))
    marks = [F.col(g).alias(f"_g_{g}") for g in group_by]
    cuts = found.groupBy(*marks).agg(*[F.max(F.when(F.col("t") == i, F.col("_key"))).alias(f"_k{i}") for i in range(n_cuts)])
    ends = targets.groupBy(*marks).agg(*[F.max(F.when(F.col("t") == i, F.when(F.col("rank") >= F.col(SIZE), 1).when(
        F.col("rank") < F.col(SIZE) - F.col("_keyed"), -1).otherwise(0))).alias(f"_e{i}") for i in range(n_cuts)])
    cond = F.lit(True)
    for g in group_by:
        cond = cond & ends[f"_g_{g}"].eqNullSafe(cuts[f"_g_{g}"])
    held = ends.join(cuts, cond, "left").select(*[ends[f"_g_{g}"] for g in group_by], *[c for i in range(n_cuts) for c in (f"_e{i}", f"_k{i}")])
    held = checked_broadcast(held)
    match = F.lit(True)
    for g in group_by:
        match = match & df[g].eqNullSafe(held[f"_g_{g}"])
    joined = df.join(held, match)
    out = None
    for i in range(n_cuts):
        before = _before(order_by, [F.col(f"_k{i}")[k] for k in order_by], descending)
        if selected:  # a cut among the null keys: they can't be told apart, and stay together after it
            before = F.when(F.col(f"_e{i}") == -1, F.lit(False)).otherwise(df[order_by[0]].isNull() | before)
        inside = (F.col(f"_e{i}") == 1) | F.coalesce(before, F.lit(False))
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return joined.select(*[df[c] for c in df.columns], out.otherwise(F.lit(n_cuts)).alias(label))


def first_n_by_key(df: DataFrame, order_by: Sequence[str], n: int | Column, group_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group in key order, exactly (``n`` may be an expression over the group's columns)."""
    return label_slices(df, order_by, group_by, lambda size: [n], "_slice").where(F.col("_slice") == 0).drop("_slice")


def row_at(df: DataFrame, order_by: Sequence[str], k: int) -> DataFrame:
    """The row at 0-based position ``k`` in key order (empty if the table is shorter): a top-k per task."""
    return df.orderBy(*order_by).offset(k).limit(1)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order: a top-k per task."""
    return df.orderBy(*order_by).limit(n)
