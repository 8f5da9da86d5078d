"""Splits of the corpus: positional slices (W1, U2), prepared training sets (W3), search frames (U4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenance_spark.operators.positions import CutFn, label_slices
from provenance_spark.operators.sampling import balanced_quotas, seeded_hash, stratified_sample

SLICE_NAMES = ("train", "valid", "test")


def fraction_cuts(train_tenths: int = 8, valid_tenths: int = 1) -> CutFn:
    """Cut positions for the first ``train_tenths``/10 rows and the next ``valid_tenths``/10, rounded up."""
    def tenths(n, k: int):
        return -(-k * n // 10) if isinstance(n, int) else F.call_function("div", n * k + 9, F.lit(10).cast("long"))
    return lambda n: [tenths(n, train_tenths), tenths(n, train_tenths + valid_tenths)]


def head_cuts(train_rows: int, valid_rows: int) -> CutFn:
    """``iloc[:a]``, ``iloc[a:a+b]``, rest - slices counted from the start."""
    return lambda n: [train_rows, train_rows + valid_rows]


def tail_cuts(valid_rows: int, test_rows: int) -> CutFn:
    """``iloc[:-(v+t)]``, ``iloc[-(v+t):-t]``, ``iloc[-t:]`` - slices counted from the end."""
    return lambda n: [n - valid_rows - test_rows, n - test_rows]


def positional_split(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str],
                     cuts: CutFn, names: Sequence[str] = SLICE_NAMES,
                     split_col: str = "split") -> DataFrame:
    """W1 + U2: label every row of each corpus with the positional slice it falls in.

    ``cuts(n)`` gives the cut positions for a group of ``n`` rows; the labels stay one DataFrame
    (the union of the per-corpus slices) with a ``split`` column.
    """
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_slice") + 1)
    return label_slices(df, order_by, group_by, cuts, "_slice").withColumn(split_col, name).drop("_slice")


def shuffle_before_split(df: DataFrame, id_col: str, cuts: CutFn, seed: int = 1,
                         names: Sequence[str] = SLICE_NAMES, split_col: str = "split") -> DataFrame:
    """Positional slices of one corpus in seeded random order (ties by id) instead of its own."""
    keyed = df.withColumn("_h", seeded_hash(F.col(id_col), seed))
    return positional_split(keyed, ["_h", id_col], (), cuts, names, split_col).drop("_h")


def prepare_datasets(corpus: DataFrame, train_size: int | None = None, eval_size: int | None = None,
                     seed: int = 1) -> DataFrame:
    """Flagship (W3 over U2): a balanced, versioned sample of every split.

    Each split is sampled 4:1:1:2 over (human, gpt2, gpt3, gpt3.5). ``train_size``/``eval_size``
    fix the sample size (multiples of 8); ``None`` takes the largest balanced sample the split
    supports. A stratum that is missing or too short for one part raises in every split.
    """
    counts = corpus.groupBy("split", "version").agg(F.count(F.lit(1)).alias("n"))
    total = {}
    if train_size is not None:
        total["train"] = train_size
    if eval_size is not None:
        total["valid"] = eval_size
        total["test"] = eval_size
    quotas = balanced_quotas(counts, total=total)
    return stratified_sample(corpus, ["split", "version"], quotas, seed=seed)


def search_frame(prepared: DataFrame) -> DataFrame:
    """U4: train and valid stacked with a fold marker (-1 = always train, 0 = the validation fold)."""
    return (prepared.where(F.col("split").isin("train", "valid"))
            .withColumn("fold", F.when(F.col("split") == "train", -1).otherwise(0)))
