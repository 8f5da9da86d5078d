"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters folded to lower case, every other byte as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every ASCII byte that is neither letter nor digit turned into a space. Bytes from
#: 0x80 are parts of UTF-8 sequences and belong to words. The length, and so every offset, is kept.
FOLD_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
#: Rows handed to a Python worker at once: texts may be long, so fewer than Spark's default.
ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Hold Arrow batches to ``rows`` rows, so that a worker's memory doesn't follow the text length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text, modulo ``folds``, is ``fold``. A null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
