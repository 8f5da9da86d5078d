"""ST2: incremental fitting per micro-batch (``partial_fit`` on successive chunks).

Each micro-batch continues the mixed SGD of ``operators.sgd`` from the weights stored after the
previous batch. Features are hashed (F12), so no vocabulary has to be refitted as data arrives.
Each batch's weights and step count are a folder of their own; a replayed batch finds its folder
complete and is skipped, which makes the sink idempotent under retries. A batch reads only the last
folder before it, so its time doesn't grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.functions import fixed_values as fv
from provenance_spark.functions.text import with_ngram_terms
from provenance_spark.operators import sgd
from provenance_spark.operators.features import doc_term_rows
from provenance_spark.sources.materialize import is_complete, list_folders

#: One row for each loss: its non-zero weights, intercept and the number of steps made.
WEIGHT_SCHEMA = T.StructType([T.StructField("l", T.LongType()), T.StructField("idx", T.ArrayType(T.LongType())),
                              T.StructField("val", T.ArrayType(T.DoubleType())), T.StructField("b", T.DoubleType()),
                              T.StructField("step", T.LongType())])


def hashed_rows(df: DataFrame, text_col: str = "text", num_features: int = 1 << 18,
                hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """F12 as index/value arrays: one hashed bucket per 1-2-gram with value 1.0. ``hash_of`` gives a
    term's integer hash.

    Duplicate buckets are summed and each row is L2-normalised inside the SGD task
    (``compact=True``), which is linear per row; doing it with array lambdas would re-evaluate
    the sorted bucket list for every element.
    """
    staged = with_ngram_terms(df, text_col, "_terms")
    idx = F.transform("_terms", lambda t: F.pmod(hash_of(t), F.lit(num_features)).cast("int"))
    # every bucket starts at 1.0: an array of ones as long as idx, without a second lambda
    return (staged.withColumn("idx", idx).drop("_terms")
            .withColumn("val", F.array_repeat(F.lit(1.0), F.size("idx"))))


def hashed_terms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num_features: int = 1 << 18,
                 hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """F12 in long form: (doc, bucket), a row for each 1-2-gram. No lambdas, so hashing is code-generated."""
    rows = doc_term_rows(df, id_col, text_col)
    return rows.select(id_col, F.pmod(hash_of(F.col("term")), F.lit(num_features)).cast("int").alias("bucket"))


class IncrementalSGD:
    """``foreachBatch`` handler keeping the weights of all SGD losses in ``state_dir``."""

    def __init__(self, spark: SparkSession, state_dir: str, num_features: int = 1 << 18,
                 losses=fv.SGD_LOSSES, label_col: str = "AI", text_col: str = "text"):
        self.spark = spark
        self.state_dir = state_dir.rstrip("/")
        self.dim = num_features
        self.losses = tuple(losses)
        self.label_col = label_col
        self.text_col = text_col

    def _folder(self, batch_id: int) -> str:
        return f"{self.state_dir}/batch-{batch_id}"

    def stored_batches(self) -> set[int]:
        """Ids of the complete folders: a listing, no scan."""
        return {int(name[6:]) for name in list_folders(self.spark, self.state_dir)
                if name.startswith("batch-") and is_complete(self.spark, f"{self.state_dir}/{name}")}

    def state(self, before: int | None = None) -> tuple[np.ndarray, np.ndarray, int, int | None]:
        """Weights, intercepts, steps and id of the latest stored batch (optionally the latest before ``before``)."""
        W, b = np.zeros((len(self.losses), self.dim)), np.zeros(len(self.losses))
        ids = [i for i in self.stored_batches() if before is None or i < before]
        if not ids:
            return W, b, 0, None
        step = 0
        for r in self.spark.read.schema(WEIGHT_SCHEMA).parquet(self._folder(max(ids))).toArrow().to_batches():
            for l, idx, val, own, at in zip(*r.columns, strict=True):  # a row for each loss
                W[l.as_py(), idx.values.to_numpy()] = val.values.to_numpy()
                b[l.as_py()], step = own.as_py(), at.as_py()
        return W, b, step, max(ids)

    def weights(self, before: int | None = None) -> tuple[np.ndarray, np.ndarray, int | None]:
        W, b, _, last = self.state(before)
        return W, b, last

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.stored_batches():
            return  # replayed batch: already applied
        W0, b0, step, _ = self.state(before=batch_id)
        rows = hashed_rows(batch, self.text_col, self.dim).select(
            "idx", "val", F.col(self.label_col).alias("y"))
        W, b, step = sgd.mixed_sgd(rows, self.dim, self.losses, init=(W0, b0), compact=True, step=step)
        kept = [np.flatnonzero(w) for w in W]
        table = pa.table({"l": range(len(W)), "idx": kept, "val": [w[k] for w, k in zip(W, kept, strict=True)],
                          "b": b, "step": [step] * len(W)})
        self.spark.createDataFrame(table, WEIGHT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(self._folder(batch_id))
