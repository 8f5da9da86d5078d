"""Sums of long vectors that tasks make: each vector travels as a few array rows, not a row for each number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame

from provenance_spark.session import shuffle_partitions

#: Numbers in one array row (32 KB).
CHUNK = 4096
#: Chunks that meet in a task at least: small sums need few tasks.
MEET = 16


def chunks(vec: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Numbered pieces of ``vec`` of at most ``CHUNK`` numbers."""
    for c, start in enumerate(range(0, len(vec), CHUNK)):
        yield c, vec[start:start + CHUNK]


def sum_chunks(parts: DataFrame) -> DataFrame:
    """Element-wise sums of the arrays ``v`` for each (key, chunk).

    Rows of a (key, chunk) meet in one task, which adds them as they come: it holds its sums, never the rows.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, chunk, v in zip(pdf["key"], pdf["chunk"], pdf["v"]):
                at = (key, chunk)
                sums[at] = sums[at] + v if at in sums else np.array(v, dtype=np.float64)
        if sums:
            yield pd.DataFrame([(*at, v) for at, v in sums.items()], columns=["key", "chunk", "v"])

    n = shuffle_partitions(parts.sparkSession)
    return parts.repartition(n, "key", "chunk").mapInPandas(add, parts.schema)


def total_of(pieces: RDD, size: int, partitions: int) -> np.ndarray:
    """The sum of vectors of ``size`` numbers whose chunks are in ``pieces``: they meet by number, and the driver gets the sums."""
    out = np.zeros(size)
    meet = min(partitions, -(-size // (CHUNK * MEET)))
    for c, v in pieces.reduceByKey(np.add, meet).collect():
        out[c * CHUNK:c * CHUNK + len(v)] = v
    return out
