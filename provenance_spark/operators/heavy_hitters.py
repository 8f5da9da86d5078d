"""Vocabulary by heavy hitters (F3, L4): bounded summaries, candidates with proven bounds, an exact recount of those alone.

1. Each task passes its (term, tf) rows through a Misra-Gries summary of at most ``capacity`` terms: beyond it, the count of the first
   term that doesn't fit is taken off all of them and added to the task's error. Summaries merge by addition, so a term with the summed
   count ``low`` occurs ``low`` to ``low + error`` times, and a term in no summary at most ``error`` times (the errors of all tasks).
2. A kept term is in ``min_df`` documents or more, so occurs as often; and if ``max_features`` terms or more are surely in ``min_df``
   documents, it occurs at least as often as the ``max_features``-th of these by ``low``. The larger of the two is the ``floor``.
3. Where the error is below the floor, every kept term is in a summary: that is the proof. Terms with ``low + error`` below the floor go,
   the others are the candidates, and only their rows are counted exactly.

Without the proof the summaries were too small for the table: the capacity is raised fourfold until ``max_capacity``, and if that
isn't enough all terms are counted. The result is the exact one in every case. What is shuffled is ``capacity`` rows a task and
the partial counts of candidates, where plain counting shuffles every distinct term of every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenance_spark.operators.positions import boundary_key
from provenance_spark.session import checked_broadcast, cut_lineage

CAPACITY, MAX_CAPACITY = 1 << 17, 1 << 21
#: Candidates up to this many are broadcast to the recount; beyond it they are joined by a shuffle.
MAX_BROADCAST = 1 << 20
SCHEMA = "term string, low long, docs long, error long"
NAMES = ["term", "low", "docs"]


@dataclass
class Candidates:
    """``terms`` has (term, low, docs): bounds from below of occurrences and documents; ``proved`` says that no kept term is missing."""
    terms: DataFrame
    error: int
    floor: int
    proved: bool
    capacity: int


class Summary:
    """Misra-Gries counters of at most ``capacity`` terms; rows wait until there are as many as counters, then join them at once."""

    def __init__(self, capacity: int):
        self.capacity, self.error, self.waiting, self.rows = capacity, 0, [], 0
        self.held = pa.table({"term": pa.array([], pa.string()), "low": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})

    def add(self, term: pa.Array, tf: pa.Array) -> None:
        self.waiting.append(pa.table({"term": term.cast(pa.string()), "low": tf.cast(pa.int64()), "docs": pa.array(np.ones(len(term), np.int64))}))
        self.rows += len(term)
        if self.rows >= self.capacity:
            self.settle()

    def settle(self) -> None:
        whole = pa.concat_tables([self.held, *self.waiting]).group_by("term", use_threads=False).aggregate([("low", "sum"), ("docs", "sum")])
        self.held = whole.select(["term", "low_sum", "docs_sum"]).rename_columns(NAMES)
        self.waiting, self.rows = [], 0
        if len(self.held) > self.capacity:
            low = self.held["low"].to_numpy()
            cut = int(np.partition(low, len(low) - self.capacity - 1)[len(low) - self.capacity - 1])  # the first that doesn't fit
            self.error += cut
            self.held = self.held.set_column(1, "low", pc.subtract(self.held["low"], cut)).filter(pc.greater(self.held["low"], cut))


def summaries(tf: DataFrame, capacity: int) -> DataFrame:
    """Each task's summary; a row with a null term carries the task's error. Null terms take no part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Summary(capacity)
        for b in batches:
            s.add(b.column(0), b.column(1))
        s.settle()
        out = s.held.append_column("error", pa.array(np.zeros(len(s.held), np.int64)))
        yield from out.to_batches(max_chunksize=10_000)
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "low": [0], "docs": [0], "error": [s.error]})

    return tf.where(F.col("term").isNotNull()).select("term", "tf").mapInArrow(run, SCHEMA)


def candidates(tf: DataFrame, min_df: int, max_features: int | None, capacity: int = CAPACITY) -> Candidates:
    """Terms of ``tf`` (one row for each document and term) that may be in the vocabulary."""
    made = cut_lineage(summaries(tf, capacity).groupBy("term").agg(F.sum("low").alias("low"), F.sum("docs").alias("docs"), F.sum("error").alias("error")))
    error = made.where(F.col("term").isNull()).agg(F.max("error")).first()[0] or 0
    terms, floor = made.where(F.col("term").isNotNull()).drop("error"), min_df
    if max_features is not None:
        sure = terms.where(F.col("docs") >= min_df)
        # the key after the first max_features - 1 is that of the max_features-th
        key = boundary_key(sure.select("low", "term"), ["low", "term"], max_features - 1, descending=["low"]) if max_features else None
        floor = max(floor, key[0]) if key else floor
    return Candidates(terms.where(F.col("low") + error >= floor), error, floor, error < floor, capacity)


def frequent_terms(tf: DataFrame, min_df: int, max_features: int | None, capacity: int = CAPACITY, max_capacity: int = MAX_CAPACITY) -> DataFrame:
    """The rows of ``tf`` that can matter to the vocabulary: those of proven candidates, or all where nothing could be proved."""
    while True:
        found = candidates(tf, min_df, max_features, capacity)
        if found.proved:
            kept = checked_broadcast(found.terms.select("term"), MAX_BROADCAST)
            return tf.join(kept, "term", "left_semi")
        if capacity >= max_capacity:
            return tf
        capacity = min(4 * capacity, max_capacity)
