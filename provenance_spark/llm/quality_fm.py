"""Quality scores from a factorisation machine (Rendle 2010).

A text's features are its hashed words and buckets of structure statistics and of its size as metadata. The
score is the logistic of a bias, a linear part and all pairwise interactions of features, each weighed by the inner
product of two vectors of ``RANK`` numbers. The pairs are never formed: for each factor the sum over pairs is half
of the squared sum less the sum of squares, so scoring takes time linear in the number of features.

The machine is fitted on a bounded sample of labelled rows, ``FIT_ROWS`` at most of up to ``FIT_CHARS`` characters each,
picked by hash. Features are made by Spark tasks; the fit itself is mini-batch Adam over that sample. Scoring
reads every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.llm.common import FOLD_WORDS, bound_batches, fresh

FIT_ROWS = 6000
FIT_CHARS = 65_536
WORD_BITS = 16
RANK = 8
STEPS = 400
BATCH = 96
RATE = 0.02
DECAY = 1e-4
SEED = 11

#: Bucket edges of the structure statistics (shares of words, letters, bytes or lines; sizes as powers of two).
SHARES = (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95)
LENGTHS = (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.5, 10.0, 15.0, 30.0)
SIZES = tuple(float(1 << n) for n in range(0, 20, 2))
STATS = (("capitals", SHARES), ("symbols", SHARES), ("digits", SHARES), ("repeated word", SHARES), ("distinct words", SHARES),
         ("distinct lines", SHARES), ("symbol words", SHARES), ("double endings", SHARES),
         ("word length", LENGTHS), ("words", SIZES), ("longest run", SIZES), ("words a line", SIZES))
BUCKETS = len(SHARES) + 1
WIDTH = (1 << WORD_BITS) + len(STATS) * BUCKETS
#: Byte classes: 1 capital, 2 small letter or part of one, 3 digit, 4 white space, 5 other.
KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r\x0b\x0c" else 5
                 for b in range(256)], np.uint8)


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """The values of STATS for a text and its words, in lower case and without symbols."""
    text = np.frombuffer(b" " + raw + b" ", np.uint8)
    kind = KIND[text]
    kinds = np.bincount(kind, minlength=6)
    ink, letters, n = max(1, len(raw) - int(kinds[4]) + 2), max(1, int(kinds[1] + kinds[2])), max(1, len(words))
    white = kind == 4
    ends = np.flatnonzero(white[1:] & ~white[:-1])  # last bytes of what white space divides
    symbol = kind[ends] == 5
    doubled = int((symbol & (text[ends] == text[ends - 1])).sum())
    bare = int((symbol & white[ends - 1]).sum())
    same = np.fromiter(map(eq, words, islice(words, 1, None)), bool, max(0, len(words) - 1))
    breaks = np.flatnonzero(~np.concatenate([[False], same, [False]]))
    longest = int(np.diff(breaks).max()) if len(words) else 0
    lined = [x for x in raw.split(b"\n") if x.strip()]
    return [kinds[1] / letters, kinds[5] / ink, kinds[3] / ink, same.sum() / n, len(set(words)) / n,
            len(set(lined)) / max(1, len(lined)), bare / max(1, len(ends)), doubled / max(1, len(ends)),
            ink / n, float(len(words)), float(longest), len(words) / max(1, len(lined))]


def features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words weigh log(1 + count), scaled to length 1 together; so do the statistics' buckets."""
    raw = raw or b""
    words = raw.translate(FOLD_WORDS).split()
    counts = Counter(words)
    at = np.fromiter((zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in counts), np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(counts):
        at, inverse = np.unique(at, return_inverse=True)
        value = np.bincount(inverse, value)
        value /= np.sqrt((value ** 2).sum())
    stats = [(1 << WORD_BITS) + i * BUCKETS + int(np.searchsorted(edges, x, side="left"))
             for i, ((_, edges), x) in enumerate(zip(STATS, statistics(raw, words), strict=True))]
    return np.concatenate([at, stats]).astype(np.int32), np.concatenate([value, np.full(len(stats), len(stats) ** -0.5)]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows whose features begin at ``starts``, and the factor sums, by the sum-of-squares identity."""
        weighed = self.factors[at] * value[:, None]
        sums = np.add.reduceat(weighed, starts)
        squares = np.add.reduceat(weighed ** 2, starts)
        return self.bias + np.add.reduceat(self.linear[at] * value, starts) + 0.5 * (sums ** 2 - squares).sum(1), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(a) for a, _ in rows[:-1])])
        margin, _ = self.margins(np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, rank: int = RANK,
          seed: int = SEED) -> Machine:
    """``steps`` mini-batches of Adam on the logistic loss; without rows, a machine that scores every text 0.5."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, rank)))
    if not rows:
        return m
    share = np.clip(labels.mean(), 0.01, 0.99)
    m.bias = float(np.log(share / (1 - share)))
    moments = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((WIDTH, rank)), np.zeros((WIDTH, rank))]
    bias, queue = [0.0, 0.0], np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(queue) < BATCH:
            queue = np.concatenate([queue, rng.permutation(len(rows))])
        part, queue = queue[:BATCH], queue[BATCH:]
        at = np.concatenate([rows[i][0] for i in part])
        value = np.concatenate([rows[i][1] for i in part]).astype(np.float64)
        sizes = np.array([len(rows[i][0]) for i in part])
        margin, sums = m.margins(at, value, np.cumsum([0, *sizes[:-1]]))
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - labels[part]) / len(part)
        of = np.repeat(np.arange(len(part)), sizes)
        touched, inverse = np.unique(at, return_inverse=True)
        g = error[of] * value
        linear = np.bincount(inverse, g, len(touched)) + DECAY * m.linear[touched]
        each = g[:, None] * (sums[of] - value[:, None] * m.factors[at])
        factors = np.zeros((len(touched), rank))
        np.add.at(factors, inverse, each)
        factors += DECAY * m.factors[touched]
        rate = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        for grad, target, (a, b) in ((linear, m.linear, moments[:2]), (factors, m.factors, moments[2:])):
            a[touched] = 0.9 * a[touched] + 0.1 * grad
            b[touched] = 0.999 * b[touched] + 0.001 * grad ** 2
            target[touched] -= rate * a[touched] / (np.sqrt(b[touched]) + 1e-8)
        bias = [0.9 * bias[0] + 0.1 * error.sum(), 0.999 * bias[1] + 0.001 * error.sum() ** 2]
        m.bias -= rate * bias[0] / (np.sqrt(bias[1]) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        learn_from: Column | None = None, rows: int = FIT_ROWS) -> Machine:
    """A machine that learns ``label_col`` (0 or 1) of ``labels`` over texts of ``docs`` with the same id.

    ``learn_from`` is a condition on ``labels``. Rows with a null id, label or text teach nothing; of repeated
    labels each counts; nulls in other columns don't matter.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known if learn_from is None else known.where(learn_from)
    order = F.xxhash64(F.lit(SEED), F.col(id_col), F.col(label_col))
    picked = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"), order.alias("o"))
    picked = picked.orderBy("o", "id").limit(rows).select("id", "label")  # rows at most: the broadcast is bounded
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= FIT_CHARS)
    joined = texts.join(F.broadcast(picked), "id").select("label", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                names=["label", "at", "value"])

    got = joined.mapInArrow(run, "label double, at binary, value binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["at"], r["value"], r["label"]))  # whatever order the tasks ended in
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in got],
                 np.array([r["label"] for r in got]))


def annotate(docs: DataFrame, machine: Machine, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with each whole text's score between 0 and 1; a null text scores as an empty one. Rows aren't shuffled.

    Texts are scored whole whatever their length, and rows that repeat get the same score each. An empty table gives no rows.
    All columns stay as they were; one that has the name of the raw text's helper column doesn't clash with it.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    raw = fresh(docs, "raw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.score([features(t) for t in b.columns[-1].to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], names=[*b.schema.names[:-1], to])

    return docs.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(
        run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))
