"""Quality rules: a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Two multinomials over ``2 ** BITS`` buckets of hashed one- and two-token n-grams are counted: one over every text, one over
the trusted texts. Each bucket weighs the logarithm of its trusted share over its raw share, both smoothed: ``PSEUDO`` trusted
counts are added to each bucket, and as many raw ones as belong to them by the corpora's sizes, so that a bucket without
evidence weighs nothing. A text's score is the sum of its n-grams' weights divided by their number. Every text is
judged alike: it is kept where its score reaches ``LEAST``; nothing is sampled or drawn. Texts too short or too repetitive fail before that.

Counts cover all texts. A task adds up its own counts and sends them as array chunks, which meet by chunk, so the driver
receives ``2 ** BITS`` numbers a multinomial, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.llm.common import FOLD, bound_batches, fits, fresh
from provenance_spark.operators.chunks import chunks, sum_chunks

BITS = 18
#: Trusted counts added to each bucket: below about as many, a difference between the corpora is taken for chance.
PSEUDO = 10.0
#: Least score of a kept text, in natural logarithms an n-gram: the raw corpus explains it at most 16 % better a token than the trusted texts.
LEAST = -0.15
MIN_WORDS = 50
#: A text fails above this share of words in repeated windows, in percent.
REPEATED = 50
#: Trusted ids that are broadcast (8 bytes each); beyond that texts and ids meet in a shuffle join.
BROADCAST_IDS = 1_000_000

#: A token is a run of letters and digits, or of symbols.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x200-9a-z\x80-\xff]+")
SYMBOLS = b"#*$%&|<>"
JUDGED = (("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
          ("n_repeat_words", T.LongType()), ("score", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()))


class Hashes(dict):
    """Token to CRC-32, remembered for up to a million tokens."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[token] = zlib.crc32(token)
        return value


def grams(raw: bytes | None, hashes: Hashes) -> np.ndarray:
    """The buckets of a text's one- and two-token n-grams, with repeats."""
    tokens = TOKEN.findall((raw or b"").translate(FOLD))
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * np.uint64(0x1F123BB5) + h[1:] + np.uint64(1 << 33)
    mixed = (np.concatenate([h, pairs]) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's multiplier spreads bits upwards
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, kinds = ids[:n], len(number)
    for j in range(1, width):
        key = key * kinds + ids[j:j + n]
        if j + 1 < width and kinds ** (j + 2) >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    hit = np.zeros(len(words), bool)
    for j in range(width):
        hit[starts + j] = True
    return int(hit.sum())


def base(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = raw or b""
    words = raw.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), int(np.count_nonzero((joined & 0xC0) != 0x80)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def weights(raw: np.ndarray, trusted: np.ndarray, pseudo: float = PSEUDO) -> np.ndarray:
    """The log-likelihood ratio of each bucket; zeros where either corpus has no n-grams."""
    n, t = raw.sum(), trusted.sum()
    return np.log((trusted + pseudo) / (raw * (t / n) + pseudo)) if n and t else np.zeros(len(raw))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Bucket weights from all texts of ``docs`` and those of them whose id stands in ``trusted``.

    Null texts count nothing, null ids are never trusted, repeated ids of ``trusted`` count once and repeated rows of ``docs`` each.
    Without texts or without trusted texts all weights are zero. Counts below 2^53 are exact.
    """
    bound_batches(docs.sparkSession)
    ids = trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    ids = ids.withColumn("trusted", F.lit(True))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    joined = texts.join(F.broadcast(ids) if fits(ids, BROADCAST_IDS) else ids, "id", "left").select("text", "trusted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = Hashes(), np.zeros((2, 1 << BITS))
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = grams(text, hashes)
                if len(at) < 1 << 12:
                    at, n = np.unique(at, return_counts=True)
                    sums[0, at] += n
                    if good:
                        sums[1, at] += n
                else:
                    n = np.bincount(at, minlength=1 << BITS)
                    sums[0] += n
                    if good:
                        sums[1] += n
        rows = [{"key": k, "chunk": c, "v": v} for k in (0, 1) for c, v in chunks(sums[k]) if v.any()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int32()), ("chunk", pa.int32()), ("v", pa.list_(pa.float64()))]))

    out = np.zeros((2, 1 << BITS))
    step = len(next(chunks(out[0]))[1])
    for key, chunk, v in sum_chunks(joined.mapInArrow(count, "key int, chunk int, v array<double>")).collect():  # 2^BITS numbers a corpus
        out[key, chunk * step:chunk * step + len(v)] = v
    return weights(*out)


def annotate(docs: DataFrame, table: np.ndarray, text_col: str = "text", to: str = "rules", least: float = LEAST) -> DataFrame:
    """``docs`` with a struct column of JUDGED: counts of the whole text, its score, ``base_failed`` and the verdict ``kept``.

    Rows aren't shuffled and other columns pass through. A null or empty text has no words: score 0, base_failed, not kept. A text
    whose score equals ``least`` is kept; equal texts have equal verdicts; an empty table stays empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(table)
    raw = fresh(docs, "raw_text")
    struct = T.StructType([T.StructField(n, t) for n, t in JUDGED])
    arrow = pa.struct([(n, pa.int64() if t == T.LongType() else pa.float64() if t == T.DoubleType() else pa.bool_()) for n, t in JUDGED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weigh = Hashes(), shared.value
        for b in batches:
            found = []
            for text in b.columns[-1].to_pylist():
                counts, at = base(text), grams(text, hashes)
                score = float(weigh[at].sum()) / len(at) if len(at) else 0.0
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEATED * counts[0]
                found.append(dict(zip((n for n, _ in JUDGED), (*counts, score, failed, not failed and score >= least), strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, arrow)], names=[*b.schema.names[:-1], to])

    return docs.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, struct)]))


def trusted_ids(labels: DataFrame, good: Column, id_col: str = "doc_id") -> DataFrame:
    """The ids of the rows of ``labels`` where ``good`` holds; where it is null it doesn't."""
    return labels.where(F.coalesce(good, F.lit(False))).select(id_col)


def keep(docs: DataFrame, table: np.ndarray, text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, with their columns as they were."""
    to = fresh(docs, "rules")
    return annotate(docs, table, text_col, to=to).where(F.col(to)["kept"]).select(*docs.columns)
