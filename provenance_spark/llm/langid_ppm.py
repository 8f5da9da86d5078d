"""Language identification by prediction by partial matching (PPM, escape method C).

For each language, byte counts after every context of up to ``ORDER`` bytes form a context tree. A byte seen
in its longest context costs -log2(count / (total + kinds)); otherwise the escape costs
-log2(kinds / (total + kinds)) and the next shorter context is asked, down to a flat 1/256. The statistics
are frozen before scoring, so a text's exact code length under a language is the sum of a function of each
byte and the ``ORDER`` bytes before it, and whole batches are scored with array look-ups.

Counting is a distributed aggregation over the training texts. The trees are fitted on a bounded sample of
labelled rows: about ``TRAIN_DOCS`` rows a language, picked by hash, whole texts, and about ``MAX_NODES``
byte strings, so the broadcast model is bounded. Each language has its own share of them: a language below an
even share keeps all its strings, and one above it its commonest. Texts are lower-cased first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.llm.common import bound_batches, fresh

#: Context bytes. A window of these and the byte itself fits 32 bits.
ORDER = 3
TRAIN_DOCS = 1500
MAX_NODES = 1 << 20
SEED = 7
UNKNOWN = "und"
#: Bytes scored at once.
PIECE = 1 << 20
PAD = b" " * ORDER
_BUCKETS = 1 << 30


def byte_windows(raw: bytes) -> np.ndarray:
    """For each byte of ``raw``, it and the ORDER bytes before it as one integer; spaces stand before the text."""
    b = np.frombuffer(PAD + raw, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(byte_windows(raw))
        for lang, parts in by.items():
            w, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w)), pa.array(w.astype(np.int64)), pa.array(n)],
                                             names=["lang", "w", "n"])


def sample(docs: DataFrame, lang_col: str, text_col: str, key: Column, rows: int = TRAIN_DOCS) -> DataFrame:
    """``(lang, text)`` of about ``rows`` rows of each language, picked by hash of the key; all if there are fewer."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shares = known.groupBy(F.col(lang_col).alias("lang")).agg(F.least(F.lit(1.0), rows / F.count("*")).alias("share"))
    share = {r["lang"]: r["share"] for r in shares.collect()}  # a row for each language
    if not share:
        return known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(0)
    limit = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(s * _BUCKETS))])[F.col(lang_col)]
    picked = known.where(F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(_BUCKETS)) < limit)
    return picked.select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).cast("binary").alias("text"))


class Model:
    """Frozen context trees of several languages, as sorted arrays of byte strings and their counts."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.trees = [[self._level(w, n, k) for k in range(ORDER + 1)] for w, n in counts]
        known = np.unique(np.concatenate([w for w, _ in counts])) if counts else np.zeros(0, np.uint32)
        self.costs = np.vstack([self.cost(known), np.zeros((1, len(langs)), np.float32)])
        self.bits = max(4, int(np.ceil(np.log2(max(2, 2 * len(known))))) + 1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.known = known
        todo = np.arange(len(known), dtype=np.int32)
        step = 0
        while len(todo):  # linear probing, all keys a step at a time
            at = (self._hash(known[todo]) + step) & ((1 << self.bits) - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            todo = todo[self.slots[at] != todo]
            step += 1
        self.steps = step

    @staticmethod
    def _level(w: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """For contexts of k bytes: strings of k + 1 bytes and counts; contexts, their totals and numbers of kinds."""
        if k < ORDER:
            w = w & np.uint32((1 << 8 * (k + 1)) - 1)
        keys, inverse = np.unique(w, return_inverse=True)
        count = np.bincount(inverse, n, len(keys))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        return keys, count, contexts, np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))

    def _hash(self, w: np.ndarray) -> np.ndarray:
        return ((w * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def cost(self, w: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window after the bytes before it, for each language."""
        out = np.zeros((len(w), len(self.langs)), np.float32)
        for lang, levels in enumerate(self.trees):
            left, bits = np.arange(len(w)), np.zeros(len(w))
            for k in range(ORDER, -1, -1):
                keys, count, contexts, total, kinds = levels[k]
                if not len(keys) or not len(left):
                    break
                key = w[left] & np.uint32((1 << 8 * (k + 1)) - 1) if k < ORDER else w[left]
                c = np.minimum(np.searchsorted(contexts, key >> 8), len(contexts) - 1)
                s = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                known, seen = contexts[c] == key >> 8, keys[s] == key
                whole = total[c] + kinds[c]
                bits[left[seen]] -= np.log2(count[s] / whole)[seen]
                escaped = known & ~seen
                bits[left[escaped]] -= np.log2(kinds[c] / whole)[escaped]
                left = left[~seen]
            bits[left] += 8
            out[:, lang] = bits
        return out

    def _rows(self, w: np.ndarray) -> np.ndarray:
        """Index of each window in ``costs``; the last row's index where no tree has the window."""
        home, mask = self._hash(w), (1 << self.bits) - 1
        got = self.slots[home]
        hit = (got >= 0) & (self.known[got] == w) if len(self.known) else np.zeros(len(w), bool)
        rows = np.where(hit, got, len(self.known))
        left = np.flatnonzero(~hit & (got >= 0))
        for step in range(1, self.steps):
            if not len(left):
                break
            got = self.slots[(home[left] + step) & mask]
            hit = (got >= 0) & (self.known[got] == w[left])
            rows[left[hit]] = got[hit]
            left = left[~hit & (got >= 0)]
        return rows

    def lengths(self, texts: list[bytes | None]) -> np.ndarray:
        """Exact code length in bits of every text under every language."""
        out, piece, owner, size = np.zeros((len(texts), len(self.langs))), [], [], 0

        def flush() -> None:
            w = np.concatenate(piece)
            rows = self._rows(w)
            bits = self.costs[rows]
            new = np.flatnonzero(rows == len(self.known))
            if len(new):
                kinds, inverse = np.unique(w[new], return_inverse=True)
                bits[new] = self.cost(kinds)[inverse]
            starts = np.cumsum([0, *(len(x) for x in piece[:-1])])
            np.add.at(out, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))

        for i, raw in enumerate(texts):
            w = byte_windows(raw) if raw else None
            for start in range(0, len(raw or b""), PIECE):
                piece.append(w[start:start + PIECE])
                owner.append(i)
                size += len(piece[-1])
                if size >= PIECE:
                    flush()
                    piece, owner, size = [], [], 0
        if piece:
            flush()
        return out

    def predict(self, texts: list[bytes | None], letters: list[bool]) -> tuple[list[str], list[float]]:
        """Language of the shortest code (ties: the first in order) and its posterior under equal priors."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = self.lengths(texts)
        best = bits.argmin(1) if len(texts) else []
        score = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1) if len(texts) else []
        return ([self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)],
                [float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)])


def shares(sizes: dict[str, int], nodes: int) -> dict[str, int]:
    """Strings each language may keep: all of its own up to an even share; what small ones leave goes to the others."""
    out, left = {}, nodes
    for n, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(size, max(1, left // (len(sizes) - n)))
        left -= out[lang]
    return out


def _prune(counts: DataFrame, nodes: int) -> tuple[list[str], DataFrame]:
    """All languages of ``counts``, and its rows within each language's share: the commonest; of equally common strings that don't all fit, some by hash."""
    classes: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", "n").agg(F.count("*").alias("k")).collect():  # a row for each language and count
        classes.setdefault(r["lang"], []).append((r["n"], r["k"]))
    room = shares({lang: sum(k for _, k in rows) for lang, rows in classes.items()}, nodes)
    cut = []
    for lang, rows in classes.items():
        left = room[lang]
        for n, k in sorted(rows, reverse=True):
            if k > left:
                cut.append((lang, n, left / k))
                break
            left -= k
    if not cut:
        return sorted(classes), counts
    edge, share = (F.create_map(*[F.lit(x) for row in cut for x in (row[0], row[i])])[F.col("lang")] for i in (1, 2))
    some = F.pmod(F.xxhash64(F.lit(SEED), "w"), F.lit(_BUCKETS)) < share * _BUCKETS
    return sorted(classes), counts.where(edge.isNull() | (F.col("n") > edge) | ((F.col("n") == edge) & some))


def fit(docs: DataFrame, lang_col: str, text_col: str, key: Column, rows: int = TRAIN_DOCS,
        nodes: int = MAX_NODES) -> Model:
    """Trees of every language of ``docs``; rows with a null language or text teach nothing."""
    bound_batches(docs.sparkSession)
    counts = (sample(docs, lang_col, text_col, key, rows).mapInArrow(_count, "lang string, w long, n long")
              .groupBy("lang", "w").agg(F.sum("n").alias("n")))
    counts = counts.persist()
    try:
        langs, pruned = _prune(counts, nodes)
        table = pruned.toArrow()
    finally:
        counts.unpersist()
    lang = np.array(table.column("lang").to_pylist(), object)
    w, n = table.column("w").to_numpy().astype(np.uint32), table.column("n").to_numpy()
    return Model(langs, [(w[lang == x], n[lang == x]) for x in langs])


def annotate(docs: DataFrame, model: Model, text_col: str = "text", to: str = "language") -> DataFrame:
    """``docs`` with a struct column of lang and score; rows aren't shuffled and other columns pass through.

    A text that is null, empty or without a letter is ``und`` with score 0; so is every text when nothing was learned.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    low, letter = fresh(docs, "low_text"), fresh(docs, "has_letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score = m.predict(b.columns[-2].to_pylist(), b.columns[-1].to_pylist())
            found = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], found], names=[*b.schema.names[:-2], to])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return (docs.withColumn(low, F.lower(F.col(text_col)).cast("binary"))
            .withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
            .mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, kind)])))


def known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for which a language is found, with their columns as they were."""
    to = fresh(docs, "language")
    return annotate(docs, model, text_col, to).where(F.col(to)["lang"] != UNKNOWN).select(*docs.columns)
