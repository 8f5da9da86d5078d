"""word pieces by longest match in linear time, over distinct words, joined back to the texts.

Greedy longest-match-first splits a word by trying ever shorter pieces from each start, which is quadratic in the word's length. Here the vocabulary is a
trie with failure links (LinMaxMatch, Song et al. 2021): when no edge leads on, the link names the pieces that greedy matching would have
cut off by now and the node where their remainder stands, so every character is read once and every link pays for characters read
before. Words that end without a full match are one unknown id, however long.

A corpus has far fewer distinct words than words: a task splits each word that it meets once and gathers the ids of all places where the
texts are, so no text crosses the network. Only rows that share their id meet.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators.features import bounded_broadcast
from provenance_spark.operators.positions import with_positions
from provenance_spark.session import cut_lineage, shuffle_partitions

#: Pieces of a vocabulary: a model's parameter, read whole by every worker.
MAX_PIECES = 1_000_000
#: Words whose pieces a worker remembers, and rows that it takes at once.
CACHED_WORDS, ROWS_AT_ONCE = 200_000, 512


class Segmenter:
    """Longest-match word pieces. ``pieces`` holds (text, continues, id): pieces that begin a word and pieces that go on in one."""

    def __init__(self, pieces: Iterable[tuple[str, bool, int]], unk_id: int = fv.UNK_ID):
        self.unk_id = unk_id
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 stands after a piece
        ends: dict[int, int] = {}
        for text, continues, number in pieces:
            at = int(continues)
            for c in text:
                if c not in self.edges[at]:
                    self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                at = self.edges[at][c]
            if text:
                ends[at] = number
        #: Where matching goes on when a node has no edge for the next character, and the pieces cut off on the way (-1: nowhere).
        self.fail = [-1] * len(self.edges)
        self.cut: list[tuple[int, ...]] = [()] * len(self.edges)
        queue = deque([0, 1])
        while queue:  # by rising depth, so that links of shallower nodes are known
            u = queue.popleft()
            for c, v in self.edges[u].items():
                if v in ends:
                    self.fail[v], self.cut[v] = 1, (ends[v],)
                else:
                    z, pieces_ = self.fail[u], self.cut[u]
                    while z >= 0 and c not in self.edges[z]:
                        pieces_ += self.cut[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.cut[v] = self.edges[z][c], pieces_
                queue.append(v)

    def __call__(self, word: str) -> list[int]:
        out: list[int] = []
        edges, fail, cut = self.edges, self.fail, self.cut
        u = 0
        for c in word:
            while c not in edges[u]:
                if fail[u] < 0:
                    return [self.unk_id]
                out += cut[u]
                u = fail[u]
            u = edges[u][c]
        while u > 1:
            if fail[u] < 0:
                return [self.unk_id]
            out += cut[u]
            u = fail[u]
        return out


def shared_pieces(spark: SparkSession, vocabulary: DataFrame) -> Broadcast:
    """``vocabulary`` (piece, continues, id) for all tasks: at most ``MAX_PIECES`` rows."""
    held = vocabulary.select("piece", "continues", F.col("id").cast("int")).limit(MAX_PIECES + 1).toArrow()
    if held.num_rows > MAX_PIECES:
        raise ValueError("a vocabulary of word pieces has at most a million rows")
    return spark.sparkContext.broadcast(held)


def segmenter(shared: Broadcast, unk_id: int) -> Segmenter:
    return Segmenter(zip(*(c.to_pylist() for c in shared.value.columns), strict=True), unk_id)


def segmented(words: DataFrame, vocabulary: DataFrame, unk_id: int = fv.UNK_ID) -> DataFrame:
    """``(word, ids)`` of the distinct words of ``words``. ``vocabulary`` has (piece, continues, id), at most ``MAX_PIECES`` rows."""
    shared = shared_pieces(words.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = segmenter(shared, unk_id)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([split(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))],
                                             names=["word", "ids"])

    return words.select("word").where("word IS NOT NULL").distinct().mapInArrow(run, "word string, ids array<int>")


def gather(words: pa.Array, split: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``words`` one after another and how many each has; equal words are split once, null ones have none."""
    coded = words.dictionary_encode()
    found = [split(w) for w in coded.dictionary.to_pylist()]
    sizes = np.array([len(f) for f in found] + [0], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum()))
    codes = coded.indices.fill_null(len(found)).to_numpy(zero_copy_only=False)
    n = sizes[codes]
    before = np.cumsum(n) - n
    return flat[np.repeat(start[codes] - before, n) + np.arange(int(n.sum()))], n


def segmented_rows(df: DataFrame, shared: Broadcast, id_col: str, tokens_col: str, unk_id: int = fv.UNK_ID) -> DataFrame:
    """``(id, _ids, _n)``: the pieces of each row's tokens one after another and how many each token has, where the row is.

    A worker splits every word that it meets once, as long as it remembers it (``CACHED_WORDS``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = segmenter(shared, unk_id), {}

        def cached(word: str) -> list[int]:
            if word not in cache:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                cache[word] = split(word)
            return cache[word]

        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                ids, n = gather(part.column(1).flatten(), cached)
                tokens = np.cumsum(np.concatenate([[0], part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
                ends = np.concatenate([[0], np.cumsum(n)])[tokens]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                                                  pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(n, pa.int32()))], names=[id_col, "_ids", "_n"])

    schema = T.StructType([df.schema[id_col], T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_n", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, tokens_col).mapInArrow(run, schema)


def encode_subwords(df: DataFrame, vocabulary: DataFrame, id_col: str, tokens_col: str, max_len: int | None = None) -> DataFrame:
    """``(id, input_ids, attention_mask)`` of whole texts, or cut and padded to ``max_len`` for an encoder that has one.

    Ids begin and end with the start and end marks. Texts without tokens, null ones too, are the two marks. ``id_col`` names a row:
    rows of the same id are one text, their tokens by place. Only these meet; all others are encoded where they are.
    """
    shared = shared_pieces(df.sparkSession, vocabulary)
    same = df.groupBy(id_col).agg(F.count("*").alias("_c")).where(F.col("_c") > 1).select(F.col(id_col).alias("_same"))
    same = cut_lineage(same)
    several = same.count()
    if not several:
        ids = segmented_rows(df, shared, id_col, tokens_col).select(id_col, "_ids")
    else:
        small = bounded_broadcast(same, rows=several)
        meets = F.col(id_col).eqNullSafe(F.col("_same"))
        alone = segmented_rows(df.join(small, meets, "left_anti"), shared, id_col, tokens_col).select(id_col, "_ids")
        n = shuffle_partitions(df.sparkSession)
        rows = segmented_rows(df.join(small, meets, "left_semi").repartition(n, id_col), shared, id_col, tokens_col)
        words = rows.select(id_col, "_ids", F.posexplode_outer("_n").alias("_pos", "_k"), F.col("_n").alias("_all"))
        first = F.aggregate(F.slice("_all", 1, F.col("_pos")), F.lit(0), lambda a, x: a + x)
        item = F.when(F.col("_k") > 0, F.struct("_pos", F.slice("_ids", first + 1, F.col("_k")).alias("_ids")))
        together = words.groupBy(id_col).agg(F.flatten(F.array_sort(F.collect_list(item))["_ids"]).alias("_ids"))
        ids = alone.unionByName(together)
    mark = lambda x: F.array(F.lit(x))
    kept = F.col("_ids") if max_len is None else F.slice("_ids", 1, max_len - 2)
    out = ids.withColumn("_ids", F.concat(mark(fv.CLS_ID), kept, mark(fv.SEP_ID)))
    room = F.lit(0) if max_len is None else F.lit(max_len) - F.size("_ids")
    return out.select(id_col, F.concat("_ids", F.array_repeat(F.lit(fv.PAD_ID), room)).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), room)).alias("attention_mask"))


def frequent_pieces(counts: DataFrame, longest: int, least: int) -> DataFrame:
    """A stand-in for a supplied vocabulary: (piece, continues, id) of the parts of up to ``longest`` characters that words hold ``least`` times.

    ``counts`` has (word, n). Parts at a word's start begin words, others go on in them; ids follow the kind and the text.
    """
    size = F.length("word")
    starts = F.explode(F.sequence(F.lit(1), size)).alias("at")
    each = counts.where(size > 0).select("word", "n", starts)
    spans = each.select("word", "n", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("at") + 1))).alias("k"))
    parts = spans.select(F.substring("word", F.col("at"), F.col("k")).alias("piece"), (F.col("at") > 1).alias("continues"), "n")
    kept = cut_lineage(parts.groupBy("continues", "piece").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    ranked = with_positions(kept.select("continues", "piece"), ["continues", "piece"])
    return ranked.select("piece", "continues", (F.col("pos") + fv.FIRST_WORD_ID).cast("int").alias("id"))
