"""Ranked lexical search by accumulator-limited term-at-a-time evaluation (Moffat and Zobel 1996; Buckley and Lewit 1985).

Documents and queries become bags of terms; the score is BM25 in 64-bit integers (``impact`` and ``weight``). The first pass over the texts keeps,
for each document, its length and the counts of terms that some query holds; that posting table is written to the shared folder,
where the statistics (documents, tokens, document frequencies) are gathered from it. Texts are read once.

Each task then inverts its part of the postings in shards of bounded size and evaluates every query on it. Terms are taken
rarest first. While an unseen document could still enter the best ``k``, a term opens an accumulator for each document in its list. Once the
bounds of the terms left, added up, cannot reach the k-th best partial score, no more are opened, and the terms left only update the
survivors, so their final scores are exact. The k best of the shards before give a first threshold. Tasks hand over at most k
rows a query, which meet in two steps.

Queries are taken in blocks of ``QUERY_BLOCK``: one block of term numbers is broadcast, never more. The queries' vocabulary is broadcast while it
has at most ``VOCABULARY`` terms; beyond that the documents' terms meet it in a shuffle join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.llm.common import FOLD_WORDS, bound_batches, fits
from provenance_spark.session import cut_lineage, ensure_checkpoint_dir, workspace_path

#: Documents and postings of one shard: about 100 MB of arrays at most, but for a single longer document.
SHARD_DOCS = 16_384
SHARD_POSTINGS = 2_000_000
QUERY_BLOCK = 4096
VOCABULARY = 500_000
#: Parts into which a query's candidates are dealt before they meet.
DEAL = 32

POSTINGS = "doc_id long, n long, term array<int>, tf array<long>"


def terms(raw: bytes | None) -> list[bytes]:
    """Terms of a text: maximal runs of letters, digits and characters beyond ASCII, only A-Z in lower case."""
    return (raw or b"").translate(FOLD_WORDS).split()


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N+2) / (2df+1))) in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impact(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_tokens: int) -> np.ndarray:
    """A term's part of a score: w * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L."""
    m = 75 + (25 * n * n_docs) // max(1, n_tokens)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def queries_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, term, times)``: the term counts of the items; of items with the same id the least text counts, once."""
    rows = items.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("item")).agg(F.min(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [Counter(terms(t)) for t in b.column(1).to_pylist()]
            sizes = [len(x) for x in bags]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(len(bags)), sizes))), pa.array([t.decode() for x in bags for t in x], pa.string()),
                 pa.array([c for x in bags for c in x.values()], pa.int64())], names=["item", "term", "times"])

    kind = rows.schema["item"].dataType.simpleString()
    return rows.select("item", F.col("text").cast("binary")).mapInArrow(run, f"item {kind}, term string, times long")


def numbered(words: DataFrame) -> DataFrame:
    """``(term, number)``: the distinct terms, numbered from 0 without gaps, in the order of their hashes."""
    kept = words.select("term").distinct().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64)).cast("int"))
    kept = cut_lineage(kept)
    sizes = {r["part"]: r["count"] for r in kept.groupBy("part").count().collect()}  # 64 rows at most
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(64))])
    offset = F.element_at(F.array(*[F.lit(int(s)) for s in starts[:64]]), F.col("part") + 1)
    place = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return cut_lineage(kept.select("term", (offset + place - 1).cast("int").alias("number")))


def postings(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, broadcast: int = VOCABULARY) -> DataFrame:
    """POSTINGS of each document with a term: its length, and the numbers and counts of its terms that stand in ``vocabulary``."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if fits(vocabulary, broadcast):
        known = vocabulary.toArrow()  # checked
        shared = spark.sparkContext.broadcast(dict(zip((t.encode() for t in known.column(0).to_pylist()), known.column(1).to_pylist(), strict=True)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = shared.value
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = terms(text)
                    if words:
                        bag = Counter(map(number.get, words))
                        bag.pop(None, None)
                        rows.append((doc, len(words), list(bag), list(bag.values())))
                yield _batch(rows, pa.int32())

        return texts.mapInArrow(run, POSTINGS)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bag = Counter(terms(text))
                if bag:
                    rows.append((doc, sum(bag.values()), [t.decode() for t in bag], list(bag.values())))
            yield _batch(rows, pa.string())

    whole = texts.mapInArrow(bags, "doc_id long, n long, term array<string>, tf array<long>").withColumn("row", F.monotonically_increasing_id())
    path = workspace_path(spark, "terms")
    whole.write.parquet(path)  # row numbers hold from here on
    whole = spark.read.parquet(path)
    each = whole.select("row", F.explode(F.arrays_zip("term", "tf")).alias("p")).select("row", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))
    known = each.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("number", "tf")).alias("p"))
    return whole.select("row", "doc_id", "n").join(known, "row", "left").select(
        "doc_id", "n", F.coalesce("p.number", F.array().cast("array<int>")).alias("term"), F.coalesce("p.tf", F.array().cast("array<long>")).alias("tf"))


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n", "term", "tf"])


class Best:
    """The k best documents of one query so far: scores falling, equal scores by rising id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


class Shard:
    """Inverted lists of some documents, with each term's greatest impact."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray,
                 n_docs: int, n_tokens: int):
        order = np.argsort(term, kind="stable")
        self.ids, self.of = ids, of[order].astype(np.int32)
        self.value = impact(weights[term], tf, lengths[of], n_docs, n_tokens)[order]
        self.terms, self.start = np.unique(term[order], return_index=True)
        self.stop = np.append(self.start[1:], len(order))
        self.bound = np.maximum.reduceat(self.value, self.start) if len(order) else np.zeros(0, np.int64)
        self.opened = 0  # accumulators, for tests

    def read(self, number: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Evaluate one query, its terms given rarest first."""
        at = np.searchsorted(self.terms, number)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == number) if len(self.terms) else np.zeros(len(number), bool)
        at, times = at[here], times[here]
        if not len(at):
            return
        left = np.append(np.cumsum((self.bound[at] * times)[::-1])[::-1], 0)  # what the terms from here on can add
        acc, open_, creating = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for i, (t, c) in enumerate(zip(at, times, strict=True)):
            docs, value = self.of[self.start[t]:self.stop[t]], self.value[self.start[t]:self.stop[t]] * c
            if creating and self._closed(int(left[i]), acc, open_, best):
                creating = False
            if creating:
                open_[docs] = True
            else:
                live = open_[docs]
                docs, value = docs[live], value[live]
            acc[docs] += value  # a term's list names a document once
        self.opened += int(open_.sum())
        found = np.flatnonzero(open_ & (acc > 0) & (acc >= best.least()))
        if len(found) > best.k:
            least = np.partition(acc[found], len(found) - best.k)[len(found) - best.k]
            found = found[acc[found] >= least]
        best.add(acc[found], self.ids[found])

    @staticmethod
    def _closed(left: int, acc: np.ndarray, open_: np.ndarray, best: Best) -> bool:
        """Whether a document without accumulator must stay below the k-th best partial score (an equal score may still win by its id)."""
        if left < best.least():
            return True
        scores = acc[open_]
        return len(scores) >= best.k and left < scores.max() and left < np.partition(scores, len(scores) - best.k)[len(scores) - best.k]


def search(docs: DataFrame, items: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", broadcast: int = VOCABULARY, block: int = QUERY_BLOCK) -> DataFrame:
    """``(item, rank, doc, score)``: the k best documents of each item with a score above 0, equal scores by rising id.

    Every row of ``docs`` with an id and a term is a document, repeated rows each; null ids take no part, null and empty texts have no
    term. Items with a null id take no part, of items with the same id the least text counts; items without terms, or without documents
    that hold one, have no rows, and neither have empty tables. Other columns don't matter.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ensure_checkpoint_dir(spark)
    asked = cut_lineage(queries_of(items, item_col, item_text))
    vocabulary = numbered(asked)
    path = workspace_path(spark, "postings")
    postings(docs, vocabulary, id_col, text_col, broadcast).write.parquet(path)
    rows = spark.read.parquet(path)
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    n_docs, n_tokens = total["docs"], total["tokens"] or 0
    df = cut_lineage(rows.select(F.explode("term").alias("number")).groupBy("number").agg(F.count("*").alias("df")))
    bags = asked.join(vocabulary, "term").join(df, "number")  # terms that no document holds fall out
    bags = cut_lineage(bags.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("df", "number", "times"))).alias("bag")))
    blocks = max(1, math.ceil(bags.count() / block))
    kind = bags.schema["item"].dataType
    parts = []
    for b in range(blocks):
        got = bags.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        names = got.column("item").combine_chunks()
        asks = [(np.array([t["number"] for t in bag], np.int64), np.array([t["times"] for t in bag], np.int64)) for bag in got.column("bag").to_pylist()]
        held = {t["number"]: t["df"] for bag in got.column("bag").to_pylist() for t in bag}
        own = np.array(sorted(held), np.int64)
        shared = spark.sparkContext.broadcast((names, asks, own, weight(n_docs, np.array([held[t] for t in own.tolist()], np.int64))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asks, own, weights = shared.value
            best = [Best(k) for _ in asks]
            for shard in shards(batches, own, weights, n_docs, n_tokens):
                for (number, times), kept in zip(asks, best, strict=True):
                    shard.read(np.searchsorted(own, number), times, kept)
            sizes = [len(x.ids) for x in best]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.repeat(np.arange(len(asks)), sizes), pa.int64())),
                 pa.array(np.concatenate([x.ids for x in best] or [np.zeros(0, np.int64)]), pa.int64()),
                 pa.array(np.concatenate([x.scores for x in best] or [np.zeros(0, np.int64)]), pa.int64())], names=["item", "doc", "score"])

        parts.append(rows.mapInArrow(run, f"item {kind.simpleString()}, doc long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = [F.desc("score"), F.asc("doc")]
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("doc"), F.lit(DEAL)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "deal").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def shards(batches: Iterator[pa.RecordBatch], own: np.ndarray, weights: np.ndarray, n_docs: int, n_tokens: int) -> Iterator[Shard]:
    """Shards of the task's documents, their postings narrowed to the terms ``own`` (numbered by their place there)."""
    held: list[tuple] = []
    docs = size = 0

    def made() -> Shard:
        ids, lengths, counts, term, tf = (np.concatenate([h[i] for h in held]) for i in range(5))
        return Shard(ids, lengths, np.repeat(np.arange(len(ids)), counts), term, tf, weights, n_docs, n_tokens)

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            b = batch.slice(start, 256)
            counts = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = b.column(3).flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(own, term)
            known = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == term) if len(own) else np.zeros(len(term), bool)
            of = np.repeat(np.arange(b.num_rows), counts)[known]
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), np.bincount(of, minlength=b.num_rows), at[known], tf[known]))
            docs, size = docs + b.num_rows, size + len(of)
            if docs >= SHARD_DOCS or size >= SHARD_POSTINGS:
                yield made()
                held, docs, size = [], 0, 0
    if held:
        yield made()
