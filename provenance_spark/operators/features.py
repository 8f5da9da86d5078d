"""Feature extraction (F1-F6, F12) as shuffled aggregations plus JVM-side vector stages.

TF-IDF (scikit-learn's default weighting): ``w = tf * (ln((1 + n) / (1 + df)) + 1)``, then each row
is scaled to unit L2 norm over the kept terms. The vocabulary keeps terms with ``df >= min_df`` and
then the ``max_features`` terms of highest total count (ties by term); term ids are alphabetical.

Plan shape at scale:

* term counts per document: documents are hash-partitioned by id once (one shuffle of raw text),
  then explode + aggregate + the per-document norm all reuse that partitioning - no further
  shuffle for the transform;
* the vocabulary: document frequency and total count per term with partial aggregation (hot terms
  are combined map-side), then exact top-k and alphabetical ids by range partitioning
  (``operators.positions``), never one task;
* the vocabulary is broadcast only because its size is bounded by ``max_features``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.functions.text import keras_words, ngram_unigrams
from provenance_spark.operators.heavy_hitters import frequent_terms
from provenance_spark.operators.positions import boundary_key, rows_before, with_positions
from provenance_spark.session import checked_broadcast, cut_lineage, shuffle_partitions

MAX_BROADCAST_VOCAB = 1 << 20


def bounded_broadcast(small: DataFrame, rows: int | None = None, limit: int = MAX_BROADCAST_VOCAB) -> DataFrame:
    """Broadcast ``small`` only when its row count is known to be within ``limit``; beyond it the
    join stays a shuffle join. ``rows`` may pass a count already taken."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= limit else small


def doc_term_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 2,
                  keep: tuple = ()) -> DataFrame:
    """F2 as (doc, term) rows: every unigram, then every adjacent pair joined by one space.

    Built without array lambdas: ``arrays_zip`` pairs each token with the next (``null`` after the
    last), and two ``explode``s emit the unigram and the bigram. Both generators and all array
    functions here are code-generated, so this is 5x faster than exploding a ``zip_with`` array.
    """
    u = docs.select(id_col, *keep, ngram_unigrams(F.col(text_col)).alias("_u"))
    if max_n < 2:
        return u.select(id_col, *keep, F.explode("_u").alias("term"))
    nxt = F.slice("_u", 2, F.greatest(F.size("_u") - 1, F.lit(0)))
    pairs = u.select(id_col, *keep, F.explode(F.arrays_zip(F.col("_u").alias("a"), nxt.alias("b"))).alias("_p"))
    both = F.array(F.col("_p.a"), F.concat(F.col("_p.a"), F.lit(" "), F.col("_p.b")))
    return pairs.select(id_col, *keep, F.explode(both).alias("term")).where(F.col("term").isNotNull())


def doc_term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 2,
                    keep: tuple = (), num_partitions: int | None = None) -> DataFrame:
    """(doc, [keep], term, tf). Documents are hash-partitioned by id **before** tokenising: only the
    text crosses the network (the exploded n-grams are larger), and the per-document count, norms
    and regrouping then need no further shuffle."""
    n = num_partitions or shuffle_partitions(docs.sparkSession)
    rows = doc_term_rows(docs.repartition(n, id_col), id_col, text_col, max_n, keep)
    return rows.groupBy(id_col, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(tf: DataFrame, n_docs: int, min_df: int = 1, max_features: int | None = None,
                   id_col: str = "doc_id", capacity: int | None = None) -> DataFrame:
    """(term, df, cf, term_id, idf) for the kept terms.

    With ``capacity``, summaries of that many terms a task find the candidates first and only these are counted
    (``operators.heavy_hitters``): a second pass over ``tf`` for a shuffle that doesn't grow with the distinct terms.
    """
    if capacity is not None:
        tf = frequent_terms(tf, min_df, max_features, capacity)
    stats = (tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
             .where(F.col("df") >= min_df))
    # one row per kept term; the exact top-k and the term ids below each run jobs over it, which
    # would otherwise re-run tokenising and counting every time
    stats = cut_lineage(stats)
    if max_features is not None:
        last = boundary_key(stats, ["cf", "term"], max_features, descending=["cf"])
        stats = rows_before(stats, ["cf", "term"], last, descending=["cf"])
    vocab = with_positions(stats.select("term", "df", "cf"), ["term"], pos_col="term_id")
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return vocab.withColumn("idf", idf)


def tfidf_long(tf: DataFrame, vocab: DataFrame, id_col: str = "doc_id", digits: int | None = 6) -> DataFrame:
    """F1 transform in long form: (doc, term_id, weight), unit L2 norm per document."""
    v = bounded_broadcast(vocab.select("term", "term_id", "idf"))  # within max_features when set
    return unit_weights(tf.join(v, "term"), id_col, digits)


def unit_weights(tf: DataFrame, id_col: str, digits: int | None) -> DataFrame:
    """(doc, term_id, weight) of rows with ``tf`` and ``idf``, unit L2 norm per document."""
    w = tf.withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    weight = F.col("_w") / norm
    if digits is not None:
        weight = F.round(weight, digits)
    return w.select(id_col, "term_id", weight.alias("weight"))


def tfidf_weights(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int | None = 6) -> DataFrame:
    """F1 from texts in long form: :func:`tfidf_long` of their term counts.

    Terms get their ids before they are counted, so only kept terms are counted, by numbers instead of strings.
    """
    n = shuffle_partitions(docs.sparkSession)
    v = bounded_broadcast(vocab.select("term", "term_id", "idf"))  # within max_features when set
    rows = doc_term_rows(docs.repartition(n, id_col), id_col, text_col).join(v, "term")
    tf = rows.groupBy(id_col, "term_id").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    return unit_weights(tf, id_col, digits)


def tfidf_vector_stages(vocab_rows: list, input_col: str = "terms", output_col: str = "features"):
    """F1 as JVM-side ML stages over a fitted vocabulary: counts -> x idf -> L2 normalise.

    ``vocab_rows`` are (term, term_id, idf) rows collected from :func:`fit_vocabulary` (bounded by
    ``max_features``). The stages are row-local: scoring a table never shuffles.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import DenseVector

    if len(vocab_rows) > MAX_BROADCAST_VOCAB:
        raise ValueError("vocabulary larger than the broadcast bound")
    ordered = sorted(vocab_rows, key=lambda r: r["term_id"])
    cv = CountVectorizerModel.from_vocabulary([r["term"] for r in ordered], inputCol=input_col,
                                              outputCol="_tf")
    scale = ElementwiseProduct(scalingVec=DenseVector([float(r["idf"]) for r in ordered]),
                               inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=output_col)
    return [cv, scale, norm]


def sparse_vectors(rows: DataFrame, dim: int, idx: str = "idx", val: str = "val", output_col: str = "features") -> DataFrame:
    """Rows of sorted ids and weights as sparse ML vectors of ``dim`` numbers; nothing of the vocabulary is needed any more."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    made = F.udf(lambda i, v: Vectors.sparse(dim, i, v), VectorUDT())
    return rows.withColumn(output_col, made(idx, val)).drop(idx, val)


# ---------------------------------------------------------------- F4-F6 (sequence features)


def fit_sequence_vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            num_words: int | None = 2000) -> DataFrame:
    """word index of a Keras-style tokenizer: id 1 = OOV, then by falling count, ties by first
    appearance (document order, then position). Keeps ids below ``num_words``."""
    n_parts = shuffle_partitions(docs.sparkSession)
    words = (docs.repartition(n_parts, id_col)
             .select(id_col, F.posexplode(keras_words(F.col(text_col))).alias("_pos", "word")))
    # Two hash aggregates instead of min(struct(doc, pos)), whose struct buffer forces a sort-based
    # aggregate over every word occurrence. (word, doc) groups need no shuffle (documents are
    # hash-partitioned by id); after them (word, doc) is unique, so min_by picks exactly the first
    # position in the first document.
    per_doc = words.groupBy("word", id_col).agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_p"))
    stats = per_doc.groupBy("word").agg(
        F.sum("_c").alias("n"), F.min(id_col).alias("first_doc"),
        F.min_by("_p", F.col(id_col)).alias("first_pos"))
    if num_words is not None:
        # exact top (num_words - 2) first: ranking then touches a bounded table
        order = ["n", "first_doc", "first_pos"]
        stats = cut_lineage(stats)  # one row per distinct word; the jobs below reuse it
        stats = rows_before(stats, order, boundary_key(stats, order, num_words - 2, descending=["n"]), descending=["n"])
    ranked = with_positions(stats, ["n", "first_doc", "first_pos"], descending=["n"])
    if num_words is not None:
        ranked = ranked.where(F.col("pos") < num_words - 2)
    return ranked.select("word", "n", (F.col("pos") + 2).alias("id"))


def text_to_sequence(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", words_col: str = "words",
                     oov_id: int = 1, num_partitions: int | None = None) -> DataFrame:
    """(doc, seq) with word -> id, unknown (or cut) words -> OOV, in word order.

    Documents are hash-partitioned by id once; the vocabulary (bounded by ``num_words``) is
    broadcast, so the lookup is a hash join and regrouping the words of a document needs no
    further shuffle. Documents without words get an empty sequence.
    """
    n = num_partitions or shuffle_partitions(docs.sparkSession)
    words = (docs.repartition(n, id_col)
             .select(id_col, F.posexplode_outer(words_col).alias("_pos", "word")))
    v = bounded_broadcast(vocab.select("word", F.col("id").alias("_id")))  # within num_words when set
    item = F.when(F.col("word").isNotNull(),
                  F.struct(F.col("_pos"), F.coalesce(F.col("_id"), F.lit(oov_id)).alias("_id")))
    grouped = words.join(v, "word", "left").groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return grouped.select(id_col, F.col("_items._id").alias("seq"))  # field of each element, no lambda


def lemmatize_join(docs: DataFrame, lemmas: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """T6 for a lemma table of any size: ``lemmas`` has (word, lemma), one row per form that changes.

    A table within the broadcast bound is joined as it is, so the tokens are made once. Beyond it each distinct token is looked up once
    by a shuffle join, and the found forms go back to the documents. These are hash-partitioned by id before their tokens are taken apart.
    """
    n = shuffle_partitions(docs.sparkSession)
    words = docs.repartition(n, id_col).select(id_col, F.posexplode_outer(tokens_col).alias("_pos", "word"))
    table = cut_lineage(lemmas.select("word", "lemma"))
    if table.count() <= MAX_BROADCAST_VOCAB:
        used = F.broadcast(table)
    else:
        used = docs.select(F.explode(tokens_col).alias("word")).distinct().join(table, "word")
        used = checked_broadcast(used, MAX_BROADCAST_VOCAB)
    item = F.when(F.col("word").isNotNull(), F.struct("_pos", F.coalesce("lemma", "word").alias("_w")))
    grouped = words.join(used, "word", "left").groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return grouped.select(id_col, F.col("_items._w").alias(tokens_col))


def pad_sequence(seq, maxlen: int = 100, value: int = 0):
    """keep the last ``maxlen`` ids (truncating at the front), pad after with ``value``."""
    n = F.size(seq)
    kept = F.slice(seq, F.greatest(n - (maxlen - 1), F.lit(1)), maxlen)
    return F.concat(kept, F.array_repeat(F.lit(value), F.lit(maxlen) - F.least(n, F.lit(maxlen))))


def idf_value(n_docs: int, df: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1.0
