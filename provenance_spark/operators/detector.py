"""The detector end to end: features for the prepared corpus, and scoring texts.

``hidden_features`` is the batch path of the original pipeline (pre-tokens -> encoder -> one vector
per text); ``tfidf_arrays`` gives sparse TF-IDF rows for the linear baselines.
``DetectorModel`` scores whole DataFrames (batch or streaming): pre-tokens -> vector -> head
-> probability -> class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenance_spark.functions import fixed_values as fv
from provenance_spark.functions.text import encoder_pre_tokens, normalize_newlines
from provenance_spark.operators import features as ft
from provenance_spark.operators import word_vectors as wv
from provenance_spark.operators.heads import RidgeModel, check_head
from provenance_spark.session import cut_lineage

DIM = 64


def class_label(proba: Column, threshold: float = fv.DECISION_THRESHOLD) -> Column:
    """P10: strictly above the threshold is machine-written."""
    return F.when(proba > threshold, F.lit(fv.AI_CLASS)).otherwise(F.lit(fv.HUMAN_CLASS))


def sigmoid(x: Column, k: float = 1.0) -> Column:
    """G3 pseudo-probability ``1 / (1 + e^(-k·x))``; k = 2 gives e^d / (e^-d + e^d) without ∞/∞."""
    return 1.0 / (1.0 + F.exp(-k * x))


def fit_encoder(train: DataFrame, text_col: str = "text", dim: int = DIM):
    """Word vectors trained on the texts of the train split."""
    toks = train.select(encoder_pre_tokens(normalize_newlines(F.col(text_col))).alias("_tokens"))
    return wv.fit_word_vectors(cut_lineage(toks), "_tokens", dim)


def hidden_features(df: DataFrame, encoder, text_col: str = "text") -> DataFrame:
    """F8 over a whole table and whole texts: ``hidden_state`` array<double> per row (no shuffle)."""
    toks = df.withColumn("_tokens", encoder_pre_tokens(normalize_newlines(F.col(text_col))))
    return wv.mean_vectors(toks, encoder, "_tokens").drop("_tokens")


def tfidf_arrays(df: DataFrame, id_col: str = "id", text_col: str = "text", keep=("split", "AI"),
                 min_df: int = 5, max_features: int = 1 << 18, fit_split: str = "train") -> tuple[DataFrame, int]:
    """Sparse TF-IDF rows (``idx`` array<int>, ``val`` array<double>) with the vocabulary fitted on
    ``fit_split``. Rows are hash-partitioned by id once; counting, weighting, normalising and
    regrouping all reuse that partitioning."""
    tf = cut_lineage(ft.doc_term_counts(df.select(id_col, *keep, text_col), id_col, text_col, keep=tuple(keep)))
    fit_tf = tf.where(F.col("split") == fit_split).select(id_col, "term", "tf")
    n_docs = df.where(F.col("split") == fit_split).count()
    vocab = ft.fit_vocabulary(fit_tf, n_docs, min_df=min_df, max_features=max_features, id_col=id_col)
    dim = vocab.count()
    v = ft.bounded_broadcast(vocab.select("term", "term_id", "idf"), rows=dim)
    w = tf.join(v, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    from pyspark.sql import Window
    w = w.withColumn("_w", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col))))
    rows = (w.groupBy(id_col, *keep)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("i"), "_w"))).alias("_e")))
    # documents without any kept term keep an empty row
    every = df.select(id_col, *keep).join(rows.drop(*keep), id_col, "left")
    idx = F.coalesce(F.col("_e.i"), F.array().cast("array<int>"))
    val = F.coalesce(F.col("_e._w"), F.array().cast("array<double>"))
    return every.select(id_col, *keep, idx.alias("idx"), val.alias("val")), dim


@dataclass
class DetectorModel:
    """G1: everything needed to score text - word vectors and head."""
    encoder: object
    head: str
    model: object
    ridge_k: float = 2.0

    def __post_init__(self):
        check_head(self.head)

    def transform(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        feats = hidden_features(df, self.encoder, text_col)
        if self.head == "ridge":
            assert isinstance(self.model, RidgeModel)
            proba = sigmoid(self.model.decision(F.col("hidden_state")), self.ridge_k)
            out = feats.withColumn("_proba", proba)
        else:
            from pyspark.ml.functions import array_to_vector
            scored = self.model.transform(feats.withColumn("features", array_to_vector("hidden_state")))
            out = scored.withColumn("_proba", vector_to_array("probability")[1]).drop(
                "features", "rawPrediction", "probability", "prediction")
        # Spark resolves names case-insensitively: the output names are added last
        return (out.drop("hidden_state").withColumn("Prediction", class_label(F.col("_proba")))
                .withColumnRenamed("_proba", "Probability"))


def class_scores(padded: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Scores of each class for a padded id sequence; ``weights[c][id]`` counts once for each place, padding for nothing."""
    ids = F.filter(padded, lambda i: i != 0)

    def total(w: Sequence[float], b: float) -> Column:
        table = F.lit([float(x) for x in w])
        return F.aggregate(ids, F.lit(float(b)), lambda acc, i: acc + F.element_at(table, i.cast("int") + 1))

    return F.array(*[total(w, b) for w, b in zip(weights, bias)])


def argmax(scores: Column) -> Column:
    """Position of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sequence_predict(padded: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], col: str = "padded") -> DataFrame:
    """``padded`` with ``scores`` and ``class``; every row is scored where it is, nothing shuffles."""
    scored = padded.withColumn("scores", class_scores(F.col(col), weights, bias))
    return scored.withColumn("class", argmax(F.col("scores")))


def fixed_weights(dim: int) -> list[float]:
    """Deterministic weights for oracle-checkable scoring of the ``embeddings`` table."""
    return [float(((i * 7) % 11 - 5) / 10.0) for i in range(dim)]


def dot(array_col: Column, weights: list[float]) -> Column:
    w = F.lit(weights)
    return F.aggregate(F.zip_with(array_col, w, lambda a, b: a.cast("double") * b), F.lit(0.0),
                       lambda acc, x: acc + x)
