"""Training, selection and scoring queries.

Heads train on the prepared corpus (``prepare_datasets``) with frozen-encoder vectors, the way the
original detector does; the algebraic scoring queries use fixed weights on ``embeddings`` so SQL
can check them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators import detector as det
from provenance_spark.operators import features as ft
from provenance_spark.operators import booster, dense, heads, metrics, sgd, word_vectors
from provenance_spark.operators.splits import prepare_datasets
from provenance_spark.plans.corpus_queries import load_corpus
from provenance_spark.plans.registry import query
from provenance_spark.session import cut_lineage, ensure_checkpoint_dir
from provenance_spark.sources.materialize import cache_key, is_complete, materialize
from provenance_spark.sources.registry import ModelRegistry
from provenance_spark.sources.tables import read_table


#: The forests of ``extra_heads``; the operator's defaults are the published grid.
FOREST_TREES, FOREST_DEPTHS = (20, 50, 100), (3, 5, 8, 12)
DIM = 64
W_FIXED = det.fixed_weights(DIM)
B_FIXED = 0.05


def stages(spark) -> str:
    """The folder of stages that are made once for the same rows and read by all heads."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages"


def corpus_key(corpus) -> tuple[int, str]:
    """Number and digest of a corpus' rows: the key of what is made from it."""
    at = corpus.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "split", "version", "text").cast("decimal(38,0)")).alias("h")).first()
    return at["n"], cache_key(at["h"], at["n"])


def encoder_key(key: str) -> str:
    """The key of what word vectors give: the corpus and the vectors' parameters."""
    return cache_key(key, det.DIM, word_vectors.BUCKETS, word_vectors.CONTEXTS, word_vectors.WINDOW, word_vectors.OWN)


def prepared(spark, sf_dir):
    """The flagship prepared set, written once for its corpus."""
    corpus = load_corpus(spark, sf_dir)
    return materialize(spark, stages(spark), cache_key("prepared", corpus_key(corpus)[1]), lambda: prepare_datasets(corpus))


def hidden_prepared(spark, sf_dir):
    """The prepared set with its vectors, and the word vectors trained on its train split, both made once."""
    key = encoder_key(corpus_key(load_corpus(spark, sf_dir))[1])
    p = prepared(spark, sf_dir)
    path = f"{stages(spark)}/{cache_key('vectors', key)}"
    if not is_complete(spark, path):
        det.fit_encoder(p.where(F.col("split") == "train")).save(spark, path)
    encoder = word_vectors.WordVectors.load(spark, path)

    def build():
        return heads.as_vectors(det.hidden_features(p.select("id", "split", "version", "AI", "text"), encoder).drop("text"), "hidden_state")

    return materialize(spark, stages(spark), cache_key("hidden", key), build), encoder


def tfidf_prepared(spark, sf_dir):
    """The prepared set as sparse TF-IDF rows (``y`` the class) and their width, made once."""
    key = corpus_key(load_corpus(spark, sf_dir))[1]
    path = f"{stages(spark)}/{cache_key('tfidf', key)}"
    if not is_complete(spark, f"{path}/width"):
        rows, dim = det.tfidf_arrays(prepared(spark, sf_dir).select("id", "split", "AI", "text"))
        rows.withColumnRenamed("AI", "y").write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).select(F.lit(dim).alias("dim")).write.mode("overwrite").parquet(f"{path}/width")
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/width").first()["dim"]


def _splits(df):
    return [df.where(F.col("split") == s) for s in ("train", "valid", "test")]


@query("head_logistic", "M1 M4")
def q_head_logistic(spark, sf_dir):
    h, _ = hidden_prepared(spark, sf_dir)
    return heads.logistic_head(*_splits(h)).to_df(spark)


@query("head_ridge", "M2 M4")
def q_head_ridge(spark, sf_dir):
    h, _ = hidden_prepared(spark, sf_dir)
    return heads.ridge_head(h, "hidden_state").to_df(spark)


def _emb_split() -> str:
    return "CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'valid' ELSE 'test' END"


@query("ridge_statistics", "M2", lambda: f"""
WITH z AS (SELECT {_emb_split()} AS split, list_concat([1.0, CASE WHEN label >= 5 THEN 1.0 ELSE -1.0 END],
                  list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS z FROM embeddings),
p AS (SELECT i, j FROM range({DIM + 2}) a(i), range({DIM + 2}) b(j) WHERE i <= 1 AND j >= i AND NOT (i = 1 AND j = 1) OR i > 1 AND j > 1)
SELECT split, i, j, round(sum(z[i + 1] * z[j + 1]), 6) + 0.0 AS v FROM z, p GROUP BY split, i, j""")
def q_ridge_statistics(spark, sf_dir):
    """The moments ridge is solved from: of 1, the target and the features, for each split."""
    emb = read_table(spark, sf_dir, "embeddings").select(
        "embedding", (F.col("label") >= 5).cast("int").alias("AI"), F.expr(_emb_split()).alias("split"))
    rows = []
    for split, vec in heads.ridge_statistics(emb, "embedding").items():
        n, sy, sx, xty, xtx = heads._unpack(vec)
        rows += [(split, 0, 0, float(n)), (split, 0, 1, float(sy))]
        rows += [(split, 0, d + 2, float(x)) for d, x in enumerate(sx)] + [(split, 1, d + 2, float(x)) for d, x in enumerate(xty)]
        rows += [(split, d + 2, e + 2, float(xtx[d, e])) for d in range(len(sx)) for e in range(len(sx))]
    out = spark.createDataFrame(rows, "split string, i long, j long, v double")
    return out.withColumn("v", F.round("v", 6) + F.lit(0.0))


@query("head_dense", "M3 M8 M4")
def q_head_dense(spark, sf_dir):
    h, _ = hidden_prepared(spark, sf_dir)
    tr, va, te = _splits(h)
    a = dense.adam_head(tr, va, te, hidden=(64, 64), head="nn").to_df(spark)
    b = dense.adam_head(tr, va, te, hidden=(8, 8), dropout=0.0, patience=2, epochs=10, head="nn_small").to_df(spark)
    return a.unionByName(b)


@query("extra_heads", "M9 M10 M11")
def q_extra_heads(spark, sf_dir):
    h, _ = hidden_prepared(spark, sf_dir)
    tr, va, te = _splits(h)
    out = heads.svc_head(tr, va, te).to_df(spark)
    forest = heads.forest_head(tr, va, te, trees=FOREST_TREES, depths=FOREST_DEPTHS)
    out = out.unionByName(forest.to_df(spark))
    return out.unionByName(booster.booster_head(tr, va, te, "hidden_state").to_df(spark))


@query("tfidf_logistic", "M5 F1 F3")
def q_tfidf_logistic(spark, sf_dir):
    """The stored TF-IDF rows carry their term ids from a join, so no vocabulary meets the driver."""
    rows, dim = tfidf_prepared(spark, sf_dir)
    vec = cut_lineage(ft.sparse_vectors(rows.withColumnRenamed("y", "AI"), dim).select("id", "split", "AI", "features"))
    return heads.logistic_head(*_splits(vec), c_grid=fv.TFIDF_LR_C_GRID, penalize_intercept=True).to_df(spark)


@query("sequence_logistic", "M7 T7 F4 F5 F6")
def q_sequence_logistic(spark, sf_dir):
    from pyspark.ml.feature import CountVectorizerModel

    from provenance_spark.functions.text import keras_words, with_clean_text
    p = prepared(spark, sf_dir)
    cleaned = with_clean_text(p.select("id", "split", "AI", "text"), "text", "text", remove_stopword=True, lemmatize=True)
    vocab = ft.fit_sequence_vocabulary(cleaned.where(F.col("split") == "train"), id_col="id", num_words=2000)
    seq = ft.text_to_sequence(cleaned.select("id", keras_words(F.col("text")).alias("words")), vocab, id_col="id")
    padded = seq.select("id", ft.pad_sequence(F.col("seq"), 100).alias("padded"))
    ids = padded.select("id", F.transform(F.filter("padded", lambda x: x != 0), lambda x: x.cast("string")).alias("ids"))
    cv = CountVectorizerModel.from_vocabulary([str(i) for i in range(1, 2000)], inputCol="ids", outputCol="features")
    data = cut_lineage(cv.transform(ids.join(cleaned.select("id", "split", "AI"), "id")))
    return heads.logistic_head(*_splits(data), c_grid=(1.0,)).to_df(spark)


@query("sgd_sweep", "M6 X1 A10 D3")
def q_sgd_sweep(spark, sf_dir):
    rows, dim = tfidf_prepared(spark, sf_dir)
    train = rows.where(F.col("split") == "train").orderBy(F.md5(F.concat(F.lit("1:"), F.col("id").cast("string"))))
    W, b, _ = sgd.mixed_sgd(train, dim)
    ev = sgd.evaluate(rows, W, b)
    wide = ev.groupBy("loss").agg(
        F.max(F.when(F.col("split") == "valid", F.col("accuracy"))).alias("valid_accuracy"),
        F.max(F.when(F.col("split") == "test", F.col("accuracy"))).alias("test_accuracy"),
        F.max(F.when(F.col("split") == "train", F.col("mean_loss"))).alias("train_loss"))
    return wide.withColumn("mean_accuracy", (F.col("valid_accuracy") + F.col("test_accuracy")) / 2)


# ---------------------------------------------------------------- oracle-checkable scoring


def _w_sql() -> str:
    return "[" + ", ".join(repr(x) for x in W_FIXED) + "]::DOUBLE[]"


def _f_sql() -> str:
    return (f"list_reduce(list_transform(range(1, len(embedding) + 1), "
            f"lambda i: CAST(embedding[i] AS DOUBLE) * ({_w_sql()})[i]), lambda a, b: a + b) + {B_FIXED}")


def _scores(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    f = det.dot(F.col("embedding"), W_FIXED) + F.lit(B_FIXED)
    y = F.when(F.col("label") >= 5, 1.0).otherwise(-1.0)
    return emb.select("vec_id", f.alias("f"), y.alias("y"))


@query("margin_losses", "X1", lambda: f"""
WITH s AS (SELECT vec_id, ({_f_sql()}) * CASE WHEN label >= 5 THEN 1.0 ELSE -1.0 END AS m FROM embeddings)
SELECT vec_id, round(m, 6) AS margin,
       round(greatest(0.0, 1.0 - m), 6) AS hinge,
       round(ln(1.0 + exp(-m)), 6) AS log_loss,
       round(CASE WHEN m >= -1.0 THEN pow(greatest(0.0, 1.0 - m), 2) ELSE -4.0 * m END, 6) AS modified_huber,
       round(pow(greatest(0.0, 1.0 - m), 2), 6) AS squared_hinge,
       round(greatest(0.0, -m), 6) AS perceptron
FROM s""")
def q_margin_losses(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("m", F.col("f") * F.col("y"))
    return s.select("vec_id", F.round("m", 6).alias("margin"),
                    *[F.round(sgd.margin_loss(l, F.col("m")), 6).alias(l) for l in fv.SGD_LOSSES])


def _slope_sql() -> dict[str, str]:
    return {"hinge": "CASE WHEN m <= 1.0 THEN -1.0 ELSE 0.0 END",
            "log_loss": "-1.0 / (exp(m) + 1.0)",
            "modified_huber": "CASE WHEN m >= 1.0 THEN 0.0 WHEN m >= -1.0 THEN -2.0 * (1.0 - m) ELSE -4.0 END",
            "squared_hinge": "CASE WHEN m < 1.0 THEN -2.0 * (1.0 - m) ELSE 0.0 END",
            "perceptron": "CASE WHEN m <= 0.0 THEN -1.0 ELSE 0.0 END"}


@query("loss_gradients", "M1 M6 X1", lambda: f"""
WITH s AS (SELECT list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [1.0::DOUBLE]) AS x,
                  CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, {_f_sql()} AS f FROM embeddings),
g AS (SELECT generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v, y, f * y AS m FROM s)
SELECT CAST(dim AS INTEGER) AS dim, {", ".join(f"round(avg(CAST({e} AS DOUBLE) * y * v), 6) + 0.0 AS {loss}" for loss, e in _slope_sql().items())}
FROM g GROUP BY dim""")
def q_loss_gradients(spark, sf_dir):
    """Gradients of the five losses at fixed weights: one full-batch step of M1 (log loss) and M6."""
    emb = read_table(spark, sf_dir, "embeddings")
    f = det.dot(F.col("embedding"), W_FIXED) + F.lit(B_FIXED)
    g = sgd.loss_gradients(emb, "embedding", f, F.when(F.col("label") >= 5, 1.0).otherwise(-1.0))
    return g.select("dim", *[(F.round(loss, 6) + F.lit(0.0)).alias(loss) for loss in fv.SGD_LOSSES])


@query("ridge_probability", "G3 P10", lambda: f"""
WITH s AS (SELECT vec_id, {_f_sql()} AS d FROM embeddings)
SELECT vec_id, round(d, 6) AS decision,
       round(1.0 / (1.0 + exp(-2.0 * d)), 6) AS proba,
       round(1.0 / (1.0 + exp(-1.0 * d)), 6) AS proba_k1,
       CASE WHEN 1.0 / (1.0 + exp(-2.0 * d)) > 0.5 THEN '{fv.AI_CLASS}' ELSE '{fv.HUMAN_CLASS}' END AS prediction
FROM s""")
def q_ridge_probability(spark, sf_dir):
    s = _scores(spark, sf_dir)
    p2 = det.sigmoid(F.col("f"), 2.0)
    return s.select("vec_id", F.round("f", 6).alias("decision"), F.round(p2, 6).alias("proba"),
                    F.round(det.sigmoid(F.col("f"), 1.0), 6).alias("proba_k1"),
                    det.class_label(p2).alias("prediction"))


@query("predict_label", "P10 G2", lambda: f"""
WITH s AS (SELECT vec_id, {_f_sql()} AS f FROM embeddings)
SELECT vec_id, round(1.0 / (1.0 + exp(-f)), 6) AS Probability,
       CASE WHEN 1.0 / (1.0 + exp(-f)) > 0.5 THEN '{fv.AI_CLASS}' ELSE '{fv.HUMAN_CLASS}' END AS Prediction
FROM s""")
def q_predict_label(spark, sf_dir):
    p = det.sigmoid(F.col("f"))
    return _scores(spark, sf_dir).select("vec_id", F.round(p, 6).alias("Probability"),
                                         det.class_label(p).alias("Prediction"))


# ---------------------------------------------------------------- batch scoring


def trained_detector(spark, sf_dir, head: str = "lr", root: str | None = None) -> det.DetectorModel:
    """The stored detector of these tables and this head if it is complete; else train, gate and store one.

    A new model is stored only when its test score beats the best so far (S12). ``root`` is the
    registry's folder, by default below the shared checkpoint folder.
    """
    det.check_head(head)
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry"
    registry = ModelRegistry(spark, root)
    n, ckpt = corpus_key(load_corpus(spark, sf_dir))  # which rows the model was trained on
    ckpt = encoder_key(ckpt)
    h, encoder = hidden_prepared(spark, sf_dir)
    if registry.has_model(head, ckpt, n):
        return det.DetectorModel(encoder, head, registry.load(head, ckpt, n))
    tr, va, te = _splits(h)
    if head == "ridge":
        found = heads.ridge_head(h, "hidden_state")
    elif head == "nn":
        found = dense.adam_head(tr, va, te)
    else:
        found = heads.logistic_head(tr, va, te)
    score = next(p.test_accuracy for p in found.points if p.chosen)
    registry.record(head, ckpt, n, score, found.model)
    return det.DetectorModel(encoder, head, found.model)


@query("score_batch", "G1 G2 G4 P4 P10 S11 S12")
def q_score_batch(spark, sf_dir):
    model = trained_detector(spark, sf_dir, "lr")
    texts = read_table(spark, sf_dir, "conversations").where(F.col("role") != "system")
    texts = texts.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return model.transform(texts).select("id", F.round("Probability", 6).alias("Probability"), "Prediction")


@query("head_by_version", "A12 G1 G4")
def q_head_by_version(spark, sf_dir):
    """The trained detector's accuracy on each generator's texts."""
    model = trained_detector(spark, sf_dir, "lr")
    rows = prepare_datasets(load_corpus(spark, sf_dir)).where(F.col("split") != "train")
    scored = model.transform(rows.select("id", "split", "version", "AI", "text"))
    pred = (F.col("Prediction") == fv.AI_CLASS).cast("int")
    return metrics.accuracy(scored.withColumn("pred", pred), "AI", "pred", ["split", "version"])
