"""Text functions (T1-T8) and features (F1-F7, F12) on small literal inputs and fixture tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from provenance_spark.functions import text as tx
from provenance_spark.operators import features as ft


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first()["x"]


def test_clean_basic(spark):
    assert one(spark, tx.clean_basic(F.col("text")), "Hello, World! 42 times²") == "hello world  times"


def test_word_tokens_contractions(spark):
    got = one(spark, tx.word_tokens(F.col("text")), "we cannot gonna Cannot xcannot cannotx go\twanna")
    assert got == ["we", "can", "not", "gon", "na", "Can", "not", "xcannot", "cannotx", "go", "wan", "na"]


def test_stopwords_keep_duplicates_and_order(spark):
    got = one(spark, tx.remove_stopwords(F.split(F.col("text"), " ")), "the cat and the cat sat")
    assert got == ["cat", "cat", "sat"]


def test_staged_clean_equals_column_clean(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    a = {r[0]: r[1] for r in df.select("doc_id", tx.clean_text(F.col("text")).alias("c")).collect()}
    b = {r[0]: r[1] for r in tx.with_clean_text(df, "text", "c").select("doc_id", "c").collect()}
    assert a == b


def test_strip_removes_all_unicode_space(spark):
    assert one(spark, tx.strip_spaces(F.col("text")), "　 \t x y \n") == "x y"


def test_newline_and_length(spark):
    df = spark.createDataFrame([("a\nb\n\nc",)], "text string")
    r = df.select(tx.normalize_newlines(F.col("text")).alias("t")).select("t", tx.text_length(F.col("t")).alias("n")).first()
    assert r["t"] == "a b  c" and r["n"] == 6


@pytest.mark.parametrize("n", [0, 2, 99, 100, 105])
def test_pad_sequence_length_and_front_truncation(spark, n):
    seq = list(range(1, n + 1))
    got = spark.createDataFrame([(seq,)], "s array<int>").select(ft.pad_sequence(F.col("s"), 100).alias("p")).first()["p"]
    assert len(got) == 100
    want = (seq[-100:] + [0] * 100)[:100]
    assert got == want


def test_idf_formula():
    assert ft.idf_value(10, 3) == pytest.approx(math.log(11 / 4) + 1)


def test_tfidf_rows_have_unit_norm(spark):
    import __spark_entry__ as entry
    w = entry.queries()["tfidf_weights"](spark, SF_SMALL)
    weight_col = [c for c in w.columns if c not in ("doc_id", "term", "term_id")][0]
    norms = w.groupBy("doc_id").agg(F.sum(F.col(weight_col) * F.col(weight_col)).alias("s")).collect()
    assert norms and all(abs(r["s"] - 1.0) < 1e-4 for r in norms)


def test_ngrams_unigrams_then_bigrams(spark):
    got = one(spark, tx.ngram_terms(F.col("text")), "The cat, a dog_2 sat")
    assert got == ["the", "cat", "dog_2", "sat", "the cat", "cat dog_2", "dog_2 sat"]


def test_keras_words(spark):
    got = one(spark, tx.keras_words(F.col("text")), "Hello, world!  It's\tme")
    assert got == ["hello", "world", "it's", "me"]


def test_quotation_marks_are_tokens_of_their_own(spark):
    df = spark.createDataFrame([("“cannot” say «oui» it’s",)], "t string")
    assert df.select(tx.word_tokens(F.col("t"))).first()[0] == ["“", "can", "not", "”", "say", "«", "oui", "»", "it", "’", "s"]


def test_large_lemma_table_is_joined(spark):
    lemmas = spark.range(200_000).selectExpr("concat('w', id) AS word", "concat('l', id) AS lemma")
    d = spark.createDataFrame([(1, ["w5", "x", "w199999", "w5"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["tokens"] for r in ft.lemmatize_join(d, lemmas).collect()}
    assert got == {1: ["l5", "x", "l199999", "l5"], 2: [], 3: []}


def test_word_pieces_of_whole_texts(spark):
    from provenance_spark.functions import fixed_values as fv
    from provenance_spark.operators import encode as enc
    vocab = {"un": 7, "##able": 8, "##do": 9, "x": 10}
    d = spark.createDataFrame([(["undoable", "zzz"] + ["x"] * 300,), ([],)], "tokens array<string>")
    a, b = (r["input_ids"] for r in enc.encode(d, "tokens", vocab).collect())
    assert a == [fv.CLS_ID, 7, 9, 8, fv.UNK_ID] + [10] * 300 + [fv.SEP_ID] and b == [fv.CLS_ID, fv.SEP_ID]


def test_hidden_state_is_the_mean_over_all_tokens(spark):
    import numpy as np

    from provenance_spark.operators import word_vectors as wv
    words = ["alpha", "beta", "gamma", "delta"] * 40
    rows = [(1, words), (2, words[:70] + ["delta"] * 200), (3, words[:70] + ["beta"] * 200), (4, []), (5, None)]
    d = spark.createDataFrame(rows, "id long, tokens array<string>")
    model = wv.fit_word_vectors(d, "tokens", dim=8)
    ids = {r["t"]: r["b"][0] for r in spark.createDataFrame([(w,) for w in words[:4]], "t string").withColumn(
        "b", wv.bucket_ids(F.array("t"), wv.BUCKETS)).collect()}
    got = {r["id"]: np.array(r["hidden_state"]) for r in wv.mean_vectors(d, model, "tokens").collect()}
    for i, tokens in rows[:3]:
        assert np.allclose(got[i], np.mean([model.table[ids[w]] for w in tokens], axis=0), atol=1e-9)
    assert not np.allclose(got[2], got[3]) and not got[4].any() and not got[5].any()  # tokens past position 64 count


def test_word_vectors_equal_the_exact_factorisation(spark):
    import numpy as np

    from provenance_spark.operators import word_vectors as wv
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [[words[(s + int(k)) % 60] for k in rng.integers(0, 6, 30)] for s in rng.integers(0, 60, 80)]
    d = spark.createDataFrame([(t,) for t in texts] + [([],), (None,), (["w1"],)], "tokens array<string>")
    buckets, contexts, dim = 256, 32, 8
    ids = [r["b"] for r in d.select(wv.bucket_ids(F.col("tokens"), buckets).alias("b")).collect() if r["b"]]
    counts = np.zeros((buckets, contexts))
    for t in ids:
        for i, a in enumerate(t):
            for b in t[max(0, i - wv.WINDOW):i] + t[i + 1:i + 1 + wv.WINDOW]:
                counts[a, b % contexts] += 1
    column = counts.sum(0) ** wv.SMOOTH
    column = np.where(column > 0, column / column.sum(), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(counts > 0, np.maximum(np.log(counts / counts.sum(1, keepdims=True) / column / wv.SHIFT), 0), 0)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    k = dim - dim // wv.OWN
    one = wv.fit_word_vectors(d.coalesce(1), "tokens", dim=dim, buckets=buckets, contexts=contexts).table
    many = wv.fit_word_vectors(d.repartition(7), "tokens", dim=dim, buckets=buckets, contexts=contexts).table
    assert np.allclose(one, many, atol=1e-8)
    exact = (u[:, :k] * s[:k]) @ u[:, :k].T
    assert np.abs(one[:, :k] @ one[:, :k].T - exact).max() < 0.02 * np.abs(exact).max()


def test_word_vectors_of_an_empty_table(spark):
    from provenance_spark.operators import word_vectors as wv
    from provenance_spark.session import workspace_path
    d = spark.createDataFrame([], "id long, tokens array<string>")
    model = wv.fit_word_vectors(d, "tokens", dim=8, buckets=512)
    assert wv.mean_vectors(d, model, "tokens").count() == 0 and not model.table[:, :6].any()
    path = workspace_path(spark, "vectors")
    model.save(spark, path)
    assert (wv.WordVectors.load(spark, path).table == model.table).all()



def test_joined_tfidf_vectors_equal_those_of_a_collected_vocabulary(spark):
    from provenance_spark.functions.text import with_ngram_terms
    from provenance_spark.operators.detector import tfidf_arrays
    texts = ["the cat sat", "the cat ran off", "a dog sat", "", "unknown words", "the the cat"]
    df = spark.createDataFrame([(n, "test" if n > 3 else "train", n % 2, t) for n, t in enumerate(texts)], "id long, split string, AI int, text string")
    rows, dim = tfidf_arrays(df, min_df=1)
    got = {r["id"]: r["features"] for r in ft.sparse_vectors(rows, dim).collect()}
    tf = ft.doc_term_counts(df.where("split = 'train'").select("id", "text"), id_col="id")
    out = with_ngram_terms(df, "text", "terms")
    for stage in ft.tfidf_vector_stages(ft.fit_vocabulary(tf, 4, min_df=1, max_features=1 << 18, id_col="id").collect()):
        out = stage.transform(out)
    want = {r["id"]: r["features"] for r in out.select("id", "features").collect()}
    assert got.keys() == want.keys() == set(range(6))
    assert all(got[k].size == want[k].size == dim and abs(got[k].toArray() - want[k].toArray()).max() < 1e-12 for k in got)


def test_cleaning_steps_stand_once_in_the_plan(spark):
    from provenance_spark.functions import text as tx
    df = spark.createDataFrame([(1, " “Cannot” use 3 texts,\n gonna run. "), (2, None), (3, "")], "id long, text string")
    out = tx.with_clean_text(df, "text", "clean", remove_stopword=True, lemmatize=True)
    assert [r["clean"] for r in out.orderBy("id").collect()] == ["“ ” use text gon na run", None, ""]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("([«“‘„»”’])") == 1 and plan.count("translate(") == 3  # each named a dozen times before


def test_a_small_lemma_table_makes_the_tokens_once(spark):
    from provenance_spark.operators import features as ft
    df = spark.createDataFrame([(1, ["uses", "a", "uses"]), (2, None), (3, ["b"]), (None, ["uses"])], "doc_id long, tokens array<string>")
    out = ft.lemmatize_join(df, spark.createDataFrame([("uses", "use")], "word string, lemma string"))
    got = {r["doc_id"]: r["tokens"] for r in out.collect()}
    assert got == {1: ["use", "a", "use"], 2: [], 3: ["b"], None: ["use"]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_hashed_terms_are_the_hashed_rows_without_lambdas(spark):
    from pyspark.sql import functions as F
    from provenance_spark.streaming.incremental import hashed_rows, hashed_terms
    df = spark.createDataFrame([(1, "aa bb aa bb"), (2, "x"), (3, None), (4, "cc")], "doc_id long, text string")
    long = sorted(tuple(r) for r in hashed_terms(df, num_features=64).collect())
    rows = hashed_rows(df, num_features=64).select("doc_id", F.explode("idx").alias("bucket"))
    assert long == sorted(tuple(r) for r in rows.collect())
    assert "lambda" not in hashed_terms(df)._jdf.queryExecution().optimizedPlan().toString()


def test_weights_from_texts_equal_weights_of_counts(spark):
    from provenance_spark.operators import features as ft
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (2, "bb dd"), (None, "aa"), (4, None)], "doc_id long, text string")
    tf = ft.doc_term_counts(df)
    vocab = ft.fit_vocabulary(tf, 5, min_df=1)
    assert sorted(map(str, ft.tfidf_weights(df, vocab).collect())) == sorted(map(str, ft.tfidf_long(tf, vocab).collect()))
