"""Text cleaning (T1-T8) and feature (F1-F8, F12) queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenance_spark.functions import fixed_values as fv
from provenance_spark.functions import text as tx
from provenance_spark.functions.sample_lemmas import DEFAULT_LEMMAS
from provenance_spark.operators import detector as det
from provenance_spark.operators import encode as enc
from provenance_spark.operators import features as ft
from provenance_spark.operators import heavy_hitters
from provenance_spark.operators import subword as sub
from provenance_spark.operators import word_vectors as wv
from provenance_spark.plans import oracle as o
from provenance_spark.plans.registry import query
from provenance_spark.session import cut_lineage, shuffle_partitions
from provenance_spark.sources.tables import read_table
from provenance_spark.streaming.incremental import hashed_terms

LEMMAS = tx.compose_lemma_map(DEFAULT_LEMMAS)


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


@query("clean_basic", "T1 T2 T3 D1", f"""
SELECT doc_id, {o.clean_basic_sql('text')} AS clean FROM documents""")
def q_clean_basic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.clean_basic(F.col("text")).alias("clean"))


def _tokens_out(df, col):
    """Tokens as one string plus their count.

    The array is its own column first: expressions holding a lambda are not de-duplicated by
    subexpression elimination, so referencing ``col`` twice would run the whole chain twice.
    """
    return (df.select("doc_id", col.alias("_t"))
              .select("doc_id", F.array_join("_t", " ").alias("tokens"), F.size("_t").alias("n_tokens")))


def _tokens_sql(expr: str) -> str:
    return f"SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n_tokens FROM (SELECT doc_id, {expr} AS t FROM documents)"


@query("word_tokens", "T4", _tokens_sql(o.word_tokens_sql(o.clean_basic_sql("text"))))
def q_word_tokens(spark, sf_dir):
    d = tx.with_word_tokens(docs(spark, sf_dir), "text", "t")
    return _tokens_out(d, F.col("t"))


@query("stopword_filter", "T5", _tokens_sql(o.remove_stopwords_sql(o.word_tokens_sql(o.clean_basic_sql("text")))))
def q_stopword_filter(spark, sf_dir):
    d = tx.with_word_tokens(docs(spark, sf_dir), "text", "t")
    return _tokens_out(d, tx.staged_pass(F.col("t"), tx.remove_stopwords))


@query("lemmatize", "T6", _tokens_sql(o.lemmatize_sql(o.word_tokens_sql(o.clean_basic_sql("text")), LEMMAS)))
def q_lemmatize(spark, sf_dir):
    d = tx.with_word_tokens(docs(spark, sf_dir), "text", "t")
    return _tokens_out(d, tx.staged_pass(F.col("t"), lambda t: tx.lemmatize_tokens(t, LEMMAS)))


@query("lemmatize_table", "T6", _tokens_sql(o.lemmatize_sql(o.word_tokens_sql(o.clean_basic_sql("text")), LEMMAS)))
def q_lemmatize_table(spark, sf_dir):
    """The same lemmas as a joined table."""
    d = tx.with_word_tokens(docs(spark, sf_dir), "text", "t")
    table = spark.createDataFrame(sorted(LEMMAS.items()), "word string, lemma string")
    return _tokens_out(ft.lemmatize_join(d, table, tokens_col="t"), F.col("t"))


@query("clean_default", "T8 T9", f"""
SELECT doc_id, {o.strip_sql(o.clean_basic_sql('text'))} AS clean FROM documents""")
def q_clean_default(spark, sf_dir):
    return tx.with_clean_text(docs(spark, sf_dir), "text", "clean").select("doc_id", "clean")


@query("clean_lemma_only", "T8", f"""
SELECT doc_id, {o.strip_sql("array_to_string(" + o.lemmatize_sql(o.word_tokens_sql(o.clean_basic_sql('text')), LEMMAS) + ", ' ')")} AS clean
FROM documents""")
def q_clean_lemma_only(spark, sf_dir):
    return tx.with_clean_text(docs(spark, sf_dir), "text", "clean", lemmatize=True, lemma_map=LEMMAS).select("doc_id", "clean")


@query("clean_full", "T7 T8", f"""
SELECT doc_id, {o.strip_sql("array_to_string(" + o.lemmatize_sql(o.remove_stopwords_sql(
    o.word_tokens_sql(o.clean_basic_sql('text'))), LEMMAS) + ", ' ')")} AS clean FROM documents""")
def q_clean_full(spark, sf_dir):
    return tx.with_clean_text(docs(spark, sf_dir), "text", "clean", remove_stopword=True, lemmatize=True,
                              lemma_map=LEMMAS).select("doc_id", "clean")


@query("clean_stopwords_only", "T8", f"""
SELECT doc_id, {o.strip_sql("array_to_string(" + o.remove_stopwords_sql(
    o.word_tokens_sql(o.clean_basic_sql('text'))) + ", ' ')")} AS clean FROM documents""")
def q_clean_stopwords_only(spark, sf_dir):
    return tx.with_clean_text(docs(spark, sf_dir), "text", "clean", remove_stopword=True,
                              lemmatize=False).select("doc_id", "clean")


# ---------------------------------------------------------------- TF-IDF

TERMS_CTE = f"""uni AS MATERIALIZED (SELECT doc_id, {o.unigrams_sql('text')} AS u FROM documents),
terms AS MATERIALIZED (SELECT doc_id, {o.ngram_terms_sql('u')} AS terms FROM uni),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM terms)
                   GROUP BY doc_id, term)"""


@query("ngrams", "F2", f"""
WITH {TERMS_CTE}
SELECT doc_id, term, tf FROM tf""")
def q_ngrams(spark, sf_dir):
    return ft.doc_term_counts(docs(spark, sf_dir))


# F1 parameters of the registered queries: the vectoriser's defaults
MIN_DF, MAX_FEATURES = 100, 1 << 18

VOCAB_CTE = f"""{TERMS_CTE},
stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term HAVING count(*) >= {MIN_DF}),
top AS (SELECT * FROM stats ORDER BY cf DESC, term LIMIT {MAX_FEATURES}),
vocab AS (SELECT term, df, cf, row_number() OVER (ORDER BY term) - 1 AS term_id,
                 ln((1 + nd.n) / (1 + df)) + 1 AS idf FROM top, (SELECT count(*) AS n FROM documents) nd)"""


def fitted_vocabulary(spark, sf_dir):
    d = docs(spark, sf_dir)
    tf = ft.doc_term_counts(d)
    n_docs = d.count()
    return tf, ft.fit_vocabulary(tf, n_docs, min_df=MIN_DF, max_features=MAX_FEATURES)


@query("tfidf_vocabulary", "F3 L4", f"""
WITH {VOCAB_CTE}
SELECT term, df, cf, term_id, round(idf, 6) AS idf FROM vocab""")
def q_tfidf_vocabulary(spark, sf_dir):
    _, vocab = fitted_vocabulary(spark, sf_dir)
    return vocab.select("term", "df", "cf", "term_id", F.round("idf", 6).alias("idf"))


#: Terms kept, far fewer than the distinct ones.
FREQUENT_TERMS = 1 << 12


@query("frequent_vocabulary", "F3 L4", f"""
WITH {TERMS_CTE},
stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term HAVING count(*) >= {MIN_DF}),
top AS (SELECT * FROM stats ORDER BY cf DESC, term LIMIT {FREQUENT_TERMS})
SELECT term, df, cf, row_number() OVER (ORDER BY term) - 1 AS term_id FROM top""")
def q_frequent_vocabulary(spark, sf_dir):
    """The vocabulary from bounded summaries and an exact recount of their candidates."""
    tf = ft.doc_term_counts(docs(spark, sf_dir))
    vocab = ft.fit_vocabulary(tf, 1, min_df=MIN_DF, max_features=FREQUENT_TERMS, capacity=heavy_hitters.CAPACITY)
    return vocab.select("term", "df", "cf", "term_id")


@query("tfidf_weights", "F1", f"""
WITH {VOCAB_CTE},
w AS (SELECT tf.doc_id, v.term_id, tf.tf * v.idf AS w FROM tf JOIN vocab v ON tf.term = v.term)
SELECT doc_id, term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def q_tfidf_weights(spark, sf_dir):
    _, vocab = fitted_vocabulary(spark, sf_dir)
    return ft.tfidf_weights(docs(spark, sf_dir), vocab)


# ---------------------------------------------------------------- sequences

NUM_WORDS, MAXLEN = 2000, 100


def seq_vocab_cte(table: str, text: str) -> str:
    """Vocabulary and id sequences of the texts in ``table``."""
    return f"""words AS (SELECT doc_id, {o.keras_words_sql(text)} AS words FROM {table}),
occ AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM words),
first_doc AS (SELECT word, count(*) AS n, min(doc_id) AS first_doc FROM occ GROUP BY word),
first_pos AS (SELECT o.word, min(o.pos) AS first_pos FROM occ o JOIN first_doc f
              ON o.word = f.word AND o.doc_id = f.first_doc GROUP BY o.word),
ranked AS (SELECT f.word, f.n, row_number() OVER (ORDER BY f.n DESC, f.first_doc, p.first_pos) + 1 AS id
           FROM first_doc f JOIN first_pos p ON f.word = p.word),
vocab AS (SELECT word, n, id FROM ranked WHERE id < {NUM_WORDS}),
seqs AS (SELECT d.doc_id, coalesce(s.seq, []) AS seq FROM {table} d LEFT JOIN (
           SELECT o.doc_id, list(coalesce(v.id, 1) ORDER BY o.pos) AS seq
           FROM occ o LEFT JOIN vocab v ON o.word = v.word GROUP BY o.doc_id) s ON d.doc_id = s.doc_id)"""


SEQ_VOCAB_CTE = seq_vocab_cte("documents", "text")


def sequence_vocabulary(spark, sf_dir):
    return ft.fit_sequence_vocabulary(docs(spark, sf_dir), num_words=NUM_WORDS)


@query("seq_vocabulary", "F4", f"""
WITH {SEQ_VOCAB_CTE}
SELECT word, n, id FROM vocab""")
def q_seq_vocabulary(spark, sf_dir):
    return sequence_vocabulary(spark, sf_dir)


def sequences(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", tx.keras_words(F.col("text")).alias("words"))
    return ft.text_to_sequence(d, sequence_vocabulary(spark, sf_dir))


@query("text_sequences", "F5", f"""
WITH {SEQ_VOCAB_CTE}
SELECT doc_id, array_to_string(seq, ' ') AS seq, len(seq) AS seq_len FROM seqs""")
def q_text_sequences(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("doc_id", F.array_join("seq", " ").alias("seq"), F.size("seq").alias("seq_len"))


@query("padded_sequences", "F6", f"""
WITH {SEQ_VOCAB_CTE}
SELECT doc_id, array_to_string(list_resize(list_slice(seq, greatest(len(seq) - {MAXLEN - 1}, 1), len(seq)),
                                           {MAXLEN}, 0), ' ') AS padded
FROM seqs""")
def q_padded_sequences(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("doc_id", F.array_join(ft.pad_sequence(F.col("seq"), MAXLEN), " ").alias("padded"))


CLASSES = 2


def _sequence_weights() -> list[list[float]]:
    """Fixed weights that SQL can state by the same rule: class, id -> -0.5 to 0.5."""
    return [[((i * (13 + 24 * c)) % 101 - 50) / 100 for i in range(NUM_WORDS)] for c in range(CLASSES)]


CLEAN_FULL_SQL = o.strip_sql("array_to_string(" + o.lemmatize_sql(o.remove_stopwords_sql(o.word_tokens_sql(o.clean_basic_sql("text"))), LEMMAS) + ", ' ')")


def _score_sql(c: int) -> str:
    return f"coalesce(list_sum(list_transform(ids, lambda i: ((i * {13 + 24 * c}) % 101 - 50) / 100.0::DOUBLE)), 0)"


@query("sequence_scores", "G6 T7 F4 F5 F6", f"""
WITH cleaned AS MATERIALIZED (SELECT doc_id, {CLEAN_FULL_SQL} AS clean FROM documents),
{seq_vocab_cte("cleaned", "clean")},
kept AS (SELECT doc_id, list_slice(seq, greatest(len(seq) - {MAXLEN - 1}, 1), len(seq)) AS ids FROM seqs)
SELECT doc_id, round({_score_sql(0)}, 6) + 0.0 AS score_0, round({_score_sql(1)}, 6) + 0.0 AS score_1,
       CAST(CASE WHEN round({_score_sql(1)}, 6) > round({_score_sql(0)}, 6) THEN 1 ELSE 0 END AS INTEGER) AS class FROM kept""")
def q_sequence_scores(spark, sf_dir):
    """Cleaned text to padded ids to class scores at fixed weights; the class is the first largest score."""
    cleaned = tx.with_clean_text(docs(spark, sf_dir), "text", "text", remove_stopword=True, lemmatize=True, lemma_map=LEMMAS)
    cleaned = cut_lineage(cleaned.select("doc_id", "text"))  # the vocabulary and the sequences read it
    vocab = ft.fit_sequence_vocabulary(cleaned, num_words=NUM_WORDS)
    seq = ft.text_to_sequence(cleaned.select("doc_id", tx.keras_words(F.col("text")).alias("words")), vocab)
    padded = seq.select("doc_id", ft.pad_sequence(F.col("seq"), MAXLEN).alias("padded"))
    scores = det.class_scores(F.col("padded"), _sequence_weights(), [0.0] * CLASSES)
    rounded = padded.select("doc_id", F.transform(scores, lambda x: F.round(x, 6) + F.lit(0.0)).alias("scores"))
    return rounded.select("doc_id", *[F.col("scores")[c].alias(f"score_{c}") for c in range(CLASSES)], det.argmax(F.col("scores")).alias("class"))


HASH_BITS = 18


@query("hashed_features", "F12", f"""
WITH {TERMS_CTE}
SELECT CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % {1 << HASH_BITS} AS bucket, CAST(sum(tf) AS BIGINT) AS n,
       count(DISTINCT doc_id) AS n_docs FROM tf GROUP BY 1""")
def q_hashed_features(spark, sf_dir):
    """Occurrences and documents of every hash bucket; MD5 here, as DuckDB has no XXH64."""
    digest = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("long")
    # documents meet by id before they are taken apart: only the texts cross the network
    d = docs(spark, sf_dir).repartition(shuffle_partitions(spark), "doc_id")
    each = hashed_terms(d, "doc_id", "text", 1 << HASH_BITS, hash_of=digest).groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
    return (each.groupBy(F.col("bucket").cast("long").alias("bucket"))
            .agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")))


# ---------------------------------------------------------------- encoder

#: Stands in for a supplied vocabulary: every word the documents hold this often or more.
ENC_MIN_COUNT = 5


def encoder_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.encoder_pre_tokens(F.col("text")).alias("tokens"))


@query("encode_ids", "F7 F11 D2", f"""
WITH toks AS (SELECT doc_id, {o.encoder_tokens_sql('text')} AS tokens FROM documents),
occ AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM toks),
counts AS (SELECT word, count(*) AS n FROM occ GROUP BY word HAVING count(*) >= {ENC_MIN_COUNT}),
vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 + {fv.FIRST_WORD_ID} AS id FROM counts),
ids AS (SELECT t.doc_id, coalesce(s.ids, []) AS ids FROM toks t LEFT JOIN (
          SELECT o.doc_id, list(coalesce(v.id, {fv.UNK_ID}) ORDER BY o.pos) AS ids
          FROM occ o LEFT JOIN vocab v ON o.word = v.word GROUP BY o.doc_id) s ON t.doc_id = s.doc_id)
SELECT doc_id, array_to_string(list_concat([{fv.CLS_ID}], ids, [{fv.SEP_ID}]), ' ') AS input_ids, len(ids) + 2 AS n_tokens
FROM ids""")
def q_encode_ids(spark, sf_dir):
    """Whole texts, no cut: the longest sequence is the longest text's."""
    d = cut_lineage(encoder_words(spark, sf_dir))
    e = enc.encode_words(d, enc.word_vocabulary(d, "tokens", min_count=ENC_MIN_COUNT), "doc_id", "tokens")
    return e.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), F.size("input_ids").alias("n_tokens"))


#: Word pieces of the stand-in vocabulary: up to this many characters, found this often at least.
PIECE_CHARS, PIECE_COUNT = 4, 20


@query("subword_ids", "F7 S14 D2", f"""
WITH RECURSIVE toks AS (SELECT doc_id, {o.encoder_tokens_sql('text')} AS tokens FROM documents),
occ AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM toks),
counts AS (SELECT word, count(*) AS n FROM occ GROUP BY word),
spans AS (SELECT word, n, place, k, substr(word, CAST(place + 1 AS INT), CAST(k AS INT)) AS piece, place > 0 AS continues
          FROM (SELECT word, n, unnest(range(0, length(word))) AS place FROM counts), range(1, {PIECE_CHARS} + 1) t(k) WHERE place + k <= length(word)),
vocab AS (SELECT piece, continues, CAST(row_number() OVER (ORDER BY continues, piece) - 1 + {fv.FIRST_WORD_ID} AS INT) AS id
          FROM (SELECT piece, continues FROM spans GROUP BY ALL HAVING sum(n) >= {PIECE_COUNT})),
step AS (SELECT word, place, max(k) AS k, arg_max(id, k) AS id FROM spans JOIN vocab USING (piece, continues) GROUP BY ALL),
cut AS (SELECT word, CAST(0 AS BIGINT) AS place, CAST([] AS INT[]) AS ids FROM counts
        UNION ALL SELECT cut.word, cut.place + step.k, list_append(ids, id) FROM cut JOIN step ON step.word = cut.word AND step.place = cut.place),
full_ AS (SELECT word, ids FROM cut WHERE place = length(word)),
ids AS (SELECT t.doc_id, coalesce(s.ids, []) AS ids FROM toks t LEFT JOIN (
          SELECT o.doc_id, flatten(list(coalesce(f.ids, [{fv.UNK_ID}]) ORDER BY o.pos)) AS ids
          FROM occ o LEFT JOIN full_ f ON o.word = f.word GROUP BY o.doc_id) s ON t.doc_id = s.doc_id)
SELECT doc_id, array_to_string(list_concat([{fv.CLS_ID}], ids, [{fv.SEP_ID}]), ' ') AS input_ids, CAST(len(ids) + 2 AS BIGINT) AS n_mask
FROM ids""")
def q_subword_ids(spark, sf_dir):
    """Whole texts as word pieces with their attention mask, here of a vocabulary made by rule."""
    d = encoder_words(spark, sf_dir)
    counts = d.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    e = sub.encode_subwords(d, sub.frequent_pieces(counts, PIECE_CHARS, PIECE_COUNT), "doc_id", "tokens")
    mask = F.size(F.filter("attention_mask", lambda x: x == 1)).cast("long")
    return e.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), mask.alias("n_mask"))


@query("hidden_state", "F8 D2")
def q_hidden_state(spark, sf_dir):
    """Each document's mean word vector over all its tokens."""
    d = cut_lineage(encoder_words(spark, sf_dir))
    model = wv.fit_word_vectors(d, "tokens")
    return wv.mean_vectors(d, model, "tokens").select("doc_id", "hidden_state")
