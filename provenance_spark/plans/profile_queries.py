"""Profiling and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenance_spark.operators import metrics, profile
from provenance_spark.plans.corpus_queries import load_corpus
from provenance_spark.plans.oracle import CORPUS_CTE
from provenance_spark.plans.registry import query
from provenance_spark.sources.tables import read_table


@query("version_counts", "A1", f"""
WITH {CORPUS_CTE}
SELECT version, count(*) AS n FROM corpus GROUP BY version""")
def q_version_counts(spark, sf_dir):
    return profile.value_counts(load_corpus(spark, sf_dir), "version")


@query("class_balance", "A2", f"""
WITH {CORPUS_CTE}
SELECT split, AI, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM corpus GROUP BY split, AI""")
def q_class_balance(spark, sf_dir):
    return profile.class_balance(load_corpus(spark, sf_dir), "split", "AI")


DOC_COLUMNS = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
               ("n_chars", "bigint"))


@query("column_profile", "A5 A6", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"count(*) AS n_rows FROM documents" for c, t in DOC_COLUMNS))
def q_column_profile(spark, sf_dir):
    return profile.column_profile(read_table(spark, sf_dir, "documents"))


@query("table_shape", "A6", """
SELECT count(*) AS n_rows, max(len(embedding)) AS dim FROM embeddings""")
def q_table_shape(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("embedding")).alias("dim"))


DOC_LENGTH = """docs AS (SELECT doc_id, lang, CAST(length(replace(text, chr(10), ' ')) AS INTEGER) AS text_length
                FROM documents)"""


def doc_lengths(spark, sf_dir):
    from provenance_spark.functions.text import normalize_newlines, text_length
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", text_length(normalize_newlines(F.col("text"))).alias("text_length"))


@query("length_quartiles", "A3", f"""
WITH {DOC_LENGTH}
SELECT lang, count(*) AS n, quantile_cont(text_length, 0.25) AS q1, quantile_cont(text_length, 0.5) AS median,
       quantile_cont(text_length, 0.75) AS q3
FROM docs GROUP BY lang""")
def q_length_quartiles(spark, sf_dir):
    return profile.quartiles(doc_lengths(spark, sf_dir), "text_length", ["lang"])


@query("length_bands", "A4 P7", f"""
WITH {DOC_LENGTH},
q AS (SELECT lang, quantile_cont(text_length, 0.25) AS q1, quantile_cont(text_length, 0.75) AS q3
      FROM docs GROUP BY lang)
SELECT d.doc_id, d.lang, d.text_length,
       CASE WHEN d.text_length < q.q1 THEN 'small' WHEN d.text_length <= q.q3 THEN 'medium' ELSE 'large' END AS band
FROM docs d JOIN q ON d.lang = q.lang""")
def q_length_bands(spark, sf_dir):
    return profile.length_bands(doc_lengths(spark, sf_dir), "text_length", ["lang"])


@query("length_histogram", "A7 W2", f"""
WITH {CORPUS_CTE},
s AS (SELECT split, AI, min(text_length) AS mn, max(text_length) AS mx FROM corpus GROUP BY split, AI),
b AS (SELECT c.split, c.AI,
             CASE WHEN s.mx > s.mn THEN CAST(least(floor((c.text_length - s.mn) * 100 / (s.mx - s.mn)), 99) AS INTEGER)
                  ELSE 0 END AS bin
      FROM corpus c JOIN s ON c.split = s.split AND c.AI = s.AI),
cnt AS (SELECT split, AI, bin, count(*) AS n FROM b GROUP BY split, AI, bin),
grid AS (SELECT s.*, CAST(g.bin AS INTEGER) AS bin FROM s, range(0, 100) g(bin))
SELECT grid.split, grid.AI, grid.bin,
       round(grid.mn + grid.bin * (grid.mx - grid.mn) / 100, 6) AS lo,
       round(grid.mn + (grid.bin + 1) * (grid.mx - grid.mn) / 100, 6) AS hi,
       coalesce(cnt.n, 0) AS n
FROM grid LEFT JOIN cnt ON grid.split = cnt.split AND grid.AI = cnt.AI AND grid.bin = cnt.bin""")
def q_length_histogram(spark, sf_dir):
    return profile.histogram(load_corpus(spark, sf_dir), "text_length", ["split", "AI"])


@query("length_boxplot", "A8 W2", f"""
WITH {CORPUS_CTE},
q AS (SELECT split, AI, quantile_cont(text_length, 0.25) AS q1, quantile_cont(text_length, 0.5) AS median,
             quantile_cont(text_length, 0.75) AS q3 FROM corpus GROUP BY split, AI)
SELECT c.split, c.AI, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr,
       min(CASE WHEN c.text_length >= q.q1 - 1.5 * (q.q3 - q.q1) THEN c.text_length END) AS whisker_lo,
       max(CASE WHEN c.text_length <= q.q3 + 1.5 * (q.q3 - q.q1) THEN c.text_length END) AS whisker_hi,
       count(CASE WHEN c.text_length < q.q1 - 1.5 * (q.q3 - q.q1) OR c.text_length > q.q3 + 1.5 * (q.q3 - q.q1)
                  THEN 1 END) AS n_outliers,
       count(*) AS n
FROM corpus c JOIN q ON c.split = q.split AND c.AI = q.AI
GROUP BY c.split, c.AI, q.q1, q.median, q.q3""")
def q_length_boxplot(spark, sf_dir):
    return profile.boxplot_stats(load_corpus(spark, sf_dir), "text_length", ["split", "AI"])


@query("length_outliers", "A8", f"""
WITH {DOC_LENGTH},
q AS (SELECT lang, quantile_cont(text_length, 0.25) AS q1, quantile_cont(text_length, 0.75) AS q3 FROM docs GROUP BY lang),
s AS (SELECT d.doc_id, d.lang, d.text_length, CASE WHEN d.text_length < q.q1 - 1.5 * (q.q3 - q.q1) THEN 'low'
             WHEN d.text_length > q.q3 + 1.5 * (q.q3 - q.q1) THEN 'high' END AS side
      FROM docs d JOIN q ON d.lang = q.lang)
SELECT * FROM s WHERE side IS NOT NULL""")
def q_length_outliers(spark, sf_dir):
    return profile.boxplot_outliers(doc_lengths(spark, sf_dir), "text_length", ["lang"])


# --- fixed values: rule "heads" used to exercise the metric operators on real rows ---
LONG_TEXT = 300
RULES_SQL = {
    "long_text": f"CASE WHEN text_length > {LONG_TEXT} THEN 1 ELSE 0 END",
    "has_period": "CASE WHEN position('. ' IN text) > 0 THEN 1 ELSE 0 END",
    "majority": "0",
}


def rule_predictions(corpus):
    rules = {
        "long_text": F.when(F.col("text_length") > LONG_TEXT, 1).otherwise(0),
        "has_period": F.when(F.col("text").contains(". "), 1).otherwise(0),
        "majority": F.lit(0),
    }
    stacked = F.array(*[F.struct(F.lit(k).alias("head"), v.alias("pred")) for k, v in rules.items()])
    return corpus.select("id", "split", "version", "AI", F.inline(stacked))


RULES_CTE = "preds AS (" + " UNION ALL ".join(
    f"SELECT id, split, version, AI, '{k}' AS head, {v} AS pred FROM corpus" for k, v in RULES_SQL.items()) + ")"


@query("accuracy", "A9", f"""
WITH {CORPUS_CTE}, {RULES_CTE}
SELECT split, round(avg(CASE WHEN pred = AI THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM preds WHERE head = 'long_text' GROUP BY split""")
def q_accuracy(spark, sf_dir):
    preds = rule_predictions(load_corpus(spark, sf_dir)).where(F.col("head") == "long_text")
    return metrics.accuracy(preds, "AI", "pred", ["split"])


@query("accuracy_by_version", "A12", f"""
WITH {CORPUS_CTE}, {RULES_CTE}
SELECT split, version, round(avg(CASE WHEN pred = AI THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM preds WHERE head = 'long_text' GROUP BY split, version""")
def q_accuracy_by_version(spark, sf_dir):
    preds = rule_predictions(load_corpus(spark, sf_dir)).where(F.col("head") == "long_text")
    return metrics.accuracy(preds, "AI", "pred", ["split", "version"])


@query("score_board", "A11 A10", f"""
WITH {CORPUS_CTE}, {RULES_CTE},
acc AS (SELECT head, split, avg(CASE WHEN pred = AI THEN 1 ELSE 0 END) AS a FROM preds GROUP BY head, split)
SELECT head, round(max(CASE WHEN split = 'valid' THEN a END), 6) AS valid_accuracy,
       round(max(CASE WHEN split = 'test' THEN a END), 6) AS test_accuracy,
       round((max(CASE WHEN split = 'valid' THEN a END) + max(CASE WHEN split = 'test' THEN a END)) / 2, 6)
         AS mean_accuracy
FROM acc GROUP BY head""")
def q_score_board(spark, sf_dir):
    preds = rule_predictions(load_corpus(spark, sf_dir))
    acc = preds.groupBy("head").agg(
        F.avg(F.when(F.col("split") == "valid", metrics.correct(F.col("pred"), F.col("AI")))).alias("v"),
        F.avg(F.when(F.col("split") == "test", metrics.correct(F.col("pred"), F.col("AI")))).alias("t"))
    return acc.select("head", F.round("v", 6).alias("valid_accuracy"), F.round("t", 6).alias("test_accuracy"),
                      F.round(metrics.mean_of_accuracies(F.col("v"), F.col("t")), 6).alias("mean_accuracy"))


@query("best_score_gate", "S12", f"""
WITH {CORPUS_CTE}, {RULES_CTE},
runs AS (SELECT head, CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END AS run,
                round(avg(CASE WHEN pred = AI THEN 1 ELSE 0 END), 6) AS score
         FROM preds GROUP BY head, split)
SELECT head, run, score,
       coalesce(max(score) OVER (PARTITION BY head ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
         AS best_before,
       score > coalesce(max(score) OVER (PARTITION BY head ORDER BY run
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS saved
FROM runs""")
def q_best_score_gate(spark, sf_dir):
    preds = rule_predictions(load_corpus(spark, sf_dir))
    run = F.when(F.col("split") == "train", 1).when(F.col("split") == "valid", 2).otherwise(3)
    runs = (preds.withColumn("run", run).groupBy("head", "run")
            .agg(F.round(F.avg(metrics.correct(F.col("pred"), F.col("AI"))), 6).alias("score")))
    return metrics.best_score_gate(runs, "head", "run", "score")
