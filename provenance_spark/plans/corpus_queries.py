"""Queries over the labelled corpus: load, caps, positional splits, samples, prepared sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenance_spark.operators.permute import place_sql, shuffle_table
from provenance_spark.operators.positions import first_n_by_key, preview, row_at
from provenance_spark.operators.sampling import balanced_quotas, seeded_pick, stratified_sample
from provenance_spark.operators.splits import (fraction_cuts, head_cuts, positional_split, prepare_datasets,
                                               search_frame, shuffle_before_split, tail_cuts)
from provenance_spark.plans.oracle import CORPUS_CTE, quotas_cte, sample_cte
from provenance_spark.plans.registry import query
from provenance_spark.session import workspace_path
from provenance_spark.sources.corpus import (CORPUS_COLUMNS, SPLITS, CsvCorpusConfig, corpus_from_conversations,
                                             external_corpus, load_labelled_csv, with_version)
from provenance_spark.sources.materialize import write_csv
from provenance_spark.sources.tables import read_table


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_conversations(read_table(spark, sf_dir, "conversations"))


@query("corpus_load", "S1 P1 P2 P3 P4 P5 U1", f"""
WITH {CORPUS_CTE}
SELECT id, split, AI, version, text, text_length FROM corpus""")
def q_corpus_load(spark, sf_dir):
    return load_corpus(spark, sf_dir).select(*CORPUS_COLUMNS)


# Read caps in rows per split (half per class), the first rows in file (id) order
CAP_TRAIN, CAP_EVAL = 200, 40


@query("corpus_cap", "S6 W1", f"""
WITH {CORPUS_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY split, AI ORDER BY id) - 1 AS pos FROM corpus)
SELECT id, split, AI, version, text_length FROM r
WHERE pos < CASE WHEN split = 'train' THEN {CAP_TRAIN // 2} ELSE {CAP_EVAL // 2} END""")
def q_corpus_cap(spark, sf_dir):
    corpus = load_corpus(spark, sf_dir).select("id", "split", "AI", "version", "text_length")
    cap = F.when(F.col("split") == "train", CAP_TRAIN // 2).otherwise(CAP_EVAL // 2)
    return first_n_by_key(corpus, ["id"], cap, group_by=["split", "AI"])


CSV_CAP_TRAIN, CSV_CAP_EVAL = 100, 20


@query("corpus_csv_load", "S1 S1b S1c S2 S5 S6 S8 U1", f"""
WITH {CORPUS_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY split, AI ORDER BY id) AS pos FROM corpus)
SELECT split, AI, text FROM r
WHERE pos <= CASE WHEN split = 'train' THEN {CSV_CAP_TRAIN // 2} ELSE {CSV_CAP_EVAL // 2} END""")
def q_corpus_csv_load(spark, sf_dir):
    """The corpus written as the per-split CSV files the original ships, then loaded back with caps."""
    cfg = write_corpus_csv(spark, sf_dir, CSV_CAP_TRAIN, CSV_CAP_EVAL)
    return load_labelled_csv(spark, cfg).select("split", "AI", "text")


SHUFFLE_SEED = 3


@query("shuffled_corpus", "S1 S1c S5 L1 L2 U1", f"""
WITH {CORPUS_CTE},
t AS (SELECT split, AI, text, row_number() OVER (PARTITION BY split ORDER BY AI, id) - 1 AS pos,
             count(*) OVER (PARTITION BY split) AS n FROM corpus),
{place_sql(SHUFFLE_SEED, "split, AI, text", "t")}
SELECT * FROM placed""")
def q_shuffled_corpus(spark, sf_dir):
    """All rows of the per-split CSV files, human before machine, each split shuffled whole by seed."""
    cfg = write_corpus_csv(spark, sf_dir, None, None)
    return load_labelled_csv(spark, cfg, shuffle=SHUFFLE_SEED).select("split", "AI", "text", "place")


@query("shuffled_documents", "L1 L2", f"""
WITH t AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
{place_sql(SHUFFLE_SEED, "doc_id, n_chars", "t")}
SELECT * FROM placed""")
def q_shuffled_documents(spark, sf_dir):
    """The documents in seeded random order, cut into ranges of places."""
    return shuffle_table(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], SHUFFLE_SEED)


def write_corpus_csv(spark: SparkSession, sf_dir: str, train_cap: int | None, eval_cap: int | None) -> CsvCorpusConfig:
    """The corpus as per-split CSV files, a folder each, in the order of its ids."""
    cfg = CsvCorpusConfig(workspace_path(spark, "corpus_csv"), train_cap=train_cap, eval_cap=eval_cap)
    corpus = load_corpus(spark, sf_dir).select("id", "split", "AI", "text")
    for split in SPLITS:
        for path, ai in ((cfg.human_path(split), 0), (cfg.machine_path(split), 1)):
            rows = corpus.where((F.col("split") == split) & (F.col("AI") == ai)).select("id", "text")
            write_csv(rows.repartitionByRange("id").sortWithinPartitions("id"), path)
    return cfg


@query("positional_split", "W1", """
WITH r AS (SELECT doc_id, source, n_chars,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n
           FROM documents)
SELECT doc_id, source, n_chars,
       CASE WHEN pos * 10 < 8 * n THEN 'train' WHEN pos * 10 < 9 * n THEN 'valid' ELSE 'test' END AS split
FROM r""")
def q_positional_split(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return positional_split(docs, ["doc_id"], ["source"], fraction_cuts(8, 1))


TAIL_VALID, TAIL_TEST = 5, 5


@query("positional_split_tail", "W1", f"""
WITH r AS (SELECT doc_id, lang, n_chars,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY lang) AS n
           FROM documents)
SELECT doc_id, lang, n_chars,
       CASE WHEN pos < n - {TAIL_VALID + TAIL_TEST} THEN 'train' WHEN pos < n - {TAIL_TEST} THEN 'valid'
            ELSE 'test' END AS split
FROM r""")
def q_positional_split_tail(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return positional_split(docs, ["doc_id"], ["lang"], tail_cuts(TAIL_VALID, TAIL_TEST))


MIX_HEAD, MIX_TAIL = (6, 2), (5, 5)


@query("mixed_corpus_split", "U2 P2 P3 W1 L1 L1b S7", f"""
WITH {CORPUS_CTE},
base AS (SELECT id, split, AI, CASE WHEN AI = 1 THEN 'gpt2' ELSE 'human' END AS version, text, text_length
         FROM corpus WHERE version IN ('human', 'gpt2')),
three AS (SELECT *, row_number() OVER (ORDER BY md5('1:' || CAST(id AS VARCHAR)), id) - 1 AS pos FROM corpus WHERE version = 'gpt3'),
half AS (SELECT *, row_number() OVER (ORDER BY md5('1:' || CAST(id AS VARCHAR)), id) - 1 AS pos, count(*) OVER () AS n
         FROM corpus WHERE version = 'gpt3.5')
SELECT * FROM base
UNION ALL SELECT id, CASE WHEN pos < {MIX_HEAD[0]} THEN 'train' WHEN pos < {sum(MIX_HEAD)} THEN 'valid' ELSE 'test' END, 1, 'gpt3', text, text_length FROM three
UNION ALL SELECT id, CASE WHEN pos < n - {sum(MIX_TAIL)} THEN 'train' WHEN pos < n - {MIX_TAIL[1]} THEN 'valid' ELSE 'test' END, 1, 'gpt3.5', text, text_length
FROM half""")
def q_mixed_corpus_split(spark, sf_dir):
    """Three corpora, the extra two shuffled by seed and cut by position, in one table."""
    corpus = load_corpus(spark, sf_dir)
    base = with_version(corpus.where(F.col("version").isin("human", "gpt2")).drop("version"), "gpt2").select(*CORPUS_COLUMNS)
    extra = [("gpt3", head_cuts(*MIX_HEAD)), ("gpt3.5", tail_cuts(*MIX_TAIL))]
    for version, cuts in extra:
        rows = external_corpus(corpus.where(F.col("version") == version), "text", version, keep=("id",))
        base = base.unionByName(shuffle_before_split(rows, "id", cuts, seed=1).select(*CORPUS_COLUMNS))
    return base


SAMPLE_TRAIN_SIZE = 200


@query("stratified_sample", "W3 P6 L1", lambda: f"""
WITH {CORPUS_CTE},
train AS (SELECT * FROM corpus WHERE split = 'train'),
{quotas_cte(total={'train': SAMPLE_TRAIN_SIZE}).replace('FROM corpus', 'FROM train')},
{sample_cte(source='train')}
SELECT id, split, version, AI, text_length FROM sample""")
def q_stratified_sample(spark, sf_dir):
    train = load_corpus(spark, sf_dir).where(F.col("split") == "train")
    counts = train.groupBy("split", "version").agg(F.count(F.lit(1)).alias("n"))
    quotas = balanced_quotas(counts, total={"train": SAMPLE_TRAIN_SIZE})
    return stratified_sample(train, ["split", "version"], quotas, seed=1).select(
        "id", "split", "version", "AI", "text_length")


PREPARE_SQL = f"""
WITH {CORPUS_CTE},
{quotas_cte()},
{sample_cte()}
SELECT id, split, version, AI, text, text_length FROM sample"""


@query("prepare_datasets", "U3 W3 P6", PREPARE_SQL)
def q_prepare_datasets(spark, sf_dir):
    return prepare_datasets(load_corpus(spark, sf_dir)).select(
        "id", "split", "version", "AI", "text", "text_length")


@query("search_frame", "U4", f"""
WITH {CORPUS_CTE},
{quotas_cte()},
{sample_cte()}
SELECT id, split, AI, CASE WHEN split = 'train' THEN -1 ELSE 0 END AS fold
FROM sample WHERE split IN ('train', 'valid')""")
def q_search_frame(spark, sf_dir):
    return search_frame(prepare_datasets(load_corpus(spark, sf_dir))).select("id", "split", "AI", "fold")


@query("demo_text", "L3 S4", """
SELECT item_id, text FROM benchmark
ORDER BY md5('1:' || CAST(item_id AS VARCHAR)), item_id LIMIT 1""")
def q_demo_text(spark, sf_dir):
    return seeded_pick(read_table(spark, sf_dir, "benchmark"), "item_id", seed=1)


ROW_AT = 25


@query("row_at", "P11", f"""
SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 1 OFFSET {ROW_AT}""")
def q_row_at(spark, sf_dir):
    return row_at(read_table(spark, sf_dir, "benchmark"), ["item_id"], ROW_AT)


@query("preview", "P12", f"""
WITH {CORPUS_CTE}
SELECT id, split, AI, version, text, text_length FROM corpus ORDER BY id LIMIT 5""")
def q_preview(spark, sf_dir):
    return preview(load_corpus(spark, sf_dir).select(*CORPUS_COLUMNS), ["id"], 5)
