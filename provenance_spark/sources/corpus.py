"""The labelled corpus: human and machine texts with ``split``, ``AI``, ``version``, ``text_length``.

Two ways in:

* :func:`corpus_from_conversations` derives the corpus from the ``conversations`` table
  (user turns are human, assistant turns machine-written; the machine version is picked by the
  first hex digit of ``md5(id)``; the split by ``conv_id % 10``). The same rule is written in SQL
  in :mod:`provenance_spark.plans.oracle` so both engines see identical rows.
* :func:`load_labelled_csv` reads per-split CSV files, one machine file and one human file per
  split, with optional row caps, the way the original corpora are shipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenance_spark.functions.text import normalize_newlines, text_length
from provenance_spark.operators.permute import permutation, with_place
from provenance_spark.sources.materialize import CSV_NULL
from provenance_spark.sources.split_csv import CsvScan, scan_csv

SPLITS = ("train", "valid", "test")
CORPUS_COLUMNS = ("id", "split", "AI", "version", "text", "text_length")


def split_of(conv_id: Column) -> Column:
    """``conv_id % 10``: 0-5 train, 6-7 valid, 8-9 test (a conversation never straddles splits)."""
    bucket = F.pmod(conv_id, F.lit(10))
    return F.when(bucket < 6, "train").when(bucket < 8, "valid").otherwise("test")


def version_of(role: Column, row_id: Column) -> Column:
    """Human for user turns; for machine turns gpt2 / gpt3 / gpt3.5 by the first hex digit of md5(id)."""
    digit = F.substring(F.md5(row_id.cast("string")), 1, 1)
    return (F.when(role == "user", "human")
            .when(digit.isin("0", "1", "2", "3"), "gpt2")
            .when(digit.isin("4", "5", "6", "7"), "gpt3")
            .otherwise("gpt3.5"))


def corpus_from_conversations(conversations: DataFrame) -> DataFrame:
    """Corpus rows (S1 P1-P5 U1): drop system turns, label, normalise newlines, measure length."""
    row_id = F.col("conv_id") * 1000 + F.col("turn")
    text = normalize_newlines(F.col("text"))
    return (conversations
            .where(F.col("role") != "system")
            .select(row_id.alias("id"),
                    split_of(F.col("conv_id")).alias("split"),
                    F.when(F.col("role") == "user", 0).otherwise(1).alias("AI"),
                    version_of(F.col("role"), row_id).alias("version"),
                    text.alias("text"))
            .withColumn("text_length", text_length(F.col("text"))))


@dataclass(frozen=True)
class CsvCorpusConfig:
    """Where the per-split corpus CSV files are and how much of them to read.

    ``machine_source`` and ``truncation`` form the machine file name (``{source}-k40.{split}.csv``
    with truncation, ``{source}.{split}.csv`` without); the human file is ``{human_source}.{split}.csv``.
    ``train_cap`` / ``eval_cap`` are total rows per split (half per class); ``None`` reads everything.
    """

    root: str
    machine_source: str = "xl-1542M"
    human_source: str = "webtext"
    truncation: bool = True
    train_cap: int | None = 500_000
    eval_cap: int | None = None

    def machine_path(self, split: str) -> str:
        suffix = "-k40" if self.truncation else ""
        return f"{self.root.rstrip('/')}/{self.machine_source}{suffix}.{split}.csv"

    def human_path(self, split: str) -> str:
        return f"{self.root.rstrip('/')}/{self.human_source}.{split}.csv"


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan keeping only ``text`` (quoted newlines allowed), of files with any columns around it."""
    return scan_csv(spark, {"csv": path}, ["text"], null_value=CSV_NULL).select("text")


def load_labelled_csv(spark: SparkSession, cfg: CsvCorpusConfig, shuffle: int | None = None) -> DataFrame:
    """One DataFrame for all splits: ``text``, ``file``, ``pos``, ``AI``, ``split``.

    Row caps keep the first ``cap // 2`` rows of each file in file order (S6), rows with a null text
    included; null texts are dropped after the cap, and :func:`null_texts` counts them. ``pos`` is the row's number in its
    file, or in the files of its folder by name.

    With ``shuffle`` (a seed) each split's rows, human before machine, are shuffled whole (S1c, L2): ``place`` says where a row
    stands then. Null texts have a place before they are dropped.
    """
    return _labelled_csv(spark, cfg, shuffle).where(F.col("text").isNotNull())


def null_texts(spark: SparkSession, cfg: CsvCorpusConfig) -> DataFrame:
    """Rows per (split, AI) whose text is null: what :func:`load_labelled_csv` leaves out."""
    return (_labelled_csv(spark, cfg).groupBy("split", "AI")
            .agg(F.count(F.when(F.col("text").isNull(), 1)).alias("n_null")))


def _labelled_csv(spark: SparkSession, cfg: CsvCorpusConfig, shuffle: int | None = None) -> DataFrame:
    """Every row within the caps, all files in one scan."""
    paths = {f"{split} {ai}": path for split in SPLITS for path, ai in ((cfg.human_path(split), 0), (cfg.machine_path(split), 1))}
    caps = {split: cfg.train_cap if split == "train" else cfg.eval_cap for split in SPLITS}
    halves = {s: None if caps[s.split()[0]] is None else caps[s.split()[0]] // 2 for s in paths}
    scan = CsvScan(spark, paths, null_value=CSV_NULL)
    rows = scan.rows(["text"], halves)
    label = F.split("source", " ")
    out = rows.select("text", "file", "pos", label[1].cast("int").alias("AI"), label[0].alias("split"))
    if shuffle is None:
        return out
    taken = {s: n if halves[s] is None else min(n, halves[s]) for s, n in scan.totals.items()}
    human = F.create_map(*[x for s in SPLITS for x in (F.lit(s), F.lit(taken[f"{s} 0"]).cast("long"))])[F.col("split")]
    at = F.col("pos") + F.when(F.col("AI") == 1, human).otherwise(0)
    return with_place(out, at, {s: permutation(taken[f"{s} 0"] + taken[f"{s} 1"], shuffle) for s in SPLITS}, by=F.col("split"))


def with_version(df: DataFrame, machine_version: str = "gpt2") -> DataFrame:
    """``version`` = the machine version for AI rows, ``human`` otherwise."""
    return df.withColumn("version", F.when(F.col("AI") == 1, F.lit(machine_version)).otherwise("human"))


def external_corpus(df: DataFrame, text_col: str, version: str, keep: tuple = ()) -> DataFrame:
    """Take an extra machine corpus, rename its text column, label it AI with a fixed version."""
    text = normalize_newlines(F.col(text_col))
    return (df.select(*keep, text.alias("text"))
              .withColumn("AI", F.lit(1))
              .withColumn("version", F.lit(version))
              .withColumn("text_length", text_length(F.col("text"))))
