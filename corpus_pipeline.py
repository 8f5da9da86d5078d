"""Documents to a training mixture: five stages, each calling one operator of ``provenance_spark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a stage's rows as Parquet into the shared
checkpoint folder and reads them again for the next, so a lost executor costs a stage at most. All stages but the last
return the columns of documents, further columns of any name included; the last adds ``epoch``.

Every stage gives no rows for an empty table, and takes whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenance_spark.llm import decontaminate_ac, langid_ppm, line_site, mix_budget, simhash_cover
from provenance_spark.llm.common import table
from provenance_spark.llm.queries import HOST, TARGETS, language_model
from provenance_spark.llm.sql import BUDGET_SHARE, MAX_EPOCHS, SEED
from provenance_spark.session import ship_package, workspace_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and texts without a letter go. Rows that repeat are judged each."""
    ship_package(spark)
    return langid_ppm.known_language(docs, language_model(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that are boilerplate of their source; n_chars follows the text. No row goes, null texts included."""
    return line_site.cleaned(docs, HOST).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id. Rows that repeat it are one row; a null doc_id stays."""
    ship_package(spark)
    return simhash_cover.keep_one(docs, shingle=simhash_cover.SHINGLE, radius=simhash_cover.RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts hold none."""
    ship_package(spark)
    return decontaminate_ac.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for the mixture, once for each epoch."""
    return mix_budget.mixed(docs, TARGETS, BUDGET_SHARE, MAX_EPOCHS, SEED)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing)]

#: Context-tree code lengths and XXH64 fingerprints aren't SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        path = workspace_path(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
