"""The subpackage's queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenance_spark.llm import (conversation_repair, decontaminate_ac, html_lineblock, langid_ppm, license_index, line_site, mix_budget,
                                  quality_fm, quality_llr, search_taat, simhash_cover, topk_nra, warc_zdict)
from provenance_spark.llm import sql as oracle
from provenance_spark.llm.common import held_out, table
from provenance_spark.session import ship_package, workspace_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = oracle.ORACLE

PREDICT_AT = 0.3
TOP_K = 20
RANKED = 20
QUERY_STEP = 20
HOST = "source"
TARGETS = mix_budget.Targets(domain=oracle.DOMAIN_WEIGHTS, language=oracle.LANGUAGE_WEIGHTS)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = build
    return build


@query
def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"), learn_from=~held_out(F.col("doc_id"), 5, 0))
    return quality_fm.annotate(docs, machine).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


@query
def op2_html_lineblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lineblock.extract_pages(table(spark, sf_dir, "pages"))


@query
def op3_decontaminate_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate_ac.annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(*decontaminate_ac.digest("found"))


@query
def op4_warc_zdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zdict.write_archives(table(spark, sf_dir, "pages"), workspace_path(spark, "warc"))
    return warc_zdict.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_STEP == 0, TOP_K)


@query
def op6_langid_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid_ppm.annotate(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("language")["lang"].alias("lang_pred"),
                        F.col("language")["score"].alias("score"))


def language_model(docs: DataFrame) -> langid_ppm.Model:
    """Trees learnt from the rows of ``docs`` that aren't held out."""
    return langid_ppm.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)), "lang", "text", F.col("doc_id"))


@query
def op7_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_cover.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix_budget.mixture(table(spark, sf_dir, "documents"), TARGETS, oracle.BUDGET_SHARE, oracle.MAX_EPOCHS, oracle.SEED)
    return taken.withColumnRenamed("id", "doc_id")


@query
def op9_line_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", HOST)
    return line_site.annotate(docs, HOST, "text").select("doc_id", "kept.*")


@query
def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(conversation_repair.repaired(rows))


@query
def op12_search_taat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_taat.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), RANKED)


@query
def op13_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    weights = quality_llr.fit(docs, quality_llr.trusted_ids(table(spark, sf_dir, "labels"), good))
    return quality_llr.annotate(docs, weights).select("doc_id", "rules.*")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
