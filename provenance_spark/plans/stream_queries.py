"""Streaming queries (ST1 / G5 scoring, ST2 incremental fitting) and the CSV round trip."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators import sgd
from provenance_spark.plans.model_queries import prepared, trained_detector
from provenance_spark.plans.registry import query
from provenance_spark.session import workspace_path
from provenance_spark.sources.materialize import read_csv, write_csv
from provenance_spark.sources.tables import read_table
from provenance_spark.streaming.incremental import IncrementalSGD, hashed_rows
from provenance_spark.streaming.scoring import conversation_stream, score_stream


@query("csv_roundtrip", "S4 S5 S8", """
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def q_csv_roundtrip(spark, sf_dir):
    path = workspace_path(spark, "documents_csv")
    write_csv(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    back = read_csv(spark, path, schema)
    return back.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))


@query("score_stream", "ST1 G5 G1")
def q_score_stream(spark, sf_dir):
    model = trained_detector(spark, sf_dir, "lr")
    out, ckpt = workspace_path(spark, "scores"), workspace_path(spark, "scores_ckpt")
    q = score_stream(spark, conversation_stream(spark, sf_dir), model, out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out).select("id", F.round("Probability", 6).alias("Probability"), "Prediction")


STREAM_FILES = 4


@query("incremental_fit", "ST2 M6 F12")
def q_incremental_fit(spark, sf_dir):
    p = prepared(spark, sf_dir)
    landing = workspace_path(spark, "train_landing")
    (p.where(F.col("split") == "train").select("id", "text", "AI")
     .repartition(STREAM_FILES, "id").write.parquet(landing))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("AI", T.IntegerType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    handler = IncrementalSGD(spark, workspace_path(spark, "sgd_state"))
    q = (stream.writeStream.foreachBatch(handler).trigger(availableNow=True)
         .option("checkpointLocation", workspace_path(spark, "sgd_ckpt")).start())
    q.awaitTermination()
    W, b, last = handler.weights()
    batches = len(handler.stored_batches())
    held_out = hashed_rows(p.where(F.col("split").isin("valid", "test")).select("split", "text", "AI"),
                           num_features=handler.dim).withColumnRenamed("AI", "y")
    ev = sgd.evaluate(held_out, W, b, fv.SGD_LOSSES, compact=True)
    wide = ev.groupBy("loss").agg(
        F.max(F.when(F.col("split") == "valid", F.col("accuracy"))).alias("valid_accuracy"),
        F.max(F.when(F.col("split") == "test", F.col("accuracy"))).alias("test_accuracy"))
    return wide.withColumn("batches", F.lit(batches)).withColumn("last_batch", F.lit(last))
