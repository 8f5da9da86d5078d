"""ST1 / G5: score arriving texts with Structured Streaming (stateless, same transform as batch).

The stream reads Parquet files as they land, applies ``DetectorModel.transform`` (the encoder is
loaded once per Python worker) and appends ``{id, Probability, Prediction}`` to a Parquet sink with
a checkpoint in the shared folder, so a restarted query resumes without rescoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.operators.detector import DetectorModel


def score_stream(spark: SparkSession, source: DataFrame, model: DetectorModel, out_dir: str, checkpoint_dir: str,
                 id_col: str = "id", text_col: str = "text", available_now: bool = True):
    """Start the scoring stream over ``source`` (a streaming DataFrame); returns the query."""
    scored = model.transform(source.select(id_col, text_col), text_col).select(id_col, "Probability", "Prediction")
    writer = (scored.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(out_dir)


def conversation_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The ``conversations`` table read as a file stream: only that table of the folder, whether it is one file or a folder of files.

    The table is named by a pattern: a stream's path may not be a plain file.
    """
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(f"{sf_dir.rstrip('/')}/{{conversations.parquet}}"))
    return (raw.where(F.col("role") != "system")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
