"""Streaming = batch: ST1 scores equal G1 on the same rows; ST2 replays are idempotent."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL

from provenance_spark.plans.model_queries import trained_detector
from provenance_spark.session import workspace_path
from provenance_spark.sources.tables import read_table
from provenance_spark.streaming.incremental import IncrementalSGD
from provenance_spark.streaming.scoring import conversation_stream, score_stream


@pytest.fixture(scope="module")
def model(spark):
    return trained_detector(spark, SF_MID, "lr")


def test_stream_scores_equal_batch_scores(spark, model):
    texts = (read_table(spark, SF_SMALL, "conversations").where(F.col("role") != "system")
             .select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    batch = {r["id"]: (round(r["Probability"], 9), r["Prediction"]) for r in model.transform(texts).collect()}
    out, ckpt = workspace_path(spark, "st_out"), workspace_path(spark, "st_ckpt")
    score_stream(spark, conversation_stream(spark, SF_SMALL), model, out, ckpt).awaitTermination()
    stream = {r["id"]: (round(r["Probability"], 9), r["Prediction"]) for r in spark.read.parquet(out).collect()}
    assert stream == batch
    # a restart from the same checkpoint finds nothing new and rescoring nothing
    score_stream(spark, conversation_stream(spark, SF_SMALL), model, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == len(batch)


def test_incremental_replay_leaves_weights_unchanged(spark):
    rows = [(i, f"text number {i} {'machine words' if i % 2 else 'human voice'}", i % 2) for i in range(40)]
    batch = spark.createDataFrame(rows, "id long, text string, AI int")
    handler = IncrementalSGD(spark, workspace_path(spark, "sgd_state"), num_features=1 << 10)
    handler(batch, 0)
    W0, b0, last0 = handler.weights()
    handler(batch, 0)  # replay of batch 0
    W1, b1, last1 = handler.weights()
    assert last0 == last1 == 0
    assert np.array_equal(W0, W1) and np.array_equal(b0, b1)
    handler(batch, 1)
    W2, _, last2 = handler.weights()
    assert last2 == 1 and not np.array_equal(W0, W2)


def test_conversations_stream_from_a_folder_of_files(spark):
    base = workspace_path(spark, "tables")
    rows = read_table(spark, SF_SMALL, "conversations")
    rows.repartition(3).write.parquet(f"{base}/conversations.parquet")
    rows.limit(5).write.parquet(f"{base}/other.parquet")
    q = conversation_stream(spark, base).writeStream.format("memory").queryName("from_folder").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("from_folder").count() == rows.where(F.col("role") != "system").count() > 0


def test_a_task_unpacks_few_rows_at_once_with_the_same_steps(spark):
    import pandas as pd
    from provenance_spark.operators import sgd
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"idx": [rng.integers(0, 50, 7) for _ in range(700)], "val": [np.ones(7)] * 700, "y": rng.integers(0, 2, 700)})
    parts = list(sgd.pieces(rows))
    assert max(map(len, parts)) <= sgd.HELD and sum(map(len, parts)) == 700
    W, b, V, c, at = np.zeros((5, 50)), np.zeros(5), np.zeros((5, 50)), np.zeros(5), 0
    sgd.sgd_epoch(rows, W, b, sgd.fv.SGD_LOSSES, 0, True)
    for p in parts:
        at = sgd.sgd_epoch(p, V, c, sgd.fv.SGD_LOSSES, at, True)
    assert np.array_equal(W, V) and np.array_equal(b, c)
