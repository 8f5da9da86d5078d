"""Model registry (S11, S12): versioned model folders, and a commit log that decides which of them is the best.

A model counts from the moment its entry stands in the log, never before and never half:

1. the model is written whole into a folder of its own, which nobody reads yet;
2. its entry (score and folder) is put into the log as the next number, if no other entry took that number. That single step is the commit;
3. if another writer was first, the best score is read again: the entry moves on to the next number if it still beats it, and is given up if not.

So scores in the log only rise and the last entry is the best model. A crash before step 2 leaves a folder that nothing names; the models
before stay as they are. Every run, saved or not, also leaves a row in a score table, in a folder of its own; that is history and decides nothing.

A model is saved only when its score is strictly greater than the best so far for the same (head, checkpoint, train size), starting at 0.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from provenance_spark.operators.dense import DenseModel
from provenance_spark.operators.heads import RidgeModel
from provenance_spark.sources.materialize import cache_key, is_complete, list_files, local_path

COMMIT_SCHEMA = "number long, score double, folder string"
#: What stands in a folder besides ML pipelines; the columns tell which model it is.
DENSE_SCHEMA = "layers array<int>, theta array<double>, history array<double>"
RIDGE_SCHEMA = "coef array<double>, intercept double, alpha double"
SCORE_SCHEMA = T.StructType([
    T.StructField("head", T.StringType()),
    T.StructField("ckpt", T.StringType()),
    T.StructField("train_size", T.LongType()),
    T.StructField("test_score", T.DoubleType()),
    T.StructField("saved", T.BooleanType()),
    T.StructField("ts", T.TimestampType()),
])


def save_model(spark: SparkSession, model, path: str) -> None:
    """An ML model as a ``PipelineModel``; a ridge model or a dense network as one Parquet row."""
    from pyspark.ml import PipelineModel
    if isinstance(model, RidgeModel):
        row = [([float(x) for x in model.coef], float(model.intercept), float(model.alpha))]
        spark.createDataFrame(row, RIDGE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    elif isinstance(model, DenseModel):
        row = [([int(n) for n in model.layers], [float(x) for x in model.theta], [float(x) for x in model.history])]
        spark.createDataFrame(row, DENSE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        whole = model if isinstance(model, PipelineModel) else PipelineModel([model])
        whole.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """What :func:`save_model` has stored."""
    from pyspark.ml import PipelineModel
    if is_complete(spark, path):
        row = spark.read.parquet(path).first()
        if "theta" in row.asDict():
            return DenseModel(tuple(row["layers"]), np.array(row["theta"]), list(row["history"]))
        return RidgeModel(np.array(row["coef"]), row["intercept"], row["alpha"])
    return PipelineModel.load(path)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole under ``path`` unless something stands there; of several writers one alone gets True.

    The text goes to a hidden file first, which then takes the name: by a hard link on a local disk, by a rename that refuses to
    overwrite elsewhere. Both are single steps of the file system (HDFS among them; an object store must offer such a rename).
    """
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    store.mkdirs(target.getParent())
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = store.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.getUri().getScheme() == "file":
            os.link(local_path(store.makeQualified(hidden).toString()), local_path(store.makeQualified(target).toString()))
        else:
            options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(hidden, target, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    finally:
        store.delete(hidden, False)


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def scores_path(self) -> str:
        return f"{self.root}/model_scores"

    def log_path(self, head: str, ckpt: str, train_size: int) -> str:
        return f"{self.root}/commits/{cache_key(head, ckpt, train_size)}"

    def commits(self, head: str, ckpt: str, train_size: int) -> list[dict]:
        """The entries of one log in order: number, score, folder. A log has an entry for each improvement, so it is short."""
        path = self.log_path(head, ckpt, train_size)
        if not list_files(self.spark, path):
            return []
        return sorted((r.asDict() for r in self.spark.read.schema(COMMIT_SCHEMA).json(path).collect()), key=lambda r: r["number"])

    def best_score(self, head: str, ckpt: str, train_size: int) -> float:
        found = self.commits(head, ckpt, train_size)
        return float(found[-1]["score"]) if found else 0.0

    def record(self, head: str, ckpt: str, train_size: int, test_score: float, model) -> bool:
        """Log the run; save and commit ``model`` (an ML ``Model`` with ``write()``) iff it beats the best."""
        folder = f"{cache_key(head, ckpt, train_size)}/{uuid.uuid4().hex}"
        written = saved = False
        while not saved:
            found = self.commits(head, ckpt, train_size)
            if not test_score > (found[-1]["score"] if found else 0.0):  # a score that isn't a number never does
                break
            if not written:
                save_model(self.spark, model, f"{self.root}/models/{folder}")
                written = True
            number = found[-1]["number"] + 1 if found else 0
            entry = json.dumps({"number": number, "score": float(test_score), "folder": folder})
            saved = put_if_absent(self.spark, f"{self.log_path(head, ckpt, train_size)}/{number:010d}.json", entry)
        row = [(head, ckpt, int(train_size), float(test_score), saved, dt.datetime.now(dt.timezone.utc))]
        self.spark.createDataFrame(row, SCORE_SCHEMA).coalesce(1).write.parquet(f"{self.scores_path}/run={uuid.uuid4().hex}")
        return saved

    def load(self, head: str, ckpt: str, train_size: int):
        """The best model; KeyError if there is none."""
        found = self.commits(head, ckpt, train_size)
        if not found:
            raise KeyError(f"no model of {head}, {ckpt}, {train_size}")
        return load_model(self.spark, f"{self.root}/models/{found[-1]['folder']}")

    def has_model(self, head: str, ckpt: str, train_size: int) -> bool:
        return bool(self.commits(head, ckpt, train_size))
