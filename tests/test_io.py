"""Sources and sinks: materialise once (S10), CSV round trip (S4 S5 S8), model registry gate."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

from provenance_spark.session import workspace_path
from provenance_spark.sources.materialize import cache_key, materialize, read_csv, write_csv
from provenance_spark.sources.materialize import local_path


def test_cache_key_flattens_checkpoint_names():
    assert cache_key("hidden", "org/model-base", 70000) == "hidden_org-model-base_70000"


def test_materialize_hit_miss_and_half_written(spark):
    root = workspace_path(spark, "mat")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")

    assert materialize(spark, root, "k", build).count() == 2
    assert materialize(spark, root, "k", build).count() == 2
    assert len(calls) == 1  # second call is a hit
    os.remove(os.path.join(local_path(root), "k", "_SUCCESS"))  # simulate a half-written stage
    assert materialize(spark, root, "k", build).count() == 2
    assert len(calls) == 2
    assert {"_SUCCESS", "split=test", "split=train"} <= set(os.listdir(os.path.join(local_path(root), "k")))


def test_csv_round_trip_keeps_newlines_and_quotes(spark):
    path = workspace_path(spark, "csv")
    rows = [(1, 'he said "hi"\nthen left'), (2, "a,b,c"), (3, "")]
    write_csv(spark.createDataFrame(rows, "doc_id long, text string"), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    back = sorted((r[0], r[1]) for r in read_csv(spark, path, schema).collect())
    assert back[0] == rows[0] and back[1] == rows[1]
    assert back[2][1] == ""


def test_labelled_csv_with_caps_quoted_newlines_and_empty_cells(spark):
    from provenance_spark.sources.corpus import CsvCorpusConfig, load_labelled_csv, null_texts
    cfg = CsvCorpusConfig(workspace_path(spark, "corpus"), train_cap=6, eval_cap=None)
    texts = ["a\nb", "", 'say "x"', None, "last", "beyond"]
    for split in ("train", "valid", "test"):
        for path in (cfg.human_path(split), cfg.machine_path(split)):
            rows = [(t, i, "p") for i, t in enumerate(texts if split == "train" else texts[2:])]
            write_csv(spark.createDataFrame(rows, "text string, pos int, file string").coalesce(1), path)
    got = load_labelled_csv(spark, cfg)
    for ai in (0, 1):
        assert sorted(r["text"] for r in got.where(f"split = 'train' and AI = {ai}").collect()) == sorted(texts[:3])
        assert sorted(r["text"] for r in got.where(f"split = 'test' and AI = {ai}").collect()) == sorted(['say "x"', "last", "beyond"])
    assert {(r["split"], r["AI"], r["n_null"]) for r in null_texts(spark, cfg).collect()} == {
        (s, a, int(s != "train")) for s in ("train", "valid", "test") for a in (0, 1)}


def test_registry_saves_only_strict_improvements(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from provenance_spark.sources.registry import ModelRegistry
    df = spark.createDataFrame([(1.0,)], "x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(df)
    reg = ModelRegistry(spark, workspace_path(spark, "registry"))
    assert reg.best_score("lr", "ckpt/a", 100) == 0.0
    assert reg.record("lr", "ckpt/a", 100, 0.7, model) is True
    assert reg.record("lr", "ckpt/a", 100, 0.7, model) is False  # equal is not better
    assert reg.record("lr", "ckpt/a", 100, 0.6, model) is False
    assert reg.record("lr", "ckpt/a", 100, 0.8, model) is True
    assert reg.best_score("lr", "ckpt/a", 100) == pytest.approx(0.8)
    assert reg.has_model("lr", "ckpt/a", 100)
    assert reg.load("lr", "ckpt/a", 100).transform(df).count() == 1


@pytest.fixture
def one_stage(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1.0,)], "x double")
    return df, lambda name: Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol=name)]).fit(df)


def test_a_failed_save_keeps_the_best_model(spark, one_stage, monkeypatch):
    from provenance_spark.sources import registry as reg
    df, make = one_stage
    r = reg.ModelRegistry(spark, workspace_path(spark, "registry"))
    assert r.record("lr", "c", 1, 0.5, make("a"))
    whole = reg.save_model

    def fail(spark_, model, path):
        whole(spark_, model, path)
        raise OSError("the writer died")

    monkeypatch.setattr(reg, "save_model", fail)
    with pytest.raises(OSError, match="died"):
        r.record("lr", "c", 1, 0.9, make("b"))
    assert r.best_score("lr", "c", 1) == 0.5 and "a" in r.load("lr", "c", 1).transform(df).columns
    monkeypatch.setattr(reg, "save_model", whole)
    monkeypatch.setattr(reg, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("died before the commit")))
    with pytest.raises(OSError, match="before"):
        r.record("lr", "c", 1, 0.9, make("b"))
    assert r.best_score("lr", "c", 1) == 0.5
    monkeypatch.undo()
    assert r.record("lr", "c", 1, 0.6, make("c")) and "c" in r.load("lr", "c", 1).transform(df).columns
    with pytest.raises(KeyError):
        r.load("ridge", "c", 1)


def test_racing_writers_leave_the_best(spark, one_stage):
    from concurrent.futures import ThreadPoolExecutor

    from provenance_spark.sources.registry import ModelRegistry, put_if_absent
    df, make = one_stage
    root = workspace_path(spark, "registry")
    scores = [0.3, 0.9, 0.5, 0.7, 0.8, 0.2]
    models = [make(f"m{int(10 * s)}") for s in scores]
    with ThreadPoolExecutor(len(scores)) as pool:
        saved = list(pool.map(lambda x: ModelRegistry(spark, root).record("lr", "c", 1, *x), zip(scores, models, strict=True)))
        once = list(pool.map(lambda i: put_if_absent(spark, f"{root}/one", str(i)), range(8)))
    r = ModelRegistry(spark, root)
    found = r.commits("lr", "c", 1)
    assert saved[1] and sum(once) == 1 and len(found) == sum(saved)
    assert [x["number"] for x in found] == list(range(len(found))) and [x["score"] for x in found] == sorted(x["score"] for x in found)
    assert r.best_score("lr", "c", 1) == 0.9 and "m9" in r.load("lr", "c", 1).transform(df).columns
    assert spark.read.parquet(r.scores_path).count() == len(scores)
