"""Splittable CSV against Spark's one-task reader, and the seeded full shuffle."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenance_spark.operators import permute
from provenance_spark.session import workspace_path
from provenance_spark.sources.materialize import local_path
from provenance_spark.sources.split_csv import CsvScan, Grammar, scan_csv

CELLS = ["plain", 'with "stray" quote', "", "a,b", "x\ny\r\nz", 'say "hi" ', '"', ",", '"\n', "\n\n\n", "é" * 50, "long " * 60 + "\n" + "more\n" * 40, "\\N"]


@pytest.fixture
def many_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path: str, eol: str, rng: random.Random, rows: int = 300) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(f'id,text,"other"{eol}')
        for i in range(rows):
            t = rng.choice(CELLS)
            quoted = rng.random() < 0.6 or any(c in t for c in ",\n") or t.startswith('"')
            f.write(f"{i}," + ('"' + t.replace('"', '""') + '"' if quoted else t) + f",z{eol}" + (eol if rng.random() < 0.05 else ""))


def one_task(spark, path):
    reader = spark.read.option("multiLine", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").option("header", True)
    return [(i, r["id"], r["text"]) for i, r in enumerate(reader.csv(path).collect())]


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_equals_the_one_task_reader(many_splits, eol):
    spark = many_splits
    for seed in range(3):
        path = f"{local_path(workspace_path(spark, 'split_csv'))}/a.csv"
        write(path, eol, random.Random(seed))
        got = scan_csv(spark, {"s": path}, ["id", "text"])
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 15
        want = one_task(spark, path)
        assert len(want) == 300 and [(r["pos"], r["id"], r["text"]) for r in got.orderBy("pos").collect()] == want
        capped = scan_csv(spark, {"s": path}, ["text"], first_rows=77)
        assert [(r["pos"], r["text"]) for r in capped.orderBy("pos").collect()] == [(p, t) for p, _, t in want[:77]]


def test_sources_folders_and_empty_files(many_splits):
    spark = many_splits
    root = local_path(workspace_path(spark, "split_csv"))
    write(f"{root}/a/part-0.csv", "\n", random.Random(1), 40)
    write(f"{root}/a/part-1.csv", "\n", random.Random(2), 40)
    write(f"{root}/b/part-0.csv", "\n", random.Random(3), 0)
    open(f"{root}/b/part-1.csv", "w").close()
    scan = CsvScan(spark, {"a": f"{root}/a", "b": f"{root}/b"})
    assert scan.totals == {"a": 80, "b": 0}
    rows = scan.rows(["id"], {"a": 70}).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(70)) and [r["id"] for r in rows] == [str(i) for i in [*range(40), *range(30)]]
    with pytest.raises(Exception, match="no column"):
        scan.rows(["nowhere"]).collect()


def test_changed_splits_fail(many_splits):
    spark = many_splits
    path = f"{local_path(workspace_path(spark, 'split_csv'))}/a.csv"
    write(path, "\n", random.Random(5))
    scan = CsvScan(spark, {"s": path})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
    with pytest.raises(Exception, match="splits changed"):
        scan.rows(["id"]).collect()


def test_long_lines_of_quotes_take_linear_time():
    grammar = Grammar(",")
    line = b'"' + b'""' * 300_000 + b'a",' * 100_000 + b'"open'
    assert grammar.stays_open(line, False) in (True, False) and grammar.stays_open(b"x" * 10 ** 6 + b'"', True) is False
    assert grammar.fields(b'a,"b ""c"" d",,"",e') == [b"a", b'b "c" d', None, b"", b"e"]


def test_permutation_is_one_for_every_size():
    for n in [*range(300), 1000, 4096, 99_999]:
        p = permute.permutation(n, 7)
        x = np.arange(n, dtype=np.int64)
        y = permute.apply_once(p, x)
        for _ in range(p.times - 1):
            y = np.where(y >= n, permute.apply_once(p, y), y)
        assert np.array_equal(np.sort(y), x)
    a, b = permute.apply_once(permute.permutation(10_000, 1), np.arange(10_000)), permute.apply_once(permute.permutation(10_000, 2), np.arange(10_000))
    assert abs(np.corrcoef(np.arange(10_000), a)[0, 1]) < 0.05 and (a == b).mean() < 0.01


def test_shuffle_is_the_same_for_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("v"))
    orders = []
    for before, after in ((1, 1), (7, 5), (3, 8)):
        out = permute.shuffle_table(df.repartition(before), ["k"], 11, partitions=after)
        assert out.rdd.getNumPartitions() == after
        rows = out.collect()  # partitions in order
        assert [r["place"] for r in rows] == list(range(1000))
        orders.append([r["k"] for r in rows])
    assert orders[0] == orders[1] == orders[2] != sorted(orders[0])
    assert permute.shuffle_table(df.limit(0), ["k"], 11).count() == 0
