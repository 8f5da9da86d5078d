"""Properties of the positional and sampling operators: W1, W3, S6, P11, L3."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators.positions import first_n_by_key, row_at, with_positions
from provenance_spark.operators.sampling import seeded_pick
from provenance_spark.operators.splits import fraction_cuts, positional_split, prepare_datasets, tail_cuts
from provenance_spark.sources.corpus import corpus_from_conversations
from provenance_spark.sources.tables import read_table


@pytest.fixture(scope="module")
def corpus(spark):
    return corpus_from_conversations(read_table(spark, SF_MID, "conversations")).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_MID, "documents").select("doc_id", "source", "lang").cache()


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_prepared_counts_are_exact_quotas(corpus):
    prepared = prepare_datasets(corpus)
    got = {(r["split"], r["version"]): r["n"]
           for r in prepared.groupBy("split", "version").agg(F.count(F.lit(1)).alias("n")).collect()}
    avail = {(r["split"], r["version"]): r["n"]
             for r in corpus.groupBy("split", "version").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = dict(fv.VERSION_PARTS)
    for split in ("train", "valid", "test"):
        unit = min(avail.get((split, v), 0) // p for v, p in parts.items())
        for v, p in parts.items():
            assert got.get((split, v), 0) == unit * p, (split, v)


def test_sample_is_repeatable_and_partition_independent(corpus):
    one = ids(prepare_datasets(corpus.repartition(1), train_size=256, eval_size=16))
    many = ids(prepare_datasets(corpus.repartition(8, "text"), train_size=256, eval_size=16))
    again = ids(prepare_datasets(corpus, train_size=256, eval_size=16))
    assert one == many == again
    assert len(one) == 256 + 2 * 16
    assert len(set(one)) == len(one)  # without replacement


def test_seed_changes_the_sample(corpus):
    a = ids(prepare_datasets(corpus, train_size=256, eval_size=16, seed=1))
    b = ids(prepare_datasets(corpus, train_size=256, eval_size=16, seed=2))
    assert len(a) == len(b) and a != b


def test_short_stratum_raises(spark):
    small = corpus_from_conversations(read_table(spark, SF_SMALL, "conversations"))
    with pytest.raises(Exception, match="stratum too small"):
        prepare_datasets(small, train_size=200).collect()


def test_positional_split_partitions_input(docs):
    labelled = positional_split(docs, ["doc_id"], ["source"], fraction_cuts(8, 1)).cache()
    assert labelled.count() == docs.count()
    assert ids(labelled, "doc_id") == ids(docs, "doc_id")
    cuts = fraction_cuts(8, 1)
    for r in docs.groupBy("source").count().collect():
        n = r["count"]
        a, b = cuts(n)
        got = {x["split"]: x["c"] for x in labelled.where(F.col("source") == r["source"])
               .groupBy("split").agg(F.count(F.lit(1)).alias("c")).collect()}
        assert (got.get("train", 0), got.get("valid", 0), got.get("test", 0)) == (a, b - a, n - b)


def test_positional_split_matches_sorted_python(docs):
    labelled = positional_split(docs, ["doc_id"], ["lang"], tail_cuts(5, 5)).collect()
    by_lang = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        by_lang.setdefault(r["lang"], []).append(r["doc_id"])
    want = {}
    for lang, ds in by_lang.items():
        n = len(ds)
        for pos, d in enumerate(ds):
            want[d] = "train" if pos < n - 10 else ("valid" if pos < n - 5 else "test")
    assert {r["doc_id"]: r["split"] for r in labelled} == want


def test_with_positions_is_dense_per_group(docs):
    pos = with_positions(docs, ["doc_id"], ["source"], num_partitions=5).collect()
    by_src = {}
    for r in pos:
        by_src.setdefault(r["source"], []).append((r["doc_id"], r["pos"]))
    for rows in by_src.values():
        rows.sort()
        assert [p for _, p in rows] == list(range(len(rows)))


def test_first_n_and_row_at(docs):
    first = ids(first_n_by_key(docs, ["doc_id"], 7, group_by=["source"]), "doc_id")
    want = []
    by_src = {}
    for r in docs.collect():
        by_src.setdefault(r["source"], []).append(r["doc_id"])
    for ds in by_src.values():
        want += sorted(ds)[:7]
    assert first == sorted(want)
    all_ids = ids(docs, "doc_id")
    assert ids(row_at(docs, ["doc_id"], 25), "doc_id") == [all_ids[25]]
    assert row_at(docs, ["doc_id"], len(all_ids) + 3).count() == 0


def test_seeded_pick_is_one_stable_row(corpus):
    a = seeded_pick(corpus, "id", seed=7).collect()
    b = seeded_pick(corpus.repartition(3), "id", seed=7).collect()
    assert len(a) == 1 and a[0]["id"] == b[0]["id"]


def test_positional_split_with_many_groups_and_clashing_names(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 2000 AS g", "id AS pos", "id AS _cut2")
    out = positional_split(rows, ["pos"], ["g"], fraction_cuts(8, 1))
    got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 16_000, "valid": 2_000, "test": 2_000}
    assert first_n_by_key(rows, ["pos"], 3).count() == 3


def test_positional_split_keeps_null_groups_and_short_ones(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    got = {r["id"]: r["split"] for r in positional_split(rows, ["id"], ["g"], tail_cuts(1, 1)).collect()}
    assert got == {1: "valid", 2: "test", 3: "test"}
    assert positional_split(rows.limit(0), ["id"], ["g"], tail_cuts(1, 1)).count() == 0
