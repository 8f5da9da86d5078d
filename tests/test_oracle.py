"""Every query with oracle SQL gives the same bag of rows in Spark and in DuckDB."""

from __future__ import annotations

import pytest

from conftest import SF_MID, SF_SMALL, as_bag, duck

import __spark_entry__ as entry
from provenance_spark.operators.splits import prepare_datasets
from provenance_spark.plans import REGISTRY
from provenance_spark.plans.oracle import CORPUS_CTE, quotas_cte, sample_cte
from provenance_spark.sources.corpus import corpus_from_conversations
from provenance_spark.sources.tables import read_table

SQL = {name: q.sql for name, q in REGISTRY.items() if q.sql}  # those of the llm subpackage have tests of their own
QUERIES = entry.queries()
#: Quotas that the smallest tables can't fill.
LARGER = {"stratified_sample"}


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_MID: duck(SF_MID)}


def test_every_sql_entry_is_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, cons, name):
    sf = SF_MID if name in LARGER else SF_SMALL
    df = QUERIES[name](spark, sf)
    rows, cols = df.collect(), df.columns
    rel = cons[sf].execute(SQL[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert as_bag(cols, rows) == as_bag(ocols, orows)


def test_short_stratum_raises_in_both_engines(spark, cons):
    corpus = corpus_from_conversations(read_table(spark, SF_SMALL, "conversations"))
    with pytest.raises(Exception, match="stratum too small"):
        prepare_datasets(corpus, train_size=200).collect()
    sql = f"WITH {CORPUS_CTE}, {quotas_cte(total={'train': 200})}, {sample_cte()} SELECT * FROM sample"
    with pytest.raises(Exception, match="stratum too small"):
        cons[SF_SMALL].execute(sql).fetchall()


def test_missing_stratum_raises_instead_of_dropping_its_split(spark):
    corpus = corpus_from_conversations(read_table(spark, SF_SMALL, "conversations"))
    with pytest.raises(Exception, match="stratum too small"):
        prepare_datasets(corpus.where("split != 'valid' or version != 'gpt2'")).collect()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {r["split"] for r in df.select("split").distinct().collect()} == {"train", "valid", "test"}
    assert {"id", "split", "version", "AI", "text", "text_length"} <= set(df.columns)
