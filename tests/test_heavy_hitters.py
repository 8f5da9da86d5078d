"""Vocabulary by heavy hitters (F3, L4): bounds of the summaries, proof, exact results whatever the capacity."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provenance_spark.operators import heavy_hitters as hh
from provenance_spark.operators.features import fit_vocabulary

SCHEMA = "doc_id long, term string, tf long"


def zipf_rows(docs=200, words=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(docs):
        drawn = Counter(int(w) for w in rng.zipf(1.3, size=60) if w <= words)
        rows += [(d, f"w{w}", c) for w, c in drawn.items()] + [(d, f"only{d}", 1)]
    return rows


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(1, 5)), max_size=60), st.integers(1, 5))
def test_summary_bounds_hold(rows, capacity):
    s = hh.Summary(capacity)
    for term, tf in rows:
        s.add(pa.array([term]), pa.array([tf]))
    s.settle()
    true, docs = Counter(), Counter(t for t, _ in rows)
    for t, n in rows:
        true[t] += n
    held = {r["term"]: r for r in s.held.to_pylist()}
    assert len(held) <= capacity and s.error * (capacity + 1) <= sum(true.values())
    for t, n in true.items():
        low = held[t]["low"] if t in held else 0
        assert low <= n <= low + s.error
        assert t not in held or held[t]["docs"] <= docs[t]


@pytest.mark.parametrize("min_df,top", [(5, 20), (5, None), (1, 10), (30, 1000), (1, None)])
@pytest.mark.parametrize("capacity", [8, 100, 5000])
def test_vocabulary_is_exact_for_every_capacity(spark, min_df, top, capacity):
    rows = zipf_rows()
    tf = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df, cf = Counter(), Counter()
    for _, t, n in rows:
        df[t] += 1
        cf[t] += n
    want = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t))[:top]
    got = hh.frequent_terms(tf, min_df, top, capacity, max_capacity=capacity)
    vocab = {r["term"]: (r["df"], r["cf"]) for r in fit_vocabulary(got, 200, min_df, top).collect()}
    assert vocab == {t: (df[t], cf[t]) for t in want}


def test_proof_and_candidates(spark):
    rows = zipf_rows()
    tf = spark.createDataFrame(rows, SCHEMA).repartition(2)
    big, small = (hh.candidates(tf, 5, 20, k) for k in (5000, 8))
    assert big.proved and big.error == 0 and not small.proved and small.error >= small.floor
    cf = Counter()
    for _, t, n in rows:
        cf[t] += n
    assert big.floor == sorted(cf.values())[-20]  # the twentieth by count; these are in five documents all
    assert {r["term"] for r in big.terms.collect()} == {t for t in cf if cf[t] >= big.floor}
    mid = hh.candidates(tf, 5, 20, 150)
    assert mid.proved and mid.error > 0 and mid.terms.count() < len(cf) / 2


def test_too_small_summaries_grow_or_give_way(spark):
    tf = spark.createDataFrame(zipf_rows(), SCHEMA).repartition(2)
    n = tf.count()
    assert hh.frequent_terms(tf, 5, 20, 8, 8).count() == n  # nothing proved: all rows
    assert hh.frequent_terms(tf, 5, 20, 8, 4096).count() < n


def test_empty_and_null_terms(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fit_vocabulary(empty, 0, 1, 10, capacity=10).isEmpty()
    odd = spark.createDataFrame([(1, None, 3), (1, "a", 1), (2, "a", 1), (2, "", 1)], SCHEMA)
    assert {r["term"] for r in fit_vocabulary(odd, 2, 1, 10, capacity=10).collect()} == {"a", ""}
