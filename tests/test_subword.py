"""Word pieces by failure links against plain greedy matching."""

from __future__ import annotations

import random
import time

import pytest

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators import subword as sub


def greedy(word, begin, go_on):
    out, start = [], 0
    while start < len(word):
        held = begin if start == 0 else go_on
        end = next((e for e in range(len(word), start, -1) if word[start:e] in held), None)
        if end is None:
            return [fv.UNK_ID]
        out.append(held[word[start:end]])
        start = end
    return out


def test_equals_greedy_matching():
    rng = random.Random(1)
    for _ in range(1500):
        parts = [{"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))} for _ in range(2)]
        begin, go_on = ({x: i + 10 + 90 * n for i, x in enumerate(sorted(p))} for n, p in enumerate(parts))
        split = sub.Segmenter([(x, False, i) for x, i in begin.items()] + [(x, True, i) for x, i in go_on.items()])
        for _ in range(15):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            assert split(word) == greedy(word, begin, go_on)


def test_long_unmatched_words_take_linear_time():
    split = sub.Segmenter([("a" * k, c, k) for k in range(1, 60) for c in (False, True)])
    start = time.process_time()
    assert split("a" * 2_000_000 + "b") == [fv.UNK_ID]
    assert time.process_time() - start < 10


def test_encoding_of_awkward_rows_and_padding(spark):
    vocabulary = spark.createDataFrame([("un", False, 7), ("able", True, 8), ("do", True, 9), ("x", False, 10)], "piece string, continues boolean, id int")
    rows = [(1, ["undoable", "zzz", None, "x"]), (2, []), (3, None), (4, ["x"] * 300), (5, [""])]
    d = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    got = {r["doc_id"]: (r["input_ids"], r["attention_mask"]) for r in sub.encode_subwords(d, vocabulary, "doc_id", "tokens").collect()}
    ends = lambda ids: [fv.CLS_ID, *ids, fv.SEP_ID]
    assert got[1][0] == ends([7, 9, 8, fv.UNK_ID, 10]) and got[2][0] == got[3][0] == got[5][0] == ends([]) and got[4][0] == ends([10] * 300)
    assert all(m == [1] * len(i) for i, m in got.values())
    cut = {r["doc_id"]: (r["input_ids"], r["attention_mask"]) for r in sub.encode_subwords(d, vocabulary, "doc_id", "tokens", max_len=6).collect()}
    assert cut[4] == (ends([10] * 4), [1] * 6) and cut[2] == ([*ends([]), 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])
    assert sub.encode_subwords(d.limit(0), vocabulary, "doc_id", "tokens").count() == 0
    assert sub.encode_subwords(d, vocabulary.limit(0), "doc_id", "tokens").where("doc_id = 4").first()["input_ids"] == ends([fv.UNK_ID] * 300)


def test_vocabulary_bound(spark, monkeypatch):
    monkeypatch.setattr(sub, "MAX_PIECES", 2)
    vocabulary = spark.createDataFrame([("a", False, 1), ("b", False, 2), ("c", False, 3)], "piece string, continues boolean, id int")
    with pytest.raises(ValueError, match="at most"):
        sub.segmented(spark.createDataFrame([("a",)], "word string"), vocabulary)


def test_texts_with_their_own_id_cross_no_network(spark):
    from provenance_spark.operators import subword as sub
    vocab = spark.createDataFrame([("a", False, 10), ("b", True, 11), ("ab", False, 12)], "piece string, continues boolean, id int")
    df = spark.createDataFrame([(1, ["ab", "abb", "z", "a"]), (2, None), (3, [])], "doc_id long, tokens array<string>")
    out = sub.encode_subwords(df, vocab, "doc_id", "tokens")
    assert {r["doc_id"]: r["input_ids"][1:-1] for r in out.collect()} == {1: [12, 12, 11, sub.fv.UNK_ID, 10], 2: [], 3: []}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_are_one_text_by_place(spark):
    from provenance_spark.operators import subword as sub
    vocab = spark.createDataFrame([("a", False, 10), ("b", False, 11), ("b", True, 12)], "piece string, continues boolean, id int")
    df = spark.createDataFrame([(1, ["a", "ab"]), (1, ["b"]), (None, ["b"]), (None, None), (5, ["ab"])], "doc_id long, tokens array<string>")
    out = sub.encode_subwords(df, vocab, "doc_id", "tokens")
    assert {r["doc_id"]: r["input_ids"][1:-1] for r in out.collect()} == {1: [10, 11, 10, 12], None: [11], 5: [10, 12]}
