"""Encoding text for a frozen encoder.

* :func:`encode` - greedy longest-match word pieces against a small user-supplied vocabulary where the tokens are, in Arrow batches; adds
  start/end ids. Whole texts, unless a plugged-in encoder sets a maximum. Row-local: no shuffle.
* :func:`encode_words` - the same for a whole-word vocabulary table of any size, as a join. Word pieces over distinct
  words are in :mod:`provenance_spark.operators.subword`, vectors of texts (F8) in :mod:`provenance_spark.operators.word_vectors`.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.functions import fixed_values as fv
from provenance_spark.operators.subword import CACHED_WORDS, Segmenter
from provenance_spark.session import cut_lineage


def make_encoder_udf(vocab: Mapping[str, int], max_len: int | None):
    """Pandas UDF: array<string> pre-tokens -> array<int> ids, of fixed length ``max_len`` if it is given."""
    n = len(fv.CONTINUATION_PREFIX)
    pieces = [(p[n:], True, i) if p.startswith(fv.CONTINUATION_PREFIX) else (p, False, i) for p, i in vocab.items()]
    cache: dict[str, list[int]] = {}  # a copy in each worker
    made: list[Segmenter] = []

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode_batch(tokens: pd.Series) -> pd.Series:
        rows = []
        for toks in tokens:
            ids = [fv.CLS_ID]
            for t in toks if toks is not None else ():
                found = cache.get(t)
                if found is None:
                    if not made:
                        made.append(Segmenter(pieces))
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    found = cache[t] = made[0](t)
                ids.extend(found)
                if max_len and len(ids) >= max_len - 1:
                    break
            ids = ids[: max_len - 1 if max_len else None] + [fv.SEP_ID]
            rows.append(ids + [fv.PAD_ID] * ((max_len or 0) - len(ids)))
        return pd.Series(rows)

    return encode_batch


def encode(df: DataFrame, tokens_col: str, vocab: Mapping[str, int], max_len: int | None = None) -> DataFrame:
    """``input_ids`` and ``attention_mask`` against a supplied word-piece vocabulary.

    Whole texts by default; ``max_len`` cuts and pads to the maximum of a plugged-in encoder.
    """
    ids = make_encoder_udf(vocab, max_len)(F.col(tokens_col))
    return (df.withColumn("input_ids", ids)
              .withColumn("attention_mask", F.transform("input_ids", lambda x: (x != fv.PAD_ID).cast("int"))))


def word_vocabulary(tokens: DataFrame, tokens_col: str, min_count: int = 1) -> DataFrame:
    """A whole-word vocabulary from data: (word, id) by falling count, ties by word."""
    from provenance_spark.operators.positions import with_positions
    counts = tokens.select(F.explode(tokens_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(counts.where(F.col("n") >= min_count))  # positioning samples its ranges: count once
    ranked = with_positions(kept, ["n", "word"], descending=["n"])
    return ranked.select("word", (F.col("pos") + fv.FIRST_WORD_ID).cast("int").alias("id"))


def encode_words(df: DataFrame, vocab: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """F7 with a whole-word vocabulary table of any size: (id, input_ids) of whole texts, unknown words UNK."""
    from provenance_spark.operators.features import text_to_sequence
    seq = text_to_sequence(df, vocab, id_col, tokens_col, oov_id=fv.UNK_ID)
    return seq.select(id_col, F.concat(F.array(F.lit(fv.CLS_ID)), "seq", F.array(F.lit(fv.SEP_ID))).alias("input_ids"))
