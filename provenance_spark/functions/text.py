"""Column expressions for text normalisation, cleaning and tokenisation.

Everything here is a native Spark expression (regex, ``transform``/``filter`` higher-order
functions, map lookups), so it stays inside whole-stage code generation. Every regular expression
is written with explicit ``\\x{...}`` classes that mean the same in Java regex (Spark) and RE2
(the SQL oracle), which is why ``\\w``, ``\\s`` and ``\\d`` are never used.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenance_spark.functions import fixed_values as fv
from provenance_spark.functions.sample_lemmas import DEFAULT_LEMMAS


def _ranges(codepoints: Iterable[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in sorted(codepoints):
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def char_class_body(codepoints: Iterable[int]) -> str:
    """Body of a regex character class (without brackets) as ``\\x{..}`` escapes and ranges."""
    parts = []
    for lo, hi in _ranges(codepoints):
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


@lru_cache(maxsize=None)
def digit_class_body() -> str:
    """Every code point Python's ``str.isdigit`` accepts (decimal digits plus ``²``, ``①`` ...)."""
    return char_class_body(cp for cp in range(sys.maxunicode + 1)
                           if 0xD800 > cp or cp > 0xDFFF if chr(cp).isdigit())


@lru_cache(maxsize=None)
def space_class_body() -> str:
    """Every code point Python's ``str.isspace`` accepts (what ``str.split``/``strip`` use)."""
    return char_class_body(cp for cp in range(sys.maxunicode + 1)
                           if 0xD800 > cp or cp > 0xDFFF if chr(cp).isspace())


def punct_class_body() -> str:
    return char_class_body(ord(c) for c in fv.ASCII_PUNCTUATION)


@lru_cache(maxsize=None)
def digit_chars() -> str:
    """The same set as :func:`digit_class_body` as a plain string (for ``translate``)."""
    return "".join(chr(cp) for cp in range(sys.maxunicode + 1)
                   if (0xD800 > cp or cp > 0xDFFF) and chr(cp).isdigit())


@lru_cache(maxsize=None)
def space_chars() -> str:
    return "".join(chr(cp) for cp in range(sys.maxunicode + 1)
                   if (0xD800 > cp or cp > 0xDFFF) and chr(cp).isspace())


# ---------------------------------------------------------------- P4, P5


def normalize_newlines(text: Column) -> Column:
    """Every ``\\n`` becomes one space; runs are not collapsed."""
    return F.translate(text, "\n", " ")


def text_length(text: Column) -> Column:
    """P5: length in code points, like Python ``len``."""
    return F.length(text).cast("int")


# ---------------------------------------------------------------- T1-T3


def remove_punctuation(text: Column) -> Column:
    """Drop the 32 ASCII punctuation characters (``translate``: one hash lookup per character)."""
    return F.translate(text, fv.ASCII_PUNCTUATION, "")


def remove_digits(text: Column) -> Column:
    """Drop every character for which ``str.isdigit`` holds.

    ``translate`` with the full set is a hash lookup per character; a regex class of the same
    ~800 code points is checked range by range and was 11x slower at sf0.1.
    """
    return F.translate(text, digit_chars(), "")


def clean_basic(text: Column) -> Column:
    """T1 -> T2 -> T3 in the original order: punctuation, lower case, digits."""
    return remove_digits(F.lower(remove_punctuation(text)))


def strip_spaces(text: Column) -> Column:
    """Python ``str.strip()``: leading and trailing Unicode whitespace (``trim`` only removes spaces)."""
    ws = space_class_body()
    # most texts begin and end with neither: looking at the two ends is far cheaper than searching whole texts for the second
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(f"[{ws}]"), F.regexp_replace(F.regexp_replace(text, f"^[{ws}]+", ""), f"[{ws}]+$", "")).otherwise(text)


# ---------------------------------------------------------------- T4-T7


def contraction_pattern() -> str:
    """One regex for all Treebank splits: the left part of a whole-token contraction word.

    A token is a maximal run of non-space characters, so "whole token" means: preceded by a space
    or the start, followed by the right part and then a space or the end.
    """
    ws = space_class_body()
    alts = "|".join(f"{left}(?={right}(?![^{ws}]))" for _, left, right in fv.TREEBANK_SPLIT_WORDS)
    return f"(?i)(?<![^{ws}])({alts})"


def split_contractions(text: Column) -> Column:
    """Treebank contraction splits that survive punctuation removal (``cannot`` -> ``can not``).

    The regex only runs on rows containing one of the words (a plain substring test).
    """
    lowered = F.lower(text)
    hit = None
    for word, _, _ in fv.TREEBANK_SPLIT_WORDS:
        hit = lowered.contains(word) if hit is None else hit | lowered.contains(word)
    return F.when(hit, F.regexp_replace(text, contraction_pattern(), "$1 ")).otherwise(text)


def whitespace_split(text: Column) -> Column:
    """``str.split()``: runs of Unicode whitespace separate tokens; no empty tokens."""
    spaces = space_chars()
    return F.array_remove(F.split(F.translate(text, spaces, " " * len(spaces)), " "), "")  # no lambda, so it is code-generated


def separate_marks(text: Column) -> Column:
    """Non-ASCII quotation marks stand as tokens of their own (ASCII ones are gone after T1)."""
    marks = "".join(fv.QUOTE_MARKS)
    hit = None
    for mark in fv.QUOTE_MARKS:
        hit = text.contains(mark) if hit is None else hit | text.contains(mark)
    return F.when(hit, F.regexp_replace(text, f"([{marks}])", " $1 ")).otherwise(text)


def word_tokens(text: Column) -> Column:
    """T4: word tokens of already cleaned text: marks apart, contraction splits, then whitespace runs."""
    return whitespace_split(split_contractions(separate_marks(text)))


def remove_stopwords(tokens: Column, stopwords: Sequence[str] = fv.NLTK_ENGLISH_STOPWORDS) -> Column:
    """T5: drop stop words, keeping duplicates and order (``array_except`` would dedupe)."""
    stops = sorted(set(stopwords))
    return F.filter(tokens, lambda t: ~t.isin(stops))  # becomes a hash-set lookup (InSet)


def compose_lemma_map(lemmas: Iterable[tuple[str, str, str]],
                      pos_order: Sequence[str] = fv.LEMMA_POS_ORDER) -> dict[str, str]:
    """Compose the per-part-of-speech passes once per form: word -> lemma after all passes.

    Only words that change are kept; any other word maps to itself.
    """
    by_pos: dict[str, dict[str, str]] = {p: {} for p in pos_order}
    for form, pos, lemma in lemmas:
        by_pos.setdefault(pos, {}).setdefault(form, lemma)
    forms = {f for table in by_pos.values() for f in table}
    out = {}
    for form in forms:
        word = form
        for pos in pos_order:
            word = by_pos[pos].get(word, word)
        if word != form:
            out[form] = word
    return out


MAX_LITERAL_LEMMAS = 50_000


def lemmatize_tokens(tokens: Column, lemma_map: Mapping[str, str]) -> Column:
    """Map every token through the composed lemma table; unknown tokens stay as they are."""
    if not lemma_map:
        return tokens
    if len(lemma_map) > MAX_LITERAL_LEMMAS:
        raise ValueError("lemma table too large for an inline map; use operators.features.lemmatize_join")
    keys = sorted(lemma_map)
    m = F.map_from_arrays(F.lit(keys), F.lit([lemma_map[k] for k in keys]))
    # hash-set test first; only known forms pay for the (linear) map lookup
    return F.transform(tokens, lambda t: F.when(t.isin(keys), F.try_element_at(m, t)).otherwise(t))


def clean_text(text: Column, remove_stopword: bool = False, lemmatize: bool = False,
               lemma_map: Mapping[str, str] | None = None,
               stopwords: Sequence[str] = fv.NLTK_ENGLISH_STOPWORDS, already_basic: bool = False) -> Column:
    """T1-T3, then (when a flag is set) tokens, stop words, lemmas, joined by spaces; stripped.

    On whole tables prefer :func:`with_clean_text`, which stages T1-T3 as a column.
    """
    cleaned = text if already_basic else clean_basic(text)
    if not (remove_stopword or lemmatize):
        return strip_spaces(cleaned)
    tokens = word_tokens(cleaned)
    if remove_stopword:
        tokens = remove_stopwords(tokens, stopwords)
    if lemmatize:
        tokens = lemmatize_tokens(tokens, lemma_map if lemma_map is not None
                                  else compose_lemma_map(DEFAULT_LEMMAS))
    return strip_spaces(F.array_join(tokens, " "))


def with_clean_text(df: DataFrame, text_col: str = "text", out_col: str = "clean",
                    remove_stopword: bool = False, lemmatize: bool = False,
                    lemma_map: Mapping[str, str] | None = None,
                    stopwords: Sequence[str] = fv.NLTK_ENGLISH_STOPWORDS) -> DataFrame:
    """:func:`clean_text` as a DataFrame step, with T1-T3, the tokens and each pass over them in columns of their own.

    Higher-order functions (``filter``/``transform`` with a lambda) are not code-generated, so a
    chain nested under them runs interpreted, and each step once for every place that names it: T4 alone
    ran a dozen times per row. As columns of their own the steps are computed once, in whole-stage codegen.
    """
    if not (remove_stopword or lemmatize):
        tmp = f"_{out_col}_basic"
        staged = df.withColumn(tmp, clean_basic(F.col(text_col)))
        return staged.withColumn(out_col, strip_spaces(F.col(tmp))).drop(tmp)
    tmp = f"_{out_col}_tokens"
    staged = with_word_tokens(df, text_col, tmp)
    if remove_stopword:
        staged = staged.withColumn(tmp, staged_pass(F.col(tmp), lambda t: remove_stopwords(t, stopwords)))
    if lemmatize:
        lemmas = lemma_map if lemma_map is not None else compose_lemma_map(DEFAULT_LEMMAS)
        staged = staged.withColumn(tmp, staged_pass(F.col(tmp), lambda t: lemmatize_tokens(t, lemmas)))
    joined = f"_{out_col}_joined"
    return staged.withColumn(joined, F.array_join(tmp, " ")).withColumn(out_col, strip_spaces(F.col(joined))).drop(tmp, joined)


def staged_pass(tokens: Column, each: Callable[[Column], Column]) -> Column:
    """``each`` over a token column that stays a column of its own.

    Spark merges projections where a column is named once, and would put the tokens' whole chain under the lambda of ``each``;
    named twice, the column stays.
    """
    return F.when(F.size(tokens) > 0, each(tokens)).otherwise(tokens)


def with_word_tokens(df: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """T4 over raw text as a DataFrame step: T1-T3, the marks and the contractions are columns of their own (:func:`with_clean_text`)."""
    basic, marked = f"_{out_col}_basic", f"_{out_col}_marked"
    staged = df.withColumn(basic, clean_basic(F.col(text_col)))
    staged = staged.withColumn(marked, separate_marks(F.col(basic)))
    return staged.withColumn(out_col, whitespace_split(split_contractions(F.col(marked)))).drop(basic, marked)


# ---------------------------------------------------------------- F2, F4

NGRAM_TOKEN = r"([\p{L}\p{N}_]{2,})"


def ngram_unigrams(text: Column) -> Column:
    """F2 tokens: lower case, runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(NGRAM_TOKEN), 1)


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent pairs joined by one space (1-2-grams)."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))),
                       F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)


def with_ngram_terms(df: DataFrame, text_col: str = "text", out_col: str = "terms", max_n: int = 2) -> DataFrame:
    """F2 as an array column, with the unigram regex in a column of its own first.

    :func:`with_bigrams` references the unigram list three times inside ``zip_with``; lambdas are
    not code-generated, so a nested regex would run three times per row.
    """
    tmp = f"_{out_col}_uni"
    staged = df.withColumn(tmp, ngram_unigrams(F.col(text_col)))
    terms = with_bigrams(F.col(tmp)) if max_n >= 2 else F.col(tmp)
    return staged.withColumn(out_col, terms).drop(tmp)


def ngram_terms(text: Column, max_n: int = 2) -> Column:
    unigrams = ngram_unigrams(text)
    return with_bigrams(unigrams) if max_n >= 2 else unigrams


def keras_words(text: Column, filters: str = fv.KERAS_FILTERS) -> Column:
    """F4 word split: lower case, filter characters become spaces, split on single spaces, drop empties."""
    spaced = F.translate(F.lower(text), filters, " " * len(filters))
    return F.array_remove(F.split(spaced, " "), "")  # no lambda, so it stays in codegen; all-space text has no words


def encoder_pre_tokens(text: Column) -> Column:
    """F7 pre-tokenisation (uncased): runs of letters/digits, and every other non-space character alone."""
    ws = space_class_body()
    return F.regexp_extract_all(F.lower(text), F.lit(f"([\\p{{L}}\\p{{N}}]+|[^{ws}\\p{{L}}\\p{{N}}])"), 1)
