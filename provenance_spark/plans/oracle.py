"""SQL building blocks for the independent DuckDB oracle (same rules as the Spark operators).

The oracle only sees the raw fixture tables, so the derived corpus and the cleaning classes are
spelled out here as SQL; the character classes come from the same rule-built strings the Spark
expressions use.
"""

from __future__ import annotations

from provenance_spark.functions import fixed_values as fv
from provenance_spark.functions.text import digit_class_body, punct_class_body, space_class_body


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


CORPUS_CTE = """corpus AS (
  SELECT conv_id * 1000 + turn AS id,
         CASE WHEN conv_id % 10 < 6 THEN 'train' WHEN conv_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
         CASE WHEN role = 'user' THEN 0 ELSE 1 END AS AI,
         CASE WHEN role = 'user' THEN 'human'
              WHEN substr(md5(CAST(conv_id * 1000 + turn AS VARCHAR)), 1, 1) IN ('0','1','2','3') THEN 'gpt2'
              WHEN substr(md5(CAST(conv_id * 1000 + turn AS VARCHAR)), 1, 1) IN ('4','5','6','7') THEN 'gpt3'
              ELSE 'gpt3.5' END AS version,
         replace(text, chr(10), ' ') AS text,
         CAST(length(replace(text, chr(10), ' ')) AS INTEGER) AS text_length
  FROM conversations WHERE role <> 'system')"""


def quotas_cte(name: str = "quotas", total: dict[str, int] | None = None) -> str:
    """Per (split, version) quota: 4:1:1:2 parts; auto size = 8 x min(count // part) per split, 8 at least."""
    parts = " ".join(f"WHEN {sql_str(v)} THEN {p}" for v, p in fv.VERSION_PARTS)
    versions = ", ".join(sql_str(v) for v, _ in fv.VERSION_PARTS)
    fixed = ""
    if total:
        fixed = "CASE " + " ".join(f"WHEN c.split = {sql_str(s)} THEN {t // fv.PARTS_TOTAL}"
                                   for s, t in total.items()) + " ELSE NULL END"
    unit = f"coalesce({fixed}, u.unit_auto)" if fixed else "u.unit_auto"
    return f"""counts AS (
  SELECT g.split, g.version, coalesce(c.n, 0) AS n, CASE g.version {parts} END AS part
  FROM (SELECT split, unnest([{versions}]) AS version FROM (SELECT DISTINCT split FROM corpus)) g
  LEFT JOIN (SELECT split, version, count(*) AS n FROM corpus GROUP BY split, version) c USING (split, version)),
units AS (SELECT split, greatest(min(CAST(floor(n / part) AS BIGINT)), 1) AS unit_auto FROM counts GROUP BY split),
{name} AS (
  SELECT c.split, c.version, c.n, CAST({unit} * c.part AS BIGINT) AS quota
  FROM counts c JOIN units u ON c.split = u.split)"""


def sample_cte(name: str = "sample", seed: int = 1, source: str = "corpus", quotas: str = "quotas") -> str:
    return f"""{name} AS (
  SELECT r.* EXCLUDE (rn) FROM (
    SELECT s.*, row_number() OVER (PARTITION BY split, version
                                   ORDER BY md5({sql_str(str(seed) + ':')} || CAST(id AS VARCHAR)), id) AS rn
    FROM {source} s) r
  JOIN (SELECT * FROM {quotas}
        WHERE CASE WHEN n < quota THEN error('stratum too small for its quota') ELSE true END) q
    ON r.split = q.split AND r.version = q.version
  WHERE r.rn <= q.quota)"""


def punct_re() -> str:
    return f"[{punct_class_body()}]"


def digit_re() -> str:
    return f"[{digit_class_body()}]"


def clean_basic_sql(text: str) -> str:
    return (f"regexp_replace(lower(regexp_replace({text}, {sql_str(punct_re())}, '', 'g')), "
            f"{sql_str(digit_re())}, '', 'g')")


def strip_sql(text: str) -> str:
    ws = space_class_body()
    return (f"regexp_replace(regexp_replace({text}, {sql_str('^[' + ws + ']+')}, ''), "
            f"{sql_str('[' + ws + ']+$')}, '')")


def word_tokens_sql(text: str) -> str:
    ws = space_class_body()
    apart = f"regexp_replace({text}, '([«“‘„»”’])', ' \\1 ', 'g')"
    raw = f"regexp_extract_all({apart}, {sql_str('([^' + ws + ']+)')}, 1)"
    cases = " ".join(f"WHEN lower(t) = {sql_str(w)} THEN [substr(t, 1, {len(left)}), substr(t, {len(left) + 1})]"
                     for w, left, _ in fv.TREEBANK_SPLIT_WORDS)
    return f"flatten(list_transform({raw}, lambda t: CASE {cases} ELSE [t] END))"


def remove_stopwords_sql(tokens: str, stopwords=fv.NLTK_ENGLISH_STOPWORDS) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({sql_list(sorted(set(stopwords)))}, t))"


def lemmatize_sql(tokens: str, lemma_map: dict[str, str]) -> str:
    if not lemma_map:
        return tokens
    cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(lemma_map[k])}" for k in sorted(lemma_map))
    return f"list_transform({tokens}, lambda t: CASE t {cases} ELSE t END)"


NGRAM_RE = r"([\p{L}\p{N}_]{2,})"


def ngram_terms_sql(tokens_col: str) -> str:
    """1-2-grams from a column of unigram lists (a column, so the lambda does not re-run the regex)."""
    return (f"list_concat({tokens_col}, list_transform(range(1, len({tokens_col})), "
            f"lambda i: {tokens_col}[i] || ' ' || {tokens_col}[i + 1]))")


def unigrams_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {sql_str(NGRAM_RE)}, 1)"


def keras_words_sql(text: str) -> str:
    f = fv.KERAS_FILTERS
    return (f"list_filter(string_split(translate(lower({text}), {sql_str(f)}, {sql_str(' ' * len(f))}), ' '), "
            f"lambda w: w <> '')")


def encoder_tokens_sql(text: str) -> str:
    ws = space_class_body()
    pat = f"([\\p{{L}}\\p{{N}}]+|[^{ws}\\p{{L}}\\p{{N}}])"
    return f"regexp_extract_all(lower({text}), {sql_str(pat)}, 1)"
