"""DuckDB SQL for the queries that SQL can express. Parameters of the mixture are stated here once for both."""

from __future__ import annotations

from provenance_spark.llm import line_site
from provenance_spark.llm.license_index import ANCHORS, PHRASES, SLACK, TEMPLATES, VOTES

DOMAIN_WEIGHTS = {"d0": 3, "d1": 2, "d2": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2}
BUDGET_SHARE = 0.6
MAX_EPOCHS = 3
SEED = 5

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT page_id, octet_length(encode(h)) AS n, x, list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(1 + 5 * i AS INT), 5) AS BIGINT)) AS g FROM p),
f AS (SELECT x, min(page_id) AS m FROM p GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(g, lambda q: array_to_string(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((q >> s) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != m THEN m END AS refers_to
FROM v JOIN f USING (x)"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""


def _weights(level: str, named: dict[str, int]) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in sorted(named.items())) + " ELSE 1 END AS DOUBLE)"


def _share(name: str, parent: str | None, path: str, level: str, weight: str) -> str:
    """One level of the tree: the children's shares of their parents' budgets."""
    by = f"PARTITION BY {parent}" if parent else ""
    source = f"JOIN (SELECT {parent}, share AS budget FROM above_{name}) USING ({parent})" if parent else "CROSS JOIN whole"
    return f"""
n_{name} AS (SELECT {path}, sum(cap) AS cap, sum(total) AS total, {weight} AS weight FROM leaves GROUP BY {path}),
l_{name} AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 'inf'::DOUBLE END AS level FROM n_{name} {source}),
t_{name} AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY level, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
       sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} ORDER BY level, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
       FROM l_{name}),
f_{name} AS (SELECT *, weight > 0 AND cap <= weight * (budget - taken) / rest AS full_ FROM t_{name}),
s_{name} AS (SELECT {path}, total, CASE WHEN full_ THEN cap ELSE least(cap, CAST(floor(weight * (budget
       - coalesce(sum(cap) FILTER (full_) OVER ({by}), 0)) / sum(weight) FILTER (NOT full_) OVER ({by})) AS HUGEINT)) END AS share FROM f_{name}),"""


OP8 = rf"""
WITH r AS (SELECT doc_id, coalesce(lang, 'none') AS language, coalesce(source, 'none') AS site,
       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, regexp_extract(coalesce(source, ''), '(\d+)$', 1) AS num FROM documents),
rows_ AS (SELECT *, CASE WHEN num = '' THEN 'none' ELSE 'd' || (CAST(right(num, 9) AS BIGINT) % 3) END AS domain FROM r),
leaves AS (SELECT domain, language, site, sum(n_tokens) AS total, sum(n_tokens) * {MAX_EPOCHS} AS cap FROM rows_ GROUP BY ALL),
whole AS (SELECT least(sum(cap), CAST(floor(CAST(sum(total) AS DOUBLE) * {BUDGET_SHARE}) AS HUGEINT)) AS budget FROM leaves),
{_share("domain", None, "domain", "domain", _weights("domain", DOMAIN_WEIGHTS))}
above_language AS (SELECT * FROM s_domain),
{_share("language", "domain", "domain, language", "language", _weights("language", LANGUAGE_WEIGHTS))}
above_site AS (SELECT * FROM s_language),
{_share("site", "domain, language", "domain, language, site", "site", "CAST(1 AS DOUBLE)")}
plan AS (SELECT domain, language, site, total, CASE WHEN total > 0 THEN share // total ELSE 0 END AS epochs,
         CASE WHEN total > 0 THEN share % total ELSE 0 END AS left_ FROM s_site),
o AS (SELECT *, md5('{SEED}|' || epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM rows_ JOIN plan USING (domain, language, site)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, site ORDER BY h) AS upto FROM o)
SELECT doc_id, domain, language, site, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(epochs + CASE WHEN left_ > 0 AND upto <= left_ THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT k, host, coalesce(text, '') AS page, u.i, ls[u.i] AS line, trim(ls[u.i], ' ' || chr(9) || chr(13)) AS bare
      FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
t AS (SELECT host, count(DISTINCT coalesce(text, '')) AS pages FROM d GROUP BY 1),
b AS (SELECT host, bare, 1 AS bad FROM (SELECT host, bare, count(DISTINCT page) AS n FROM l WHERE bare != '' GROUP BY 1, 2) JOIN t USING (host)
      WHERE n >= {line_site.FEWEST} AND n >= least({line_site.MIN_PAGES}, pages) AND n > pages * CAST({line_site.RATIO} AS DOUBLE)),
m AS (SELECT k, count(*) FILTER (bare != '') AS n_lines, count(bad) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bad IS NULL), '') AS text FROM l LEFT JOIN b USING (host, bare) GROUP BY 1)
SELECT doc_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, m.text FROM d LEFT JOIN m USING (k)"""

_TEMPLATES = ", ".join(f"({t}, '{label}', '{text}', [{', '.join(repr(p) for p in phrases)}])" for t, (label, text, phrases) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
t(t, label, body, phrases) AS (VALUES {_TEMPLATES}),
post AS (SELECT t, label, w[i] AS word, i - 1 AS place, len(w) AS size FROM (SELECT t, label, string_split(body, ' ') AS w, unnest(range(1, len(string_split(body, ' ')) + 1)) AS i FROM t)),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM d) GROUP BY 1),
ranked AS (SELECT post.*, coalesce(df, 0) AS df, dense_rank() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS rank FROM post LEFT JOIN df USING (word)),
anchor AS (SELECT *, max(rank) OVER (PARTITION BY t) AS n_anchors FROM ranked WHERE rank <= {ANCHORS}),
own AS (SELECT k, word FROM (SELECT k, unnest(list_distinct(w)) AS word FROM d) SEMI JOIN anchor USING (word)),
near AS (SELECT DISTINCT k FROM (SELECT k, t, n_anchors, count(*) AS c FROM own JOIN (SELECT DISTINCT word, t, n_anchors FROM anchor) USING (word)
         GROUP BY 1, 2, 3) WHERE c >= least(n_anchors, {VOTES})),
place_ AS (SELECT k, w[i] AS word, i - 1 AS here FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d SEMI JOIN near USING (k))),
vote AS (SELECT k, t, start FROM (SELECT k, t, here - place AS start, n_anchors, count(DISTINCT word) AS c FROM place_ JOIN anchor USING (word) GROUP BY 1, 2, 3, 4)
         WHERE c >= least(n_anchors, {VOTES})),
reg AS (SELECT k, vote.t, label, start, w, string_split(body, ' ') AS b, phrases,
        ' ' || array_to_string(w[greatest(start - {SLACK}, 0) + 1:start + len(string_split(body, ' ')) + {SLACK}], ' ') || ' ' AS region
        FROM vote JOIN d USING (k) JOIN t ON t.t = vote.t),
ok AS (SELECT k, label, len(list_filter(range(1, len(b) + 1), lambda i: start + i > 0 AND w[CAST(start + i AS INT)] = b[CAST(i AS INT)])) / len(b) AS score
       FROM reg WHERE len(list_filter(phrases, lambda p: NOT contains(region, ' ' || p || ' '))) = 0),
best AS (SELECT k, list(DISTINCT label) AS found, max(score) AS best FROM ok GROUP BY 1),
p(phrase, label) AS (VALUES {_PHRASES}),
base AS (SELECT k, label, i - 1 AS start FROM (SELECT k, label, string_split(phrase, ' ') AS ph, w, unnest(range(1, len(w) + 1)) AS i FROM d, p)
         WHERE w[i:i + len(ph) - 1] = ph),
b2 AS (SELECT k, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b2.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b2.labels, []), coalesce(found, [])))), ','), '') AS labels,
       greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN best USING (k) LEFT JOIN b2 USING (k)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
whole AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
p AS (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT k, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, whole),
s AS (SELECT item_id, k, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN wt USING (term) JOIN tf USING (term), whole GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, k) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""

ORACLE: dict[str, str] = {"op3_decontaminate_ac": OP3, "op4_warc_zdict": OP4, "op5_topk_nra": OP5, "op8_mix_budget": OP8, "op9_line_site": OP9,
                          "op10_license_index": OP10, "op12_search_taat": OP12}
