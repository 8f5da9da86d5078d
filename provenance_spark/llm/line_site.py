"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; lines above a ratio are boilerplate and
are dropped from all the host's pages. Pages of a host with the same text are one page, in count and total: copies of a page
don't make its lines boilerplate. Lines are compared without outer spaces, tabs and carriage returns, by two 64-bit
hashes; blank lines are never counted or dropped.

A host has fewer boilerplate lines than its mean lines a page divided by the ratio, so its set of them is one bounded
row, however many pages it has. Counting is by grouped sums that combine before they shuffle. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenance_spark.llm.common import fits, fresh
from provenance_spark.session import cut_lineage

RATIO = 0.05
#: Pages that must hold a boilerplate line: this many, or all pages of a smaller host. On fewer than FEWEST pages a line that
#: all share is no evidence: they may be near copies of one page.
MIN_PAGES = 5
FEWEST = 3
#: Boilerplate lines of all hosts that may be broadcast; beyond, pages are joined by shuffling.
BROADCAST_LINES = 200_000


def _hash(x: Column) -> list[Column]:
    return [F.xxhash64(x), F.xxhash64(F.lit(7), x)]


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, a, b)``: hashes of each host's boilerplate lines, above the ratio and on ``min_pages`` pages, or all of a smaller host's."""
    host, text = F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    p, q = _hash(text)
    lines = docs.select(host.alias("host"), p.alias("p"), q.alias("q"), F.explode(F.split(text, "\n")).alias("line"))
    a, b = _hash(_bare(F.col("line")))
    on = lines.where(_bare(F.col("line")) != "").select("host", "p", "q", a.alias("a"), b.alias("b")).distinct()
    counts = on.groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min(FEWEST, min_pages))
    totals = docs.select(host.alias("host"), p.alias("p"), q.alias("q")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    many = F.col("n") >= F.least(F.lit(min_pages), F.col("pages"))
    return counts.join(totals, "host").where(many & (F.col("n") > F.col("pages") * ratio)).select("host", "a", "b")


def annotate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, to: str = "kept") -> DataFrame:
    """``docs`` with a struct column: host, n_lines (not blank), n_dropped, and text without the host's boilerplate lines.

    A null host is the host named by the empty text; a null text has no lines and stays null; a text whose lines all go is
    empty. Repeated rows are one page when counting and are all cleaned. Other columns pass through.
    """
    found = cut_lineage(boilerplate(docs, host_col, text_col, ratio, min_pages))
    key, bad = fresh(docs, "host_key"), fresh(docs, "bad_lines")
    sets = found.groupBy(F.col("host").alias(key)).agg(F.collect_list(F.struct("a", "b")).alias(bad))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    if fits(found, BROADCAST_LINES):
        sets = F.broadcast(sets)
    lines = F.split(F.col(text_col), "\n")
    # Hashes that the page shares with its host's set first: a hashed look-up, so that only lines among them are compared with the set.
    own = fresh(docs, "own_lines")
    shared = F.array_intersect(F.transform(lines, lambda x: _hash(_bare(x))[0]), F.col(bad)["a"])
    joined = docs.join(sets, host == F.col(key), "left").withColumn(own, shared)

    def stays(line: Column) -> Column:
        a, b = _hash(_bare(line))
        return ~(F.array_contains(F.col(own), a) & F.array_contains(F.col(bad), F.struct(a.alias("a"), b.alias("b"))))

    none = F.coalesce(F.size(F.col(own)) == 0, F.lit(True))
    left = F.when(none, lines).otherwise(F.filter(lines, lambda x: (_bare(x) == "") | stays(x)))
    full = F.coalesce(F.size(F.filter(lines, lambda x: _bare(x) != "")), F.lit(0))
    dropped = F.coalesce(F.size(lines) - F.size(left), F.lit(0))
    n = F.when(F.col(text_col).isNull(), 0)
    return joined.withColumn(to, F.struct(host.alias("host"), n.otherwise(full).cast("long").alias("n_lines"),
                                          n.otherwise(dropped).cast("long").alias("n_dropped"),
                                          F.array_join(left, "\n").alias("text"))).drop(key, bad, own)


def cleaned(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with its columns as they were, and ``text_col`` without boilerplate lines."""
    to = fresh(docs, "kept")
    out = annotate(docs, host_col, text_col, ratio, min_pages, to)
    return out.select(*[F.col(to)["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns])
