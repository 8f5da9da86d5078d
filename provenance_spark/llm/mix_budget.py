"""Mixing sources to target weights: hierarchical budgeting over a domain, language and source tree.

The root's token budget is divided among domains, a domain's among its languages and a language's among its
sources, in proportion to weights. A leaf can supply its tokens at most ``max_epochs`` times, an inner node what its
leaves can. Where a child can't take its share, the shortage goes to its siblings by weight as far as they can
supply it, and only what the whole family can't is left to the family's own siblings: each node's share is
capped by what its subtree can supply before it is divided.

A leaf's share becomes whole epochs of all its rows, and of one more epoch the longest prefix, in that epoch's seeded
order, whose tokens fit. Rows are ordered by an MD5 of seed, epoch and id. The prefix's last row is found without
sorting a leaf: tokens are summed in 256 ranges of the hash, then in 256 ranges of the one where the budget ends, and
only the last of these is looked at row by row. A leaf's decision is then one row: epochs and the last hash taken. All of it is DataFrame
operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenance_spark.llm.common import fits, fresh
from provenance_spark.session import cut_lineage

LEVELS = ("domain", "language", "site")
#: Leaves whose plan may be broadcast; beyond, the plan is joined by shuffling.
LEAVES = 100_000
#: Hash digits of the last range: two at each step.
DIGITS = 4
NONE = "none"


@dataclass(frozen=True)
class Targets:
    """Integer weights by node name, for each level; a node that isn't named weighs ``other``."""

    domain: dict[str, int] = field(default_factory=dict)
    language: dict[str, int] = field(default_factory=dict)
    site: dict[str, int] = field(default_factory=dict)
    other: int = 1


def tokens(text: Column) -> Column:
    """Tokens of a text: its runs of characters that aren't white space. A null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def site_domain(source: Column) -> Column:
    """A source's domain: its number modulo 3 (``d0`` to ``d2``), or ``none`` where it has no number."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.substring(number, -9, 9).cast("long") % 3).cast("string"))).otherwise(NONE)


def _leaf(docs: DataFrame, source_col: str, lang_col: str) -> list[Column]:
    site, lang = F.coalesce(F.col(source_col), F.lit(NONE)), F.coalesce(F.col(lang_col), F.lit(NONE))
    return [site_domain(site).alias("domain"), lang.alias("language"), site.alias("site")]


def _weight(targets: Targets, level: str) -> Column:
    named = getattr(targets, level)
    out = F.lit(targets.other)
    for name, weight in sorted(named.items()):
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("double")


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, none above its ``cap``: weighted water-filling.

    Children in order of cap per weight take their caps as long as these are below their shares of what the ones before
    have left; the others divide the rest. Whole tokens, rounded down. A child without weight gets nothing.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = by.orderBy("level", "name").rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    c = (children.withColumn("level", level)
         .withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("rest", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fair = F.when(F.col("rest") > 0, F.col("weight") * (F.col("budget") - F.col("taken")) / F.col("rest")).otherwise(F.lit(0.0))
    c = c.withColumn("full", (F.col("weight") > 0) & (F.col("cap") <= fair))
    caps = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    left = F.when(weights > 0, F.col("weight") * (F.col("budget") - caps) / weights).otherwise(F.lit(0.0))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(left)))
    return c.withColumn("share", share.cast("long")).drop("level", "taken", "rest", "full")


def budgets(leaves: DataFrame, targets: Targets, budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, language, site, total) with each leaf's ``share`` of the budget in tokens."""
    leaves = leaves.withColumn("cap", F.col("total") * max_epochs)
    above: DataFrame | None = None
    for n, level in enumerate(LEVELS):
        path, parent = list(LEVELS[:n + 1]), list(LEVELS[:n])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("total").alias("total"))
        nodes = nodes.withColumn("weight", _weight(targets, level)).withColumn("name", F.col(level))
        if above is None:
            whole = leaves.agg(F.sum("cap").alias("all")).select(F.least(F.coalesce("all", F.lit(0)), F.lit(budget)).alias("b")).first()["b"]
            nodes = nodes.withColumn("budget", F.lit(int(whole)).cast("long"))
        else:
            nodes = nodes.join(above, parent)
        shared = _share(nodes, parent)
        above = shared.select(*path, F.col("share").alias("budget"))
    return shared.select(*LEVELS, "total", "share")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def plan(rows: DataFrame, targets: Targets, budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """A row for each leaf: its share, whole ``epochs`` and the ``last`` hash taken of the next epoch.

    ``rows`` holds domain, language, site, id and n_tokens.
    """
    leaves = cut_lineage(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("total")))
    total = leaves.agg(F.sum("total")).first()[0] or 0
    shares = budgets(leaves, targets, int(total * budget_share), max_epochs)
    split = F.col("total") > 0
    leaf = cut_lineage(shares.select(
        *LEVELS, "total", "share", F.when(split, F.floor(F.col("share") / F.col("total"))).otherwise(0).cast("long").alias("epochs"),
        F.when(split, F.col("share") % F.col("total")).otherwise(0).alias("left"), F.lit("").alias("prefix")))
    small = fits(leaf, LEAVES)
    narrow = lambda d: F.broadcast(d) if small else d
    at = leaf.where(F.col("left") > 0)
    for _ in range(DIGITS // 2):  # sums of 256 ranges of the range found before; the first whose sum goes beyond is next
        near = rows.join(narrow(at.select(*LEVELS, "epochs", "left", "prefix")), list(LEVELS))
        near = near.withColumn("hash", order_hash(seed, F.col("epochs"), F.col("id"))).where(F.col("hash").startswith(F.col("prefix")))
        ranges = (near.withColumn("range", F.substring("hash", F.length("prefix") + 1, F.lit(2)))
                  .groupBy(*LEVELS, "epochs", "left", "prefix", "range").agg(F.sum("n_tokens").alias("n")))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
        beyond = ranges.withColumn("upto", upto).where("upto > left")
        at = cut_lineage(beyond.groupBy(*LEVELS, "epochs").agg(
            F.min_by(F.struct(F.concat("prefix", "range").alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")), "range").alias("next"))
            .select(*LEVELS, "epochs", "next.prefix", "next.left"))
    near = rows.join(narrow(at), list(LEVELS))
    near = near.withColumn("hash", order_hash(seed, F.col("epochs"), F.col("id"))).where(F.col("hash").startswith(F.col("prefix")))
    upto = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("hash"))  # rows with equal hashes stand or fall together
    last = near.withColumn("upto", upto).where("upto <= left").groupBy(*LEVELS).agg(F.max("hash").alias("hash"))
    ends = at.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("hash", "prefix").alias("last"))
    return cut_lineage(leaf.join(ends, list(LEVELS), "left").select(*LEVELS, "total", "share", "epochs", F.coalesce("last", F.lit("")).alias("last")))


def copies(rows: DataFrame, leaves: DataFrame, key: Column, seed: int, to: str) -> DataFrame:
    """``rows`` (with the leaf's columns) and how often each is taken."""
    leaves = leaves.select(*LEVELS, "epochs", "last")
    joined = rows.join(F.broadcast(leaves) if fits(leaves, LEAVES) else leaves, list(LEVELS))
    more = order_hash(seed, F.col("epochs"), key) <= F.col("last")
    return joined.withColumn(to, F.col("epochs") + more.cast("long"))


def counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One narrow row for each row of ``docs``, kept so that texts are counted once."""
    return cut_lineage(docs.select(F.col(id_col).alias("id"), *_leaf(docs, source_col, lang_col), tokens(F.col(text_col)).alias("n_tokens")))


def mixture(docs: DataFrame, targets: Targets, budget_share: float, max_epochs: int, seed: int, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(id, domain, language, site, n_tokens, copies)`` of every row of ``docs``.

    A null source or language is the node ``none``; null and empty texts have no tokens; a leaf without tokens supplies
    nothing; a leaf whose share ends with an epoch takes no row, however short, of the next; rows that repeat an id within a leaf are taken together; an empty table gives an empty result.
    """
    rows = counted(docs, id_col, text_col, lang_col, source_col)
    leaves = plan(rows, targets, budget_share, max_epochs, seed)
    return copies(rows, leaves, F.col("id"), seed, "copies").select("id", *LEVELS, "n_tokens", "copies")


def mixed(docs: DataFrame, targets: Targets, budget_share: float, max_epochs: int, seed: int, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are taken, once for each epoch, with an ``epoch`` column from 1. Texts aren't shuffled."""
    leaves = plan(counted(docs, id_col, text_col, lang_col, source_col), targets, budget_share, max_epochs, seed)
    epoch = fresh(docs, "epoch")
    row = docs.select(F.struct(*docs.columns).alias("row"), *_leaf(docs, source_col, lang_col))
    taken = copies(row, leaves, F.col("row")[id_col], seed, "n").where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias(epoch)).select("row.*", epoch)
