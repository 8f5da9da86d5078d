"""SimHash near-duplicates linked by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Pairs within
``radius`` bits are found with the structured masks of covering LSH (Pagh 2016): bit i gets a non-zero
vector m(i) of radius + 1 bits, and table v keeps the bits whose m(i) is odd against v. The vectors of
``radius`` differing bits span at most ``radius`` dimensions, so some v is orthogonal to them all, and in
its table the pair collides. No pair is missed, whatever the data.

Inside a table's buckets no pairs are listed. At radius 2 two fingerprints are linked exactly when some
64-bit value, a hub, lies within one bit of both: every member of a crowded bucket emits itself and its
flips of bits outside the mask, and members that meet at a hub are linked to the hub's least member. All
members of a hub are within 2 bits of each other, so each such link is real, and a hub has at most 65
members however large the group of copies is. Larger radii use as many flips as half the radius asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenance_spark.llm.common import FOLD, bound_batches, fresh
from provenance_spark.llm.components import connected_components
from provenance_spark.session import cut_lineage

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer; 0 for a text without words."""
    words = (text or b"").translate(FOLD).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    size = min(shingle, len(words))
    ones, total = np.zeros(BITS, np.int64), len(words) - size + 1
    for start in range(0, total, CHUNK):
        part = words[start:min(start + CHUNK, total) + size - 1]
        values = np.array([digest(join(w), SEED) for w in zip(*(part[i:] for i in range(size)), strict=False)], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, one for each table, as unsigned 64-bit integers."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin((1 + i % vectors) & v).count("1") % 2)
            for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges ``(a, b)`` between distinct fingerprints ``fp``: their components are those of all pairs within ``radius``.

    Even radii only: half the radius away from both ends lies a hub.
    """
    if radius % 2 or radius < 2:
        raise ValueError("the hub step needs an even radius of 2 or more")
    flips = [[_signed(sum(1 << i for i in bits)) for n in range(radius // 2 + 1)
              for bits in combinations([i for i in range(BITS) if not m >> i & 1], n)] for m in masks(radius)]
    tables = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks(radius))])).alias("b")).select("fp", "b.t", "b.key")
    crowded = (tables.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
               .where("lo != hi").select("t", "key"))
    members = tables.join(crowded, ["t", "key"])
    flip = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in flips]), F.col("t") + 1)
    hubs = (members.select("fp", F.explode(flip).alias("flip"))
            .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
            .groupBy("hub").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")))
    return (hubs.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
            .where("a != b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` of every row; component_id is the least id reachable over links.

    Rows with equal fingerprints are linked, those without words too (fingerprint 0). A null text has no
    words. Rows with equal ids stay separate rows. A null id is nobody's least: a component of null ids
    alone has a null component_id. An empty table gives an empty result; other columns aren't read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(links(classes.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    parts = parts.join(classes, "fp")
    roots = parts.groupBy("component").agg(F.min("least").alias("root"))
    merged = parts.join(roots, "component").select("fp", "root")
    named = cut_lineage(classes.join(merged, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id")))
    return rows.join(named, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is their component's least: one of each group.

    Rows that repeat a kept id are reduced to one. Rows with a null id have nothing to be told apart by and stay.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    key, n = fresh(docs, "kept_id"), fresh(docs, "kept_n")
    kept = cut_lineage(found.where("id = component_id").groupBy(F.col("id").alias(key)).agg(F.count("*").alias(n)))
    out = docs.join(kept, F.col(id_col) == F.col(key), "inner")
    once = out.where(F.col(n) == 1).select(*docs.columns)
    if not kept.where(F.col(n) > 1).isEmpty():
        once = once.union(out.where(F.col(n) > 1).select(*docs.columns).dropDuplicates([id_col]))
    return once.union(docs.where(F.col(id_col).isNull()))
