"""Benchmark decontamination with an Aho-Corasick automaton over the benchmark's word windows.

Benchmark items are normalised to words; every window of ``width`` consecutive words (a shorter item is one
window) becomes a pattern, bounded by spaces. The automaton scans each normalised text once. Normalising
keeps byte offsets, so hits map back to spans of the original text.

The automaton is broadcast in blocks of at most ``block`` windows: a larger benchmark is scanned in several
passes with a checkpoint between, each adding what it finds, so a worker's memory stays bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenance_spark.llm.common import FOLD_WORDS, bound_batches, fresh
from provenance_spark.session import cut_lineage

WIDTH = 10
#: Windows in one automaton: about 60 characters each, so a few million nodes at most.
BLOCK = 30_000

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                   ("items", pa.list_(pa.string()))])


def windows(text: str | None, width: int = WIDTH) -> list[str]:
    """The patterns of an item: its windows of ``width`` words, or all its words if there are fewer."""
    words = (text or "").encode().translate(FOLD_WORDS).split()
    n = max(1, len(words) - width + 1) if words else 0
    return [(b" " + b" ".join(words[i:i + width]) + b" ").decode("latin-1") for i in range(n)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block: int) -> Iterator[dict[str, list[str]]]:
    """Pattern to item ids (as text), at most ``block`` patterns at a time; rows come one by one."""
    now: dict[str, list[str]] = {}
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for item, text in rows.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        for w in windows(text, width):
            now.setdefault(w, []).append(item)
            if len(now) >= block:
                yield now
                now = {}
    yield now


def automaton(patterns: dict[str, list[str]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for p, items in patterns.items():
        machine.add_word(p, (len(p), p.count(" ") - 1, items))
    machine.make_automaton()
    return machine


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive runs of word positions, those that overlap or touch joined."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(machine: ahocorasick.Automaton, raw: bytes | None) -> tuple[int, list, list, set]:
    """Number of words, runs of hit words, their spans in characters of the original text, items that occur."""
    folded = (raw or b"").translate(FOLD_WORDS)
    words = folded.split()
    if not words or not len(machine):
        return len(words), [], [], set()
    norm = b" " + b" ".join(words) + b" "
    hits = [(end - size + 1, n, items) for end, (size, n, items) in machine.iter(norm.decode("latin-1"))]
    if not hits:
        return len(words), [], [], set()
    before = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    first = np.searchsorted(before, [h[0] for h in hits])
    runs = merged({(int(f), int(f) + n - 1) for f, (_, n, _) in zip(first, hits, strict=True)})
    original = np.frombuffer(folded, np.uint8) != 32
    edges = np.diff(original.astype(np.int8), prepend=0, append=0)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    start, stop = chars[np.flatnonzero(edges == 1)], chars[np.flatnonzero(edges == -1)]
    return len(words), runs, [(int(start[a]), int(stop[b])) for a, b in runs], {x for h in hits for x in h[2]}


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text", width: int = WIDTH, block: int = BLOCK, to: str = "found") -> DataFrame:
    """``docs`` with a struct column: n_words, runs of hit words, spans of original characters, items.

    Rows aren't shuffled, and other columns pass through. Null and empty texts have no words; items with a
    null id or null text, or without words, have no windows; repeated items count once; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    raw = fresh(docs, "raw_text")
    out = docs
    for n, patterns in enumerate(blocks(benchmark, item_col, item_text, width, block)):
        shared = spark.sparkContext.broadcast(patterns)
        out = cut_lineage(out) if n else out  # a pass of its own: workers hold one automaton at a time
        schema = T.StructType([*docs.schema.fields, T.StructField(to, FOUND)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=n > 0) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for b in batches:
                kept = b.columns[:-2] if again else b.columns[:-1]
                was = b.columns[-2].to_pylist() if again else [None] * b.num_rows
                found = []
                for text, w in zip(b.columns[-1].to_pylist(), was, strict=True):
                    words, runs, spans, items = scan(machine, text)
                    if w:
                        runs = merged([*runs, *((r["first"], r["last"]) for r in w["runs"])])
                        items = items | set(w["items"])
                        spans = _joined([*spans, *((s["start"], s["stop"]) for s in w["spans"])], text)
                    found.append({"n_words": words, "runs": [{"first": a, "last": z} for a, z in runs],
                                  "spans": [{"start": a, "stop": z} for a, z in spans], "items": sorted(items)})
                names = [*b.schema.names[:len(kept)], to]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, ARROW)], names=names)

        out = out.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(run, schema)
    return out


def _joined(spans: list[tuple[int, int]], raw: bytes | None) -> list[tuple[int, int]]:
    """Spans of two passes: joined where only separators lie between, as neighbouring words are."""
    text, out = (raw or b"").decode(), []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] or not text[out[-1][1]:a].encode().translate(FOLD_WORDS).strip()):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def digest(found: str, id_col: str = "doc_id") -> list:
    """The contract's columns from ``annotate``'s struct column."""
    f = F.col(found)
    items = f["items"]
    return [F.col(id_col), f["n_words"].alias("n_words"),
            F.aggregate(f["runs"], F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1).alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
            (F.size(items) > 0).alias("contaminated")]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns as they were."""
    to = fresh(docs, "found")
    return annotate(docs, benchmark, text_col, to=to).where(F.size(F.col(to)["items"]) == 0).select(*docs.columns)
