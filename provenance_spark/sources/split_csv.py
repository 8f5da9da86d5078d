"""CSV with quoted newlines, read by many tasks however large a file is.

A quoted newline hides where rows begin, so a chunk of a file can't tell by itself whether it starts inside a quoted field.
Three steps settle it; no text is shuffled but that of rows which cross a chunk's end:

1. every chunk (an input split of the text source, named by file and block start) runs over its lines under both assumptions, "a row
   begins here" and "a quoted field goes on here", and reports for each how many rows begin, whether the last one stays open, and where;
2. a prefix scan over these reports, one small row a chunk, follows the true state through each file. It is a window over maps of two
   states: the last chunk whose end doesn't depend on its start, and the number of swaps since. The same scan adds up exact row numbers;
3. chunks parse their whole rows side by side. A row that crosses chunks is put together from the pieces that its chunks hold.

Row numbers are exact, so a cap of n rows is a filter, and chunks beyond it are never parsed.

Grammar: fields end at the delimiter; a field that begins with a quote ends at the next single quote, doubled quotes are one, and what
follows it up to the delimiter belongs to it; quotes elsewhere are text. Rows end at a newline, with or without a carriage return before it. Empty lines
between rows don't count. Where a file's header ends in carriage return and newline, that pair within quotes is read as a newline. An empty unquoted field and the null marker are null. Missing fields are null, surplus ones fall away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenance_spark.session import checked_broadcast, cut_lineage

#: Chunks whose states are broadcast: at 128 MB each, 256 TB.
MAX_CHUNKS = 2_000_000

REPORT = ("source string, file string, block long, r_rows long, r_open boolean, r_last long, "
          "q_rows long, q_open boolean, q_last long, q_head long, header string")


class Grammar:
    """The field grammar of one delimiter, over bytes."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter.encode())
        quoted = rb'"(?:[^"]++|"")*+'
        tail = rb"[^" + d + rb"]*+"
        field = rb"(?:" + quoted + rb'"' + tail + rb"|(?!\")" + tail + rb")"
        self._open = re.compile(rb"(?:" + field + d + rb")*+" + quoted + rb"\Z", re.S)
        self._close = re.compile(rb'(?:[^"]++|"")*+"' + tail, re.S)
        self._field = re.compile(rb'(?:"((?:[^"]++|"")*+)"(' + tail + rb")|(?!\")(" + tail + rb"))(" + d + rb"|\Z)", re.S)

    def stays_open(self, line: bytes, inside: bool) -> bool:
        """Whether a quoted field is open at the end of ``line``, given whether one was at its start."""
        if b'"' not in line:
            return inside
        if inside:
            m = self._close.match(line)
            if m is None:
                return True
            if m.end() == len(line):
                return False
            line = line[m.end() + 1:]
        return self._open.match(line) is not None

    def fields(self, row: bytes) -> list[bytes | None]:
        """The fields of a whole row; None for an empty unquoted one."""
        out: list[bytes | None] = []
        for m in self._field.finditer(row):
            if m[1] is not None:
                out.append(m[1].replace(b'""', b'"') + m[2])
            else:
                out.append(m[3] or None)
            if not m[4]:
                break
        return out


def _blank(line: bytes) -> bool:
    return line in (b"", b"\r")


def _row_text(lines: Sequence[bytes]) -> bytes:
    text = b"\n".join(lines)
    return text[:-1] if text.endswith(b"\r") else text


def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """(key columns, lines) of each chunk; a chunk's lines are neighbours and in the file's order. ``file`` and ``block`` are the keys 1 and 2."""
    from itertools import chain, groupby

    def runs() -> Iterator[tuple[tuple, list[bytes]]]:
        for b in batches:
            if not b.num_rows:
                continue
            block, file = b.column(2).to_numpy(), b.column(1).dictionary_encode().indices.to_numpy()
            starts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1), b.num_rows]
            values = b.column(keys).to_pylist()
            for i, j in zip(starts, starts[1:], strict=False):
                yield tuple(b.column(k)[int(i)].as_py() for k in range(keys)), values[i:j]

    for key, group in groupby(runs(), key=lambda r: r[0]):
        yield key, chain.from_iterable(r[1] for r in group)


def _lines(spark: SparkSession, sources: Mapping[str, str]) -> DataFrame:
    """``(source, file, block, value)``: physical lines of every source's files."""
    parts = []
    for name, path in sources.items():
        text = spark.read.option("lineSep", "\n").text(path)
        parts.append(text.select(F.lit(name).alias("source"), F.col("_metadata.file_path").alias("file"),
                                 F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _reports(lines: DataFrame, delimiter: str) -> DataFrame:
    """Step 1: one row a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(delimiter)
        out = []
        for (source, file, block), values in _chunks(batches, 3):
            rows, open_, last, head, header = [0, 0], [False, True], [0, 0], None, []
            for i, line in enumerate(values):
                blank = _blank(line)
                for state in (0, 1):
                    if not open_[state] and not blank:
                        rows[state] += 1
                        last[state] = i
                        if state and head is None:
                            head = i
                if block == 0 and rows[0] == 1:
                    header.append(line)
                if b'"' in line:
                    open_ = [grammar.stays_open(line, s) if s or not blank else False for s in open_]
            out.append({"source": source, "file": file, "block": block, "r_rows": rows[0], "r_open": open_[0], "r_last": last[0],
                        "q_rows": rows[1], "q_open": open_[1], "q_last": last[1], "q_head": i + 1 if head is None else head,
                        "header": b"\n".join(header).decode(errors="replace") if header else None})
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("source", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("r_rows", pa.int64()), ("r_open", pa.bool_()),
            ("r_last", pa.int64()), ("q_rows", pa.int64()), ("q_open", pa.bool_()), ("q_last", pa.int64()), ("q_head", pa.int64()),
            ("header", pa.string())]))

    return lines.mapInArrow(run, REPORT)


def _scan(reports: DataFrame) -> DataFrame:
    """Step 2: the true state at each chunk's start, its first row number, and where a row that is open there began."""
    file = Window.partitionBy("source", "file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("r_open") == F.col("q_open")
    swap = (F.col("r_open") & ~F.col("q_open")).cast("int")
    swaps = F.coalesce(F.sum(swap).over(before), F.lit(0))
    seen = reports.withColumn("swaps", swaps)
    anchor = F.last(F.when(fixed, F.struct(F.col("r_open").cast("int").alias("state"), "swaps")), ignorenulls=True).over(before)
    seen = seen.withColumn("anchor", anchor)
    state = (F.coalesce(F.col("anchor.state"), F.lit(0)) + F.col("swaps") - F.coalesce(F.col("anchor.swaps"), F.lit(0))) % 2 == 1
    seen = seen.withColumn("inside", state)
    rows = F.when(F.col("inside"), F.col("q_rows")).otherwise(F.col("r_rows"))
    seen = seen.withColumns({"rows": rows, "open": F.when(F.col("inside"), F.col("q_open")).otherwise(F.col("r_open")),
                             "last": F.when(F.col("inside"), F.col("q_last")).otherwise(F.col("r_last")),
                             "head": F.when(F.col("inside"), F.col("q_head")).otherwise(F.lit(0))})
    path = Window.partitionBy("source").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("rows") - F.when((F.col("block") == 0) & (F.col("rows") > 0), 1).otherwise(0)  # the header is no row
    return seen.withColumns({
        "first": F.coalesce(F.sum(own).over(path), F.lit(0)), "own": own,
        "begins": F.col("open") & (F.col("rows") > 0),
        "home": F.last(F.when(F.col("open") & (F.col("rows") > 0), F.col("block")), ignorenulls=True).over(before),
        "header": F.first("header", ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).select("source", "file", "block", "inside", "rows", "open", "last", "head", "first", "own", "begins", "home", "header")


def _named(header: str | None, columns: Sequence[str], grammar: Grammar) -> list[int]:
    """Places of ``columns`` in a file's header; an unknown column is an error."""
    names = [(f or b"").decode() for f in grammar.fields((header or "").lstrip("\ufeff").rstrip("\r\n").encode())]
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"no column {missing} in the header {names}")
    return [names.index(c) for c in columns]


class CsvScan:
    """CSV files with a header, planned: the true state and the first row of every chunk.

    ``sources`` names paths; a folder's files follow each other by name. ``totals`` holds the rows of each source.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, str], delimiter: str = ",", null_value: str = "\\N"):
        self.delimiter, self.null_value, self.sources = delimiter, null_value, dict(sources)
        self.lines = _lines(spark, sources)
        self.plan = cut_lineage(_scan(_reports(self.lines, delimiter)))
        found = {r["source"]: r["n"] for r in self.plan.groupBy("source").agg(F.sum("own").alias("n")).collect()}  # a row a source
        self.totals = {s: found.get(s, 0) for s in sources}

    def rows(self, columns: Sequence[str], first_rows: int | Mapping[str, int | None] | None = None) -> DataFrame:
        """``(source, file, pos, *columns)`` as strings; ``pos`` counts a source's rows from 0, ``first_rows`` keeps that many of each.

        Empty files and files of a header alone have no rows. Should the cluster's size change the splits between the passes, the
        read fails rather than lose rows.
        """
        return _parsed(self, columns, first_rows)


def scan_csv(spark: SparkSession, sources: Mapping[str, str], columns: Sequence[str], delimiter: str = ",", null_value: str = "\\N",
             first_rows: int | Mapping[str, int | None] | None = None) -> DataFrame:
    """:meth:`CsvScan.rows` of a fresh scan."""
    return CsvScan(spark, sources, delimiter, null_value).rows(columns, first_rows)


def _parsed(scan: CsvScan, columns: Sequence[str], first_rows: int | Mapping[str, int | None] | None) -> DataFrame:
    """Step 3."""
    lines, plan, delimiter, null_value, sources = scan.lines, scan.plan, scan.delimiter, scan.null_value, scan.sources
    caps = first_rows if isinstance(first_rows, Mapping) else dict.fromkeys(sources, first_rows)
    cap = F.create_map(*[x for s in sources for x in (F.lit(s), F.lit(caps.get(s)).cast("long"))])[F.col("source")]
    held = checked_broadcast(plan.withColumn("wanted", cap.isNull() | (F.col("first") < cap)), MAX_CHUNKS)
    at = ["source", "file", "block"]
    found = lines.join(held, at, "left")
    known = F.when(F.col("wanted").isNull(), F.raise_error(F.lit("the files' splits changed while they were read: read them again")).cast("boolean"))
    found = found.where(known.otherwise(F.col("wanted")))
    names = [*at, "inside", "head", "first", "header"]
    kept = [F.element_at("f", i + 1).alias(c) for i, c in enumerate(columns)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, null = Grammar(delimiter), null_value.encode()
        out: list[tuple] = []
        size = 0
        for (source, file, block, inside, head, first, header), values in _chunks(batches, len(names)):
            places = _named(header, columns, grammar)
            pos = first - (block == 0)
            row: list[bytes] = []
            open_ = False
            for i, line in enumerate(values):
                if i < head or (not row and _blank(line)):
                    continue
                row.append(line)
                open_ = grammar.stays_open(line, open_)
                if open_:
                    continue
                if pos >= first:
                    out.append((source, file, pos, _picked(_row_text(row), grammar, header, places, null)))
                    size += sum(map(len, row))
                    if len(out) >= 1000 or size >= 1 << 23:
                        yield _rows(out)
                        out, size = [], 0
                pos, row = pos + 1, []
        yield _rows(out)

    schema = "source string, file string, pos long, f array<string>"
    whole = found.select(*names, "value").mapInArrow(parse, schema)

    if scan.plan.where("inside OR begins").isEmpty():  # no row crosses a chunk's end
        return whole.where(cap.isNull() | (F.col("pos") < cap)).select("source", "file", "pos", *kept)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (source, file, block, home, head, begins, last, pos), values in _chunks(batches, 8):
            front, back = [], []
            for i, line in enumerate(values):
                if i < head:
                    front.append(line)
                elif begins and i >= last:
                    back.append(line)
            for start, text, number in ((home, front, None), (block, back, pos)):
                if text:
                    out.append({"source": source, "file": file, "home": start, "block": block, "pos": number, "text": b"\n".join(text)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("source", pa.string()), ("file", pa.string()), ("home", pa.int64()), ("block", pa.int64()),
                                                         ("pos", pa.int64()), ("text", pa.binary())]))

    crossing = found.where("inside OR begins").select(*at, "home", "head", "begins", "last", (F.col("first") + F.col("own") - 1).alias("pos"), "value")
    parts = crossing.mapInArrow(pieces, "source string, file string, home long, block long, pos long, text binary")
    joined = parts.groupBy("source", "file", "home").agg(
        F.max("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p")).where("pos IS NOT NULL")
    headers = checked_broadcast(plan.where("block = 0").select("source", "file", "header"), MAX_CHUNKS)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, null = Grammar(delimiter), null_value.encode()
        for b in batches:
            yield _rows([(s, f, pos, _picked(_row_text([x["text"] for x in p]), grammar, header, _named(header, columns, grammar), null))
                         for s, f, pos, p, header in zip(*(c.to_pylist() for c in b.columns), strict=True)])

    crossed = joined.join(headers, ["source", "file"]).select("source", "file", "pos", "p", "header").mapInArrow(stitch, schema)
    return whole.union(crossed).where(cap.isNull() | (F.col("pos") < cap)).select("source", "file", "pos", *kept)


def _picked(row: bytes, grammar: Grammar, header: str | None, places: Sequence[int], null: bytes) -> list[str | None]:
    if b"\r\n" in row and (header or "").rstrip("\n").endswith("\r"):
        row = row.replace(b"\r\n", b"\n")
    fields = grammar.fields(row)
    return [None if i >= len(fields) or fields[i] is None or fields[i] == null else fields[i].decode() for i in places]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["source", "file", "pos", "f"])
