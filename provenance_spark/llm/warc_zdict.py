"""WARC archives, each with its own Zstandard dictionary.

Every page becomes one WARC/1.1 record. Of records with equal payloads the one with the least id is a
``response``, the others are ``revisit`` records that refer to it and carry no payload. A task gathers records
up to ``ARCHIVE_BYTES``, trains a dictionary on evenly spaced ones, writes it as a leading skippable frame (magic
0x184D2A5D) and each record as a frame of its own, so records can be read singly and a worker's memory is bounded.

Archives go to a folder all executors share. A file's name is unique to the attempt that wrote it, and only files
in the returned table of archives are read: what a lost attempt leaves behind doesn't count.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenance_spark.llm.common import bound_batches
from provenance_spark.session import checked_broadcast, cut_lineage, shuffle_partitions

ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
#: Bytes of records that a dictionary is trained on.
TRAIN_BYTES = 4 << 20
LEVEL = 3
MIN_REVISIT = 0
#: Digests of copies that are broadcast at most: 32 characters and an id each, about 30 MB.
MAX_COPIES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32: five hex digits make four characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``(id, url, payload, digest, size, first)``: first is the id a revisit refers to, null for a response.

    Copies are found on (id, digest, size) alone. Digests that occur twice or more, with their least id, are broadcast up to
    ``MAX_COPIES`` rows, so payloads stay in the tasks that read them; beyond it payloads meet them in a shuffle.
    """
    rows = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
            .withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.length("payload").cast("long")))
    copies = (rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "least"))
    copies = checked_broadcast(copies, MAX_COPIES)
    revisit = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    return rows.join(copies, "digest", "left").select(
        "id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("least")).alias("first"))


def _urn(page: int | None) -> str:
    return f"<urn:page:{NO_ID if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int, first: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit (payload None) that refers to ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {''.join((url or 'urn:none').split())}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if payload is None:
        head += [f"WARC-Refers-To: {_urn(first)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """Trained on evenly spaced records; where there are too few to train, their bytes themselves are the dictionary."""
    step = max(1, sum(map(len, records)) // TRAIN_BYTES)
    samples, size = [], 0
    for r in records[::step]:
        samples.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    try:
        return zstd.train_dictionary(min(DICT_BYTES, max(256, size // 8)), samples)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    words = dictionary(records)
    embedded = words.as_bytes()
    press = zstd.ZstdCompressor(level=LEVEL, dict_data=words)
    return b"".join([struct.pack("<II", MAGIC, len(embedded)), embedded, *map(press.compress, records)])


def read_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    magic, size = struct.unpack("<II", raw[:8])
    if magic != MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    words = zstd.ZstdCompressionDict(raw[8:8 + size])
    stream = io.BufferedReader(zstd.ZstdDecompressor(dict_data=words).stream_reader(raw[8 + size:], read_across_frames=True), 1 << 20)
    while version := stream.readline():
        if version.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {}
        while line := stream.readline().strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, block


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of ``pages`` below ``folder`` (a URI that all executors reach); ``(path, n_records, n_bytes)`` of each archive.

    A null html is an empty payload; rows whose id repeats are records each. Rows with a null id are
    responses, or revisits of the least id with their payload if there is one. An empty table writes nothing.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            store.create_dir(base, recursive=True)
            name, raw = f"{uuid.uuid4().hex}.warc.zst", archive(held)
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(raw)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(held)], "n_bytes": [len(raw)]})

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = plan_records(pages, id_col, url_col, html_col, min_revisit)
    return cut_lineage(rows.mapInArrow(run, "path string, n_records long, n_bytes long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)`` of every record of the archives.

    A response's payload is checked against its digest. A revisit has a null payload; its length and digest are
    those its headers state for the full payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                with store.open_input_stream(at, compression=None) as f:
                    raw = f.read()
                rows: list[tuple] = []
                for head, block in read_archive(raw):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http.rpartition(b":")[2])
                    page, first = (head.get(k, "").rpartition(":")[2].rstrip(">") for k in ("warc-record-id", "warc-refers-to"))
                    if head["warc-type"] == "response" and (size != len(payload) or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of page {page} in {path} doesn't match its digest")
                    rows.append((None if page == NO_ID else int(page), size, digest, head["warc-type"], int(first) if first else None,
                                 payload if head["warc-type"] == "response" else None))
                    if len(rows) == 1000:
                        yield _batch(rows, names, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    spread = archives.select("path").repartition(shuffle_partitions(archives.sparkSession))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
