"""Materialised stages (S9, S10, S13) and CSV I/O.

``materialize`` writes a stage once as Parquet (partitioned by ``split`` when present) under a key
and reads it back afterwards. A directory counts only when it holds the ``_SUCCESS`` marker the
Parquet committer writes last, so a half-written directory is rebuilt instead of trusted.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenance_spark.sources.split_csv import scan_csv


def cache_key(*parts) -> str:
    """Stage key: parts joined by ``_``, with ``/`` (model checkpoint names) turned into ``-``."""
    return "_".join(str(p).replace("/", "-") for p in parts)


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` (none if it doesn't exist)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(p) if x.isDirectory()] if store.exists(p) else []


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files below ``path`` that aren't hidden (none if it doesn't exist)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(p) if x.isFile()] if store.exists(p) else []
    return [n for n in names if not n.startswith((".", "_"))]


def is_complete(spark: SparkSession, path: str) -> bool:
    return _fs_exists(spark, path.rstrip("/") + "/_SUCCESS")


def materialize(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame],
                partition_by: str | None = "split") -> DataFrame:
    """Load ``root/key`` if it is complete; otherwise build, write (overwrite) and load it."""
    path = f"{root.rstrip('/')}/{key}"
    if not is_complete(spark, path):
        df = build()
        writer = df.write.mode("overwrite")
        if partition_by and partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


#: What stands for null in written CSV, so that the empty text stays the empty text.
CSV_NULL = "\\N"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, no index, quotes doubled, newlines kept inside quoted fields."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
       .option("nullValue", CSV_NULL).option("emptyValue", "").csv(path))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """The columns of ``schema`` by name, from files with a header and any columns around them.

    Quoted newlines don't bind a file to one task (:mod:`provenance_spark.sources.split_csv`). A value that isn't of its type is null.
    """
    rows = scan_csv(spark, {"csv": path}, schema.fieldNames(), null_value=CSV_NULL)
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def local_path(path: str) -> str:
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else path
