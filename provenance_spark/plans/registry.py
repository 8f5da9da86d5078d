"""Named queries: a Spark builder, the operator ids it covers and (when SQL can say it) an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from provenance_spark.session import ship_package

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        text = sql() if callable(sql) else sql

        @wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # sessions made by a caller have not shipped the package yet
            return fn(spark, sf_dir)

        REGISTRY[name] = Query(name, operators, build, text)
        return fn
    return deco
