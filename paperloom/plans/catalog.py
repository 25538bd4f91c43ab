"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from paperloom.storage import workers_find_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: By query, the rows of the operator inventory that it applies.
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, sql: str | None = None, covers: str = "") -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it, and the inventory's rows that it applies."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_package(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
