"""Registry that keeps each query next to the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestar.session import table, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


class Tables:
    """Attribute access to the given tables: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(covers: str, sql: str | None = None):
    """Register ``fn(t)`` under its own name; ``covers`` lists the survey rows."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        QUERIES[fn.__name__] = run
        COVERS[fn.__name__] = tuple(covers.split())
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register
