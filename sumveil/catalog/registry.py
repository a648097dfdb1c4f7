"""Registry of named queries: the Spark query, the operators it covers, its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sumveil.session import ship


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a query; without SQL it is checked by tests on small fixtures only."""

    def add(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query registered twice: {key}")

        @wraps(fn)
        def run(spark, sf):
            ship(spark)
            return fn(spark, sf)

        REGISTRY[key] = Entry(key, covers, run, sql)
        return fn

    return add
