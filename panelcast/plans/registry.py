"""Registry of named queries: a Spark plan ``(spark, sf_dir) -> DataFrame``
plus, where SQL can express it, an independent DuckDB oracle statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelcast.functions.exprs import round_doubles


@dataclass(frozen=True)
class RegisteredQuery:
    name: str
    ops: str                      # operator ids from the survey inventory
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, RegisteredQuery] = {}


def query(name: str, ops: str, sql: str | None = None, rounding: int | None = 6):
    """Register ``fn`` under ``name``; results are rounded to ``rounding``
    digits so engine-dependent float summation order does not leak into
    reported values."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df, rounding) if rounding is not None else df
        build.__doc__ = fn.__doc__
        build.__name__ = fn.__name__
        REGISTRY[name] = RegisteredQuery(name, ops, build, sql)
        return fn
    return deco
