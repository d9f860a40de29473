"""Readers for landed tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read one Parquet table; selecting ``columns`` here lets the scan prune."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header (S1).  Pass ``schema`` in production: inference costs
    a full extra pass over the files."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def union_periods(frames: Iterable[tuple[int, DataFrame]], period: str = "season") -> DataFrame:
    """Tag each yearly source with its period and concatenate by column name.

    Sources may differ in their optional columns; missing ones become NULL.
    Empty sources simply contribute no rows (no action is run to test them).
    """
    out = None
    for value, df in frames:
        tagged = df.withColumn(period, F.lit(int(value)))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out


def read_partitioned(spark: SparkSession, path: str, period: str = "season",
                     periods: Sequence[int] | None = None) -> DataFrame:
    """Read a ``period=YYYY/`` partitioned table; a period filter prunes directories."""
    df = spark.read.parquet(path)
    if periods is not None:
        df = df.filter(F.col(period).isin(list(periods)))
    return df
