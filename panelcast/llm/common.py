"""Helpers that the operators share: reading, cutting lineage, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import ensure_checkpoint_dir, ship_package

ROWS = 512          # rows that a task handles at once
WHITE = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read
    again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, fn: Callable[[list[list]], Iterable[tuple]], schema: str | T.StructType,
             rows: int = ROWS) -> DataFrame:
    """Apply ``fn`` to column lists of at most ``rows`` rows in Arrow batches;
    it yields output tuples."""
    ship_package(df.sparkSession)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = list(fn([c.to_pylist() for c in part.columns]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def words(text: str | bytes | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` as UTF-8; none for null."""
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's), vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def fold(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def grouped(fn: Callable[[tuple, list[tuple]], Iterable[tuple]], keys: int, schema: str):
    """Body and schema for ``mapInArrow`` over partitions sorted by their first
    ``keys`` columns: ``fn`` gets one key and its rows' other columns at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:keys] != open_key:
                    if rows:
                        out += fn(open_key, rows)
                    open_key, rows = row[:keys], []
                rows.append(row[keys:])
            if out:
                yield batch_of(out)
        if rows and (out := list(fn(open_key, rows))):
            yield batch_of(out)

    return run, kind


def by_key(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``grouped`` over ``df``, whose first columns must be ``keys``, dealt by them."""
    ship_package(df.sparkSession)
    run, kind = grouped(fn, len(keys), schema)
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def keep_rows(df: DataFrame, column: str, fn: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows of ``df``, all columns, for whose ``column`` values ``fn``
    gives true; nothing is shuffled."""
    ship_package(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield part.filter(pa.array(np.asarray(fn(part.column(at).to_pylist()), bool)))

    return df.mapInArrow(run, df.schema)
