"""Small column-expression helpers shared by all operators.

All return ``Column`` objects built from Spark's built-in functions, so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with NULL for a zero or NULL denominator (P20, ANSI-safe)."""
    d = col(den)
    return F.when(d != 0, col(num) / d)


def flag(cond: Column) -> Column:
    """0/1 integer flag; NULL (or NaN-derived NULL) conditions become 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)


def clip(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip to bounds; a NULL input stays NULL (greatest/least skip NULLs)."""
    x = col(c)
    out = x
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(x.isNotNull(), out)


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    return F.bround(col(c), scale)


def right_closed_cut(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (e_i, e_{i+1}] containing the value, NULL outside."""
    x = col(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def hash_bucket(key: str | Column, buckets: int = 100, salt: str = "") -> Column:
    """Deterministic bucket in [0, buckets) from the first 32 bits of md5(salt || key).

    Independent of partitioning and row order, and reproducible in plain SQL.
    """
    k = col(key).cast("string")
    if salt:
        k = F.concat(F.lit(salt), k)
    h = F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(buckets)).cast("int")


def round_scaled(c: str | Column, scale: int = 6) -> Column:
    """``round(x * 10^scale) / 10^scale``: rounds the scaled binary value half
    away from zero, the common definition of SQL engines' double rounding
    (Spark's own ``round`` rounds the exact binary fraction instead, which
    differs on values that print as an exact half)."""
    m = float(10 ** scale)
    return F.round(col(c) * F.lit(m), 0) / F.lit(m)


def round_doubles(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every double/float column; used at result boundaries so that
    engine-dependent summation order cannot change reported digits."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(round_scaled(F.col(f"`{f.name}`"), scale).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)
