"""Deterministic splits (M1, M12 folds, M13 nested shares).

A split is a column computed from a hash of the key: independent of
partitioning, row order and executor count, so it survives recomputation
after an executor loss and reproduces in plain SQL.  ``randomSplit`` depends
on partition layout and is avoided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.exprs import hash_bucket
from panelcast.spec import DEFAULT_SPEC, PanelSpec

c = F.col


def split_key(spec: PanelSpec = DEFAULT_SPEC, by: str = "row") -> Column:
    """``by='row'`` hashes (entity, period) like a row-level shuffle split;
    ``by='entity'`` keeps each career on one side (no leakage across periods)."""
    if by == "entity":
        return c(spec.entity).cast("string")
    return F.concat_ws("|", c(spec.entity).cast("string"), c(spec.period).cast("string"))


def hash_split(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, test_share: float = 0.2,
               by: str = "row", salt: str = "", name: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' for hash bucket < 100 * test_share, else 'train'."""
    b = hash_bucket(split_key(spec, by), 100, salt)
    return df.withColumn(name, F.when(b < int(round(test_share * 100)), F.lit("test")).otherwise(F.lit("train")))


def with_bucket(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, by: str = "row", salt: str = "",
                name: str = "bucket") -> DataFrame:
    return df.withColumn(name, hash_bucket(split_key(spec, by), 100, salt))


def with_folds(df: DataFrame, k: int = 5, spec: PanelSpec = DEFAULT_SPEC, by: str = "row",
               name: str = "fold") -> DataFrame:
    """k-fold assignment from the same hash: fold = bucket mod k."""
    return df.withColumn(name, (hash_bucket(split_key(spec, by), 100) % k).cast("int"))
