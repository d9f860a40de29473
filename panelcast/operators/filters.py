"""Row filters and bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.exprs import clip
from panelcast.functions.text import contains_ci
from panelcast.spec import DEFAULT_SPEC, PanelSpec

c = F.col


def min_exposure(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, threshold: float = 50.0) -> DataFrame:
    """Keep periods with exposure >= threshold (pushed to the scan when it is a stored column)."""
    return df.filter(c(spec.exposure) >= threshold)


def periods(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, *, equal: int | None = None,
            before: int | None = None, since: int | None = None, among: Sequence[int] | None = None) -> DataFrame:
    """Period filters; on a ``period=``-partitioned table they prune directories."""
    p = c(spec.period)
    if equal is not None:
        df = df.filter(p == equal)
    if before is not None:
        df = df.filter(p < before)
    if since is not None:
        df = df.filter(p >= since)
    if among is not None:
        df = df.filter(p.isin(list(among)))
    return df


def with_target(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """P4."""
    return df.filter(c(spec.target).isNotNull())


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P5: drop rows with a NULL in any of ``columns``."""
    return df.na.drop(how="any", subset=list(columns))


def find_entity(df: DataFrame, text: str, spec: PanelSpec = DEFAULT_SPEC, regex: bool = False) -> DataFrame:
    """Case-insensitive name search; a NULL name never matches."""
    return df.filter(contains_ci(spec.name, text, regex=regex))


def lookup(df: DataFrame, entity, period: int, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """P10: rows of one (entity, period).  ``require_rows`` checks emptiness lazily-cheap."""
    return df.filter((c(spec.entity) == F.lit(entity)) & (c(spec.period) == period))


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    if not df.limit(1).take(1):
        raise LookupError(f"no {what} found")
    return df


def flagged(df: DataFrame, flag_col: str, value: int = 1) -> DataFrame:
    """P11."""
    return df.filter(c(flag_col) == value)


def clip_lower(df: DataFrame, column: str, lower: float = 0.0) -> DataFrame:
    """P12."""
    return df.withColumn(column, clip(column, lower=lower))


def clip_range(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """P13."""
    return df.withColumn(column, clip(column, lower=lower, upper=upper))
