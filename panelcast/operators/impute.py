"""Missing-data profiling and imputation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.quantiles import column_medians
from panelcast.session import ensure_checkpoint_dir
from panelcast.sources.contract import numeric_columns

c = F.col


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column in one pass, long format, only columns with NULLs."""
    cols = list(columns) if columns is not None else df.columns
    wide = df.agg(*[F.count(F.when(c(f"`{x}`").isNull(), 1)).alias(x) for x in cols])
    long = wide.unpivot([], [f"`{x}`" for x in cols], "column_name", "null_count")
    return long.filter(c("null_count") > 0)


def fill_constants(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Constant imputation (e.g. 100 = league average)."""
    present = {k: v for k, v in values.items() if k in df.columns}
    return df.fillna(present) if present else df


ZERO_FILL_PATTERN = r"%|pct"


def typed_impute(df: DataFrame, columns: Sequence[str] | None = None, zero_pattern: str = ZERO_FILL_PATTERN,
                 exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns whose name matches ``zero_pattern`` get 0, the
    others their column median (medians in one job, applied as literals).  The frame is
    checkpointed, so that medians and fills share one run of its plan."""
    cols = [x for x in (columns or numeric_columns(df)) if x not in exclude]
    zero = [x for x in cols if re.search(zero_pattern, x)]
    rest = [x for x in cols if x not in zero]
    out = df.fillna({x: 0 for x in zero}) if zero else df
    if rest:
        ensure_checkpoint_dir(df.sparkSession)
        out = out.checkpoint(eager=True)
        med = column_medians(out, rest)
        out = out.withColumns({x: F.coalesce(c(x), med[x]) for x in rest})
    return out


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill joined columns with their median; also return fill counts via
    ``fill_counts`` when a report is wanted."""
    med = column_medians(df, columns)
    return df.withColumns({x: F.coalesce(c(x), med[x]) for x in columns})


def fill_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many values ``median_impute`` would fill, with the fill value."""
    med = column_medians(df, columns)
    rows = [F.struct(F.lit(x).alias("column_name"),
                     F.count(F.when(c(x).isNull(), 1)).alias("filled"),
                     F.first(med[x]).alias("fill_value")) for x in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def zero_safe(df: DataFrame, column: str, mode: str = "null") -> DataFrame:
    """P20: a zero denominator becomes NULL (``mode='null'``) or 1 (``'one'``)."""
    x = c(column)
    return df.withColumn(column, F.when(x != 0, x) if mode == "null" else F.when(x == 0, F.lit(1)).otherwise(x))
