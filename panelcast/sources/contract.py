"""Schema contract on ingest: rename (P1), defaults for absent columns (P7),
required-column check (P8), NaN -> NULL, numeric-column selection (P19)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.spec import OPTIONAL_DEFAULTS, RENAME_MAP


def rename_present(df: DataFrame, mapping: Mapping[str, str] = RENAME_MAP) -> DataFrame:
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def add_defaults(df: DataFrame, defaults: Mapping[str, object] = OPTIONAL_DEFAULTS,
                 types: Mapping[str, str] | None = None) -> DataFrame:
    types = types or {"games_started": "int", "team": "string", "stuff_plus": "double", "command_plus": "double"}
    missing = {k: F.lit(v).cast(types.get(k, "double")) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above every number (``NaN > 0.5`` is true); the source
    semantics treat NaN as missing, so floating columns carry NULL instead."""
    fixes = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
             for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def require(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


DEFAULT_TYPES = {"games_started": "int", "team": "string", "stuff_plus": "double", "command_plus": "double"}


def ingest(df: DataFrame, mapping: Mapping[str, str] = RENAME_MAP,
           defaults: Mapping[str, object] = OPTIONAL_DEFAULTS) -> DataFrame:
    """Raw season source -> panel schema in one projection: rename (P1),
    NaN -> NULL for floating columns, defaults for absent optional columns (P7)."""
    cols = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x)
        cols.append(x.alias(mapping.get(f.name, f.name)))
    present = {mapping.get(n, n) for n in df.columns}
    cols += [F.lit(v).cast(DEFAULT_TYPES.get(k, "double")).alias(k) for k, v in defaults.items() if k not in present]
    return df.select(*cols)


def notation_to_units(c: str) -> F.Column:
    """Base-3 innings notation (x.1 = 1/3, x.2 = 2/3) to true units.  Opt-in;
    the reference reads the value as a plain decimal."""
    x = F.col(c)
    whole = F.floor(x)
    return whole + F.round((x - whole) * 10) / 3
