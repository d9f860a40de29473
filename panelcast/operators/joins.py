"""Joins and set operations.

Join strategy is left to Catalyst/AQE (sort-merge, or broadcast when the
runtime size of a side is under ``spark.sql.autoBroadcastJoinThreshold``).
No side is force-broadcast: the side tables here grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.text import normalized_name
from panelcast.operators.bitmaps import career_bitmaps, seen_before
from panelcast.spec import DEFAULT_SPEC, PanelSpec

c = F.col


def frequent_keys(df: DataFrame, key: Column, share: float = 0.01) -> list[int]:
    """Hashes of ``key`` on more than ``share`` of the rows that have one, by a mergeable
    frequent-items sketch: one scan, at most ``1 / share`` hashes."""
    most = math.ceil(1 / share)
    got = df.select(key.alias("h")).agg(F.count("h").alias("n"), F.expr(f"approx_top_k(h, {most}, {8 * most})").alias("top")).first()
    return [t["item"] for t in got["top"] or [] if t["item"] is not None and t["count"] > share * got["n"]]


def left_join_normalized(df: DataFrame, side: DataFrame, name: str, period: str,
                         side_name: str | None = None, suffix: str = "_pitch", check_unique: bool = False,
                         hot_share: float | None = None, salts: int = 64) -> DataFrame:
    """Left join on (normalised name, period).

    Right-side columns that collide with left ones get ``suffix``; the helper
    key and the right name column are dropped.  Rows without a name or period match nothing: they
    are dealt out by a hash of the whole row instead of meeting in one task.
    With ``hot_share``, keys on more than that share of the left rows are found in a scan of ``df``
    (hand in a landed or checkpointed frame), their left rows spread over ``salts`` parts and their
    right rows copied to each.  With ``check_unique`` the join itself raises where a right key repeats
    (it would duplicate left rows); the count shares the join's shuffle.
    """
    side_name = side_name or name
    left = df.withColumn("_name_key", normalized_name(name))
    right = side.withColumn("_name_key", normalized_name(side_name)).filter(
        c("_name_key").isNotNull() & c(period).isNotNull())
    key = F.xxhash64("_name_key", period)
    hot = frequent_keys(left, key, hot_share) if hot_share else []
    whole_row = F.xxhash64(*[c(f"`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString()])
    spread = F.when(c("_name_key").isNull() | c(period).isNull(), whole_row)
    parts = F.array(F.lit(0).cast("long"))
    if hot:
        spread = spread.when(key.isin(hot), F.pmod(whole_row, F.lit(salts)))
        parts = F.when(key.isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(parts)
    left = left.withColumn("_spread", spread.otherwise(F.lit(0).cast("long")))
    right = right.withColumn("_spread", F.explode(parts))
    clash = set(df.columns) - {period}
    right = right.select(*[c(f"`{x}`").alias(f"{x}{suffix}" if x in clash else x)
                           for x in right.columns])
    on = ["_name_key", period, "_spread"]
    if check_unique:
        copies = F.count(F.lit(1)).over(Window.partitionBy(*on))
        right = right.withColumn("_copies", copies).withColumn("_spread", F.when(
            c("_copies") > 1, F.raise_error(F.concat(F.lit("side table repeats "), "_name_key")).cast("long"))
            .otherwise(c("_spread"))).drop("_copies")
    out = left.join(right, on=on, how="left")
    return out.drop("_name_key", "_spread", f"{side_name}{suffix}" if side_name in clash else side_name)


def match_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where any joined column is non-NULL, of all rows."""
    any_hit = F.coalesce(*[c(x).cast("double") for x in columns]).isNotNull()
    return df.agg(F.count(F.when(any_hit, 1)).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn(
        "match_pct", c("matched") * 100.0 / F.nullif(c("total"), F.lit(0)))


def absent_entities(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, latest: int | None = None,
                    lookback: int = 3) -> DataFrame:
    """Entities seen in any of the ``lookback`` periods before ``latest`` but not in ``latest``,
    by their career bitmaps (one scan of ``df``); ``latest`` defaults to the newest period."""
    careers = career_bitmaps(df, spec)
    return seen_before(careers, careers.agg(F.max("last")).first()[0] if latest is None else latest, lookback).select(spec.entity)


def missing_periods(expected: DataFrame, present: DataFrame, period: str) -> DataFrame:
    """Periods of ``expected`` absent from ``present``."""
    return expected.select(period).distinct().join(present.select(period).distinct(), period, "left_anti")


def membership_flag(df: DataFrame, column: str, members: Sequence[str], name: str = "is_member") -> DataFrame:
    """0/1 flag for membership in a (small, literal) list."""
    return df.withColumn(name, c(column).isin(list(members)).cast("int"))


def compare_side_by_side(metrics: Mapping[str, DataFrame], key: str = "metric", value: str = "value") -> DataFrame:
    """Metrics tables (key, value) of several runs as one row per metric."""
    out = None
    for name, m in metrics.items():
        m2 = m.select(key, c(value).alias(name))
        out = m2 if out is None else out.join(m2, key, "full_outer")
    return out
