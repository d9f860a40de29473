"""Scores built from global statistics (W12 momentum score, W19 injury risk).

Global statistics are one ungrouped aggregate (partial aggregates per task,
then one row) used as one struct-valued scalar subquery: Spark runs the
aggregate once and inlines the values into a map-side projection.  An unpartitioned window would instead pull every row into one
task.  ``stats_from`` lets the statistics come from another frame (e.g.
the training split) to avoid leaking test rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.exprs import clip
from panelcast.operators.windows import availability_features, career_features, first_period_fills
from panelcast.spec import DEFAULT_SPEC, MOMENTUM_WEIGHTS, RECENT_GAP_CAP, RISK_WEIGHTS, PanelSpec

c = F.col


def scalars(stats: DataFrame) -> dict[str, F.Column]:
    """Columns of a one-row aggregate as scalar-subquery expressions."""
    whole = stats.select(F.struct(*[c(f"`{x}`") for x in stats.columns]).alias("s")).scalar()
    return {name: whole.getField(name) for name in stats.columns}


def momentum_score(df: DataFrame, weights: dict[str, float] = MOMENTUM_WEIGHTS,
                   stats_from: DataFrame | None = None) -> DataFrame:
    """sum_i w_i * delta_i / stddev_samp(delta_i); a negative weight means lower is better."""
    src = stats_from if stats_from is not None else df
    sd = scalars(src.agg(*[F.stddev_samp(c(d)).alias(d) for d in weights]))
    score = None
    for d, w in weights.items():
        term = c(d) / F.when(sd[d] != 0, sd[d]) * F.lit(w)
        score = term if score is None else score + term
    return df.withColumn("momentum_score", score)


def momentum_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC,
                      stats_from: DataFrame | None = None) -> DataFrame:
    """The 31-column year-over-year block (W2-W13) in source order of evaluation:
    lags/deltas/flags/rolling -> momentum score on unfilled deltas -> fills."""
    feats = career_features(df, spec)
    scored = momentum_score(feats, stats_from=stats_from)
    return first_period_fills(scored, spec)


def risk_score(df: DataFrame, weights: dict[str, float] = RISK_WEIGHTS,
               stats_from: DataFrame | None = None) -> DataFrame:
    """Injury risk in [0, 1] from availability features."""
    src = stats_from if stats_from is not None else df
    st = scalars(src.agg(F.max("consecutive_active_years").alias("max_streak"),
                         F.max("ip_volatility").alias("max_vol")))
    f1 = c("missed_previous_season")
    f2 = 1 - c("consecutive_active_years") / st["max_streak"]
    f3 = clip(F.lit(RECENT_GAP_CAP) - c("years_since_injury"), 0, RECENT_GAP_CAP) / RECENT_GAP_CAP
    f4 = 1 - c("career_availability_rate")
    f5 = F.when(st["max_vol"] > 0, c("ip_volatility") / st["max_vol"]).otherwise(F.lit(0.0))
    score = (F.lit(weights["missed"]) * f1 + F.lit(weights["streak"]) * f2 + F.lit(weights["recent"]) * f3
             + F.lit(weights["availability"]) * f4 + F.lit(weights["volatility"]) * f5)
    return df.withColumn("injury_risk_score", score)


def injury_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC,
                    stats_from: DataFrame | None = None) -> DataFrame:
    """Availability windows then the composite risk score."""
    return risk_score(availability_features(df, spec), stats_from=stats_from)
