"""Projection products.

Everything is set-based: the supplemental projection scores all absent
entities in one ``transform`` (the source loops one entity at a time), and
ranks come from the distributed ``global_rank``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.text import season_note
from panelcast.operators.rank import global_rank
from panelcast.operators.windows import latest_row
from panelcast.spec import (
    DEFAULT_SPEC, MIN_EXPOSURE_SUPPLEMENTAL, RANGE_HALF_WIDTH, SCENARIO_FACTORS_HIGH, SCENARIO_FACTORS_LOW,
    SCENARIO_FACTORS_MEDIUM, SCENARIO_FACTORS_MISSED, SCENARIO_RATE_FACTOR, SUPPLEMENTAL_DECAY_PER_YEAR,
    SUPPLEMENTAL_MAX_YEARS_AWAY, SUPPLEMENTAL_OLD_AGE, SUPPLEMENTAL_OLD_PENALTY, SUPPLEMENTAL_WIDTH_PER_YEAR,
    TIER_CUTS, PanelSpec,
)

c = F.col


def _half_even_int(x) -> F.Column:
    return F.bround(x, 0).cast("int")


def project(scored: DataFrame, spec: PanelSpec = DEFAULT_SPEC, predicted: str = "predicted",
            half_width: int = RANGE_HALF_WIDTH) -> DataFrame:
    """Integer projection (half-even), range +-half_width clipped at 0, unique rank."""
    p = _half_even_int(c(predicted))
    out = scored.select(
        c(spec.entity), c(spec.name).alias("pitcher"), c("team"), c(spec.period).alias("last_season"),
        c(spec.exposure).alias("last_ip"), c(spec.count).alias("last_so"), c(spec.rate).alias("last_k9"),
        c("age"), p.alias("projected_so"),
    ).withColumns({
        "range_low": F.greatest(c("projected_so") - half_width, F.lit(0)),
        "range_high": c("projected_so") + half_width,
    })
    return global_rank(out, "projected_so", [spec.entity], name="rank")


def project_absent(panel: DataFrame, absent: DataFrame, score: Callable[[DataFrame], DataFrame],
                   latest: F.Column, spec: PanelSpec = DEFAULT_SPEC, predicted: str = "predicted",
                   max_years_away: int = SUPPLEMENTAL_MAX_YEARS_AWAY,
                   min_exposure: float = MIN_EXPOSURE_SUPPLEMENTAL) -> DataFrame:
    """R2: supplemental projection for entities missing from the latest period.

    Latest row of each absent entity -> years away <= max, exposure >= min ->
    model score -> decay 5%/year (+2% past age 32) -> widening range ->
    confidence, note, unique rank.
    """
    last = latest_row(panel.join(absent, spec.entity, "left_semi"), spec)
    yrs = (latest - c(spec.period)).cast("int")
    last = last.withColumn("years_away", yrs).filter(
        (c("years_away") <= max_years_away) & (c(spec.exposure) >= min_exposure))
    scored = score(last)
    factor = (F.lit(1.0) - F.lit(SUPPLEMENTAL_DECAY_PER_YEAR) * c("years_away")
              - F.when(c("age") > SUPPLEMENTAL_OLD_AGE, F.lit(SUPPLEMENTAL_OLD_PENALTY)).otherwise(F.lit(0.0)))
    width = F.lit(float(RANGE_HALF_WIDTH)) * (F.lit(1.0) + F.lit(SUPPLEMENTAL_WIDTH_PER_YEAR) * c("years_away"))
    adj = c(predicted) * factor
    out = scored.select(
        c(spec.entity), c(spec.name).alias("pitcher"), c("team"), c(spec.period).alias("last_season"),
        c("years_away"), c(spec.exposure).alias("last_ip"), c(spec.count).alias("last_so"),
        c(spec.rate).alias("last_k9"), (c("age") + c("years_away")).alias("age"),
        _half_even_int(c(predicted)).alias("base_projection"),
        _half_even_int(adj).alias("adjusted_so"),
        F.greatest(_half_even_int(adj - width), F.lit(0)).alias("range_low"),
        _half_even_int(adj + width).alias("range_high"),
        F.when(c("years_away") >= 2, F.lit("Low")).otherwise(F.lit("Medium")).alias("confidence"),
        season_note(c(spec.period), c("years_away")).alias("note"),
    )
    return global_rank(out, "adjusted_so", [spec.entity], name="rank")


def tier_counts(projection: DataFrame, column: str = "projected_so", cuts: Sequence[int] = tuple(TIER_CUTS)) -> DataFrame:
    """Rows at or above each cut (cumulative tiers), plus the total."""
    wide = projection.agg(F.count(F.lit(1)).alias("total"),
                          *[F.count(F.when(c(column) >= k, 1)).alias(f"t{k}") for k in cuts])
    rows = [F.struct(F.lit(k).alias("at_least"), c(f"t{k}").alias("n"), c("total").alias("total")) for k in cuts]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def supplemental_counts(supp: DataFrame) -> DataFrame:
    """Counts by years away and by confidence (long: dimension, value, n)."""
    by_years = supp.groupBy(F.lit("years_away").alias("dimension"), c("years_away").cast("string").alias("value")).count()
    by_conf = supp.groupBy(F.lit("confidence").alias("dimension"), c("confidence").alias("value")).count()
    return by_years.unionByName(by_conf).withColumnRenamed("count", "n")


def _factor(i: int) -> F.Column:
    return (F.when(c("missed_previous_season") == 1, F.lit(SCENARIO_FACTORS_MISSED[i]))
            .when(c("injury_risk_score") > 0.6, F.lit(SCENARIO_FACTORS_HIGH[i]))
            .when(c("injury_risk_score") > 0.3, F.lit(SCENARIO_FACTORS_MEDIUM[i]))
            .otherwise(F.lit(SCENARIO_FACTORS_LOW[i])))


SCENARIOS = ("conservative", "moderate", "optimistic")


def scenarios(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Three innings scenarios from availability risk; value = ip / 9 * rate * 0.97.
    One long row per (entity, period, scenario)."""
    rate = c(spec.rate) * F.lit(SCENARIO_RATE_FACTOR)
    rows = [F.struct(F.lit(name).alias("scenario"), (c(spec.exposure) * _factor(i)).alias("ip"))
            for i, name in enumerate(SCENARIOS)]
    keep = [spec.entity, spec.period, "injury_risk_score", "missed_previous_season", spec.rate, spec.exposure]
    if "predicted" in df.columns:
        keep.append("predicted")
    long = df.select(*keep, F.explode(F.array(*rows)).alias("s")).select(*keep, "s.scenario", "s.ip")
    return long.withColumn("strikeouts", c("ip") / 9 * rate)


def pick_scenario(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, predicted: str = "predicted") -> DataFrame:
    """Risk > .5 -> conservative, > .3 -> moderate, else the model value."""
    rate = c(spec.rate) * F.lit(SCENARIO_RATE_FACTOR)
    cons = c(spec.exposure) * _factor(0) / 9 * rate
    mod = c(spec.exposure) * _factor(1) / 9 * rate
    choice = (F.when(c("injury_risk_score") > 0.5, F.lit("conservative"))
              .when(c("injury_risk_score") > 0.3, F.lit("moderate")).otherwise(F.lit("model")))
    value = (F.when(c("injury_risk_score") > 0.5, cons)
             .when(c("injury_risk_score") > 0.3, mod).otherwise(c(predicted)))
    return df.select(spec.entity, spec.period, "injury_risk_score", choice.alias("choice"), value.alias("projection"))


def elite_tier(projection: DataFrame, cut: int = TIER_CUTS[0], column: str = "projected_so") -> DataFrame:
    """The top tier listing."""
    return projection.filter(c(column) >= cut).select("rank", "pitcher", "team", column, "range_low", "range_high")
