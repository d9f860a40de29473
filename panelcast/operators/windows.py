"""Career window operators.

All windows are partitioned by the entity and ordered by the period, so the
whole block shares one hash exchange and one sort; entity careers are short
(tens of periods), so a hot entity cannot overload a task the way a hot join
key can.  Global statistics (W12, W19) live in ``composite.py`` and are never
computed with an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.exprs import flag, safe_div
from panelcast.spec import DEFAULT_SPEC, DELTA_COLUMNS, LAG_COLUMNS, NEVER_GAPPED, PanelSpec

c = F.col


def career_window(spec: PanelSpec = DEFAULT_SPEC) -> WindowSpec:
    return Window.partitionBy(spec.entity).orderBy(spec.period, *spec.tie)


def running(spec: PanelSpec = DEFAULT_SPEC) -> WindowSpec:
    return career_window(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(spec: PanelSpec = DEFAULT_SPEC, rows: int = 3) -> WindowSpec:
    return career_window(spec).rowsBetween(-(rows - 1), Window.currentRow)


# -- W1 ---------------------------------------------------------------------

def next_period_target(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, strict: bool = False,
                       source: str | None = None, name: str | None = None) -> DataFrame:
    """Value of ``source`` in the entity's next observed period.

    ``strict=True`` keeps it only when that period is exactly period + 1
    (a gap year then yields NULL instead of counting as "next").
    """
    w = career_window(spec)
    src = source or spec.count
    nxt = F.lead(c(src), 1).over(w).cast("double")
    if strict:
        nxt = F.when(F.lead(c(spec.period), 1).over(w) == c(spec.period) + 1, nxt)
    return df.withColumn(name or spec.target, nxt)


# -- W2-W11, W13 ------------------------------------------------------------

def lag_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC,
                 columns: dict[str, str] = LAG_COLUMNS) -> DataFrame:
    w = career_window(spec)
    return df.withColumns({prev: F.lag(c(src), 1).over(w) for src, prev in columns.items()})


def delta_features(df: DataFrame, deltas: dict[str, tuple[str, str]] = DELTA_COLUMNS) -> DataFrame:
    return df.withColumns({d: c(cur) - c(prev) for d, (cur, prev) in deltas.items()})


def _running_max(x: str, spec: PanelSpec) -> Column:
    # A missing value on the row itself gives a missing running max (cummax semantics).
    return F.when(c(x).isNotNull(), F.max(c(x)).over(running(spec)))


def career_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Deltas, change flags, health flags, career highs, experience, rolling stats.

    Flags are evaluated on unfilled values (a first season has no delta and
    every flag 0); ``first_period_fills`` runs afterwards.
    """
    df = delta_features(lag_features(df, spec))
    k = spec.count
    df = df.withColumns({
        "pct_change_k": safe_div(c(k) - c("prev_total_k"), c("prev_total_k")) * 100,
        "is_improving": flag(c("delta_k9") > 0.5),
        "is_declining": flag(c("delta_k9") < -0.5),
        "is_breakout": flag(c("delta_k9") > 1.5),
        "is_collapse": flag(c("delta_k9") < -1.5),
        "stuff_improving": flag(c("delta_stuff") > 5),
        "command_improving": flag(c("delta_command") > 5),
        "workload_increasing": flag(c("delta_ip") > 30),
        "workload_decreasing": flag(c("delta_ip") < -30),
        "missed_time_last_year": flag(c("prev_ip") < 100),
        "coming_off_injury": flag((c("prev_ip") > 0) & (c("prev_ip") < 80)),
        "career_high_k": _running_max(k, spec),
        "career_high_k9": _running_max(spec.rate, spec),
        "years_experience": F.row_number().over(career_window(spec)),
        "k9_rolling_std": F.stddev_samp(c(spec.rate)).over(trailing(spec, 3)),
        "k9_3yr_avg": F.avg(c(spec.rate)).over(trailing(spec, 3)),
        "swstr_3yr_avg": F.avg(c("swstr_pct")).over(trailing(spec, 3)),
    })
    return df.withColumns({
        "has_hit_200k": flag(c("career_high_k") >= 200),
        "has_hit_11k9": flag(c("career_high_k9") >= 11.0),
        "is_rookie_level": flag(c("years_experience") <= 2),
        "is_established": flag(c("years_experience") >= 5),
        "is_volatile": flag(c("k9_rolling_std") > 1.5),
    })


def first_period_fills(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Fill rules for a first period (no previous row).

    Deltas, percent change and the momentum score become 0; rolling stats
    fall back to the current value; of the lag columns only the two rating
    lags fall back to the current rating, the other seven stay NULL (the
    source's name rewriting finds no current column for them).
    """
    fills = {d: F.coalesce(c(d), F.lit(0.0)) for d in DELTA_COLUMNS}
    fills["pct_change_k"] = F.coalesce(c("pct_change_k"), F.lit(0.0))
    if "momentum_score" in df.columns:
        fills["momentum_score"] = F.coalesce(c("momentum_score"), F.lit(0.0))
    fills["k9_rolling_std"] = F.coalesce(c("k9_rolling_std"), c(spec.rate))
    fills["k9_3yr_avg"] = F.coalesce(c("k9_3yr_avg"), c(spec.rate))
    fills["swstr_3yr_avg"] = F.coalesce(c("swstr_3yr_avg"), c("swstr_pct"))
    fills["prev_stuff"] = F.coalesce(c("prev_stuff"), c("stuff_plus"))
    fills["prev_command"] = F.coalesce(c("prev_command"), c("command_plus"))
    return df.withColumns(fills)


# -- W14-W18 ----------------------------------------------------------------

def availability_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Gap and streak measures per career, as gaps-and-islands windows.

    * missed_previous_season / coming_back_from_injury: period - previous > 1
    * consecutive_active_years: length of the current unbroken run
    * years_since_injury: period - (period before the latest break) - 1, else 99
    * career_availability_rate: periods so far / (period - first + 1)
    * ip_volatility: expanding population std of exposure from the 3rd period
    """
    w = career_window(spec)
    p = c(spec.period)
    prev = F.lag(p, 1).over(w)
    df = df.withColumns({
        "_prev_period": prev,
        "_rn": F.row_number().over(w),
        "_first_period": F.min(p).over(running(spec)),
        "_ip_std": F.stddev_pop(c(spec.exposure)).over(running(spec)),
    })
    brk = c("_prev_period").isNotNull() & ((p - c("_prev_period")) != 1)
    df = df.withColumns({
        "_run_start": F.max(F.when(c("_prev_period").isNull() | brk, c("_rn"))).over(running(spec)),
        "_last_break_prev": F.max(F.when(brk, c("_prev_period"))).over(running(spec)),
    })
    span = p - c("_first_period")
    missed = flag((p - c("_prev_period")) > 1)
    df = df.withColumns({
        "missed_previous_season": missed,
        "consecutive_active_years": (c("_rn") - c("_run_start") + 1).cast("int"),
        "years_since_injury": F.coalesce((p - c("_last_break_prev") - 1).cast("int"), F.lit(NEVER_GAPPED)),
        "career_availability_rate": F.when(span > 0, c("_rn") / (span + 1)).otherwise(F.lit(1.0)),
        "ip_volatility": F.when(c("_rn") >= 3, c("_ip_std")).otherwise(F.lit(0.0)),
        "coming_back_from_injury": missed,
    })
    return df.drop("_prev_period", "_rn", "_first_period", "_ip_std", "_run_start", "_last_break_prev")


# -- W20 --------------------------------------------------------------------

def latest_row(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Latest row per entity: the row that no other follows in the career window, so that
    a panel whose target was derived is neither shuffled nor sorted again."""
    follows = F.lead(F.lit(1), 1).over(career_window(spec))
    return df.withColumn("_follows", follows).filter(c("_follows").isNull()).drop("_follows")
