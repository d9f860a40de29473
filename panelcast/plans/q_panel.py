"""Panel and career-window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.composite import injury_features, momentum_features
from panelcast.operators.filters import drop_incomplete, find_entity, periods
from panelcast.operators.windows import latest_row, next_period_target
from panelcast.plans import oracle_base as ob
from panelcast.plans.panel import season_panel
from panelcast.plans.registry import query
from panelcast.spec import AVAILABILITY_FEATURES, DEFAULT_SPEC, LAG_COLUMNS, MOMENTUM_FEATURES

c = F.col
SPEC = DEFAULT_SPEC
KEY = ["player_id", "season"]


@query("season_panel", "S3 P1 P2 P4 P7 P16 F1-F29 W1",
       ob.panel_query("SELECT * FROM panel", keep=("full_name", "team")))
def season_panel_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-ready season panel: renamed, exposure-filtered, filled, 29 scalar features, next-season target."""
    return season_panel(spark, sf_dir)


@query("season_panel_extended", "S3 P1 P2 P7 F1-F29(extended variant) W1",
       ob.panel_query("SELECT * FROM panel", keep=("full_name", "team"), variant="extended"))
def season_panel_extended_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived multi-season generation: exposure >= 20, no rating fill, the extended formulas."""
    return season_panel(spark, sf_dir, variant="extended")


@query("next_season_target", "W1 (observed and strict) P4",
       ob.panel_query("""
SELECT player_id, season, total_strikeouts, next_season_strikeouts,
       CASE WHEN lead(season) OVER (PARTITION BY player_id ORDER BY season) = season + 1
            THEN next_season_strikeouts END AS next_season_strikeouts_strict
FROM panel"""))
def next_target_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next observed season's value vs. strictly the following calendar season."""
    panel = season_panel(spark, sf_dir)
    strict = next_period_target(panel, SPEC, strict=True, name="next_season_strikeouts_strict")
    return strict.select(*KEY, "total_strikeouts", "next_season_strikeouts", "next_season_strikeouts_strict")


_LAGS = ",\n    ".join(f"lag({src}) OVER w AS {dst}" for src, dst in LAG_COLUMNS.items())
_MOM_COLS = ", ".join(["player_id", "season", *LAG_COLUMNS.values(), *MOMENTUM_FEATURES])
MOMENTUM_CTES = f"""
mom0 AS (
  SELECT *,
    {_LAGS},
    CASE WHEN total_strikeouts IS NOT NULL THEN max(total_strikeouts) OVER wr END AS career_high_k,
    CASE WHEN k_per_9 IS NOT NULL THEN max(k_per_9) OVER wr END AS career_high_k9,
    CAST(row_number() OVER w AS INTEGER) AS years_experience,
    stddev_samp(k_per_9) OVER w3 AS k9_rolling_std,
    avg(k_per_9) OVER w3 AS k9_3yr_avg,
    avg(swstr_pct) OVER w3 AS swstr_3yr_avg
  FROM panel
  WINDOW w AS (PARTITION BY player_id ORDER BY season),
         wr AS (PARTITION BY player_id ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w3 AS (PARTITION BY player_id ORDER BY season ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
),
mom1 AS (
  SELECT *,
    k_per_9 - prev_k9 AS delta_k9, swstr_pct - prev_swstr AS delta_swstr,
    total_innings_pitched - prev_ip AS delta_ip, season_era - prev_era AS delta_era,
    xfip - prev_xfip AS delta_xfip, siera - prev_siera AS delta_siera,
    stuff_plus - prev_stuff AS delta_stuff, command_plus - prev_command AS delta_command,
    (total_strikeouts - prev_total_k) / NULLIF(prev_total_k, 0) * 100 AS pct_change_k
  FROM mom0
),
mom_sd AS (
  SELECT stddev_samp(delta_k9) AS sd_k9, stddev_samp(delta_swstr) AS sd_swstr,
         stddev_samp(delta_stuff) AS sd_stuff, stddev_samp(delta_era) AS sd_era
  FROM mom1
),
mom2 AS (
  SELECT *,
    CAST(COALESCE(delta_k9 > 0.5, false) AS INTEGER) AS is_improving,
    CAST(COALESCE(delta_k9 < -0.5, false) AS INTEGER) AS is_declining,
    CAST(COALESCE(delta_k9 > 1.5, false) AS INTEGER) AS is_breakout,
    CAST(COALESCE(delta_k9 < -1.5, false) AS INTEGER) AS is_collapse,
    CAST(COALESCE(delta_stuff > 5, false) AS INTEGER) AS stuff_improving,
    CAST(COALESCE(delta_command > 5, false) AS INTEGER) AS command_improving,
    CAST(COALESCE(delta_ip > 30, false) AS INTEGER) AS workload_increasing,
    CAST(COALESCE(delta_ip < -30, false) AS INTEGER) AS workload_decreasing,
    CAST(COALESCE(prev_ip < 100, false) AS INTEGER) AS missed_time_last_year,
    CAST(COALESCE(prev_ip > 0 AND prev_ip < 80, false) AS INTEGER) AS coming_off_injury,
    CAST(COALESCE(career_high_k >= 200, false) AS INTEGER) AS has_hit_200k,
    CAST(COALESCE(career_high_k9 >= 11.0, false) AS INTEGER) AS has_hit_11k9,
    CAST(COALESCE(years_experience <= 2, false) AS INTEGER) AS is_rookie_level,
    CAST(COALESCE(years_experience >= 5, false) AS INTEGER) AS is_established,
    CAST(COALESCE(k9_rolling_std > 1.5, false) AS INTEGER) AS is_volatile,
    delta_k9 / NULLIF((SELECT sd_k9 FROM mom_sd), 0) * 0.4
      + delta_swstr / NULLIF((SELECT sd_swstr FROM mom_sd), 0) * 0.3
      + delta_stuff / NULLIF((SELECT sd_stuff FROM mom_sd), 0) * 0.2
      + delta_era / NULLIF((SELECT sd_era FROM mom_sd), 0) * (-0.1) AS momentum_raw
  FROM mom1
),
momentum AS (
  SELECT * REPLACE (
      COALESCE(delta_k9, 0.0) AS delta_k9, COALESCE(delta_swstr, 0.0) AS delta_swstr,
      COALESCE(delta_ip, 0.0) AS delta_ip, COALESCE(delta_era, 0.0) AS delta_era,
      COALESCE(delta_xfip, 0.0) AS delta_xfip, COALESCE(delta_siera, 0.0) AS delta_siera,
      COALESCE(delta_stuff, 0.0) AS delta_stuff, COALESCE(delta_command, 0.0) AS delta_command,
      COALESCE(pct_change_k, 0.0) AS pct_change_k,
      COALESCE(k9_rolling_std, k_per_9) AS k9_rolling_std,
      COALESCE(k9_3yr_avg, k_per_9) AS k9_3yr_avg,
      COALESCE(swstr_3yr_avg, swstr_pct) AS swstr_3yr_avg,
      COALESCE(prev_stuff, stuff_plus) AS prev_stuff,
      COALESCE(prev_command, command_plus) AS prev_command),
    COALESCE(momentum_raw, 0.0) AS momentum_score
  FROM mom2
)"""


@query("momentum_features", "W2-W13 P20",
       ob.panel_query(f"SELECT {_MOM_COLS} FROM momentum", extra_ctes=MOMENTUM_CTES))
def momentum_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-over-year block: lags, deltas, change/health flags, career highs,
    experience, rolling std/means, globally standardised momentum score, first-season fills."""
    out = momentum_features(season_panel(spark, sf_dir), SPEC)
    return out.select(*KEY, *LAG_COLUMNS.values(), *MOMENTUM_FEATURES)


AVAILABILITY_CTES = """
av0 AS (
  SELECT player_id, season, total_innings_pitched,
         lag(season) OVER w AS prev_season,
         row_number() OVER w AS rn,
         min(season) OVER wr AS first_season,
         stddev_pop(total_innings_pitched) OVER wr AS ip_std
  FROM panel
  WINDOW w AS (PARTITION BY player_id ORDER BY season),
         wr AS (PARTITION BY player_id ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
av1 AS (
  SELECT *, prev_season IS NOT NULL AND season - prev_season <> 1 AS brk FROM av0
),
av2 AS (
  SELECT *,
         max(CASE WHEN prev_season IS NULL OR brk THEN rn END) OVER wr AS run_start,
         max(CASE WHEN brk THEN prev_season END) OVER wr AS last_break_prev
  FROM av1
  WINDOW wr AS (PARTITION BY player_id ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
av3 AS (
  SELECT player_id, season, total_innings_pitched,
         CAST(COALESCE(season - prev_season > 1, false) AS INTEGER) AS missed_previous_season,
         CAST(rn - run_start + 1 AS INTEGER) AS consecutive_active_years,
         COALESCE(CAST(season - last_break_prev - 1 AS INTEGER), 99) AS years_since_injury,
         CASE WHEN season - first_season > 0 THEN rn / (season - first_season + 1) ELSE 1.0 END AS career_availability_rate,
         CASE WHEN rn >= 3 THEN ip_std ELSE 0.0 END AS ip_volatility,
         CAST(COALESCE(season - prev_season > 1, false) AS INTEGER) AS coming_back_from_injury
  FROM av2
),
availability AS (
  SELECT *,
         0.35::DOUBLE * missed_previous_season
         + 0.20::DOUBLE * (1 - consecutive_active_years / (SELECT max(consecutive_active_years) FROM av3))
         + 0.25::DOUBLE * (least(greatest(5 - years_since_injury, 0), 5) / 5)
         + 0.15::DOUBLE * (1 - career_availability_rate)
         + 0.05::DOUBLE * (CASE WHEN (SELECT max(ip_volatility) FROM av3) > 0
                           THEN ip_volatility / (SELECT max(ip_volatility) FROM av3) ELSE 0.0 END)
           AS injury_risk_score
  FROM av3
)"""


@query("availability_features", "W14-W19 P13",
       ob.panel_query(f"SELECT player_id, season, {', '.join(AVAILABILITY_FEATURES)} FROM availability",
                      extra_ctes=AVAILABILITY_CTES))
def availability_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap flags, current streak, years since the last gap, availability rate,
    expanding IP volatility and the composite injury-risk score."""
    out = injury_features(season_panel(spark, sf_dir), SPEC)
    return out.select(*KEY, *AVAILABILITY_FEATURES)


@query("latest_season_row", "W20",
       ob.panel_query("""
SELECT player_id, season, full_name, total_strikeouts, total_innings_pitched, k_per_9, age
FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS rn FROM panel)
WHERE rn = 1""", keep=("full_name",)))
def latest_row_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most recent season of every entity, via one max-of-struct aggregation."""
    panel = season_panel(spark, sf_dir).select(
        *KEY, "full_name", "total_strikeouts", "total_innings_pitched", "k_per_9", "age")
    return latest_row(panel, SPEC)


@query("find_entity", "P9",
       ob.panel_query("""
SELECT player_id, season, full_name, total_strikeouts FROM panel
WHERE COALESCE(contains(lower(full_name), lower('customer#0000001')), false)""", keep=("full_name",)))
def find_entity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive name search over the whole panel."""
    return find_entity(season_panel(spark, sf_dir), "CUSTOMER#0000001", SPEC).select(
        *KEY, "full_name", "total_strikeouts")


@query("entity_season_lookup", "P10 P3",
       ob.panel_query("""
SELECT p.player_id, p.season, p.total_strikeouts, p.next_season_strikeouts
FROM panel p SEMI JOIN (
  SELECT player_id, season FROM panel WHERE season = (SELECT max(season) - 1 FROM panel)
) k ON p.player_id = k.player_id AND p.season = k.season"""))
def lookup_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of point lookups: one (entity, season) key per entity of the
    second-latest season, resolved with a semi-join instead of one filter per key."""
    panel = season_panel(spark, sf_dir)
    prev = panel.agg((F.max("season") - 1).alias("s")).select("s").scalar()
    keys = periods(panel, SPEC, equal=prev).select(*KEY)
    return panel.join(keys, KEY, "left_semi").select(*KEY, "total_strikeouts", "next_season_strikeouts")


@query("complete_rows", "P5 P19",
       ob.panel_query("""
SELECT player_id, season, k_bb_ratio, consistency_score, k_to_contact_ratio FROM panel
WHERE k_bb_ratio IS NOT NULL AND consistency_score IS NOT NULL AND k_to_contact_ratio IS NOT NULL"""))
def complete_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with no NULL in the columns that can have zero denominators."""
    cols = ["k_bb_ratio", "consistency_score", "k_to_contact_ratio"]
    return drop_incomplete(season_panel(spark, sf_dir), cols).select(*KEY, *cols)
