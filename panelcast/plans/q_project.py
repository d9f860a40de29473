"""Projection products (R1-R7), scenario selection and the risk top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.models.baseline import fit_line, score_line
from panelcast.operators.composite import injury_features, scalars
from panelcast.operators.filters import with_target
from panelcast.operators.joins import absent_entities
from panelcast.operators.project import (
    elite_tier, pick_scenario, project, project_absent, scenarios, supplemental_counts, tier_counts,
)
from panelcast.operators.rank import top_k
from panelcast.plans import oracle_base as ob
from panelcast.plans.panel import season_panel
from panelcast.plans.q_panel import AVAILABILITY_CTES
from panelcast.plans.registry import query
from panelcast.spec import DEFAULT_SPEC

c = F.col
SPEC = DEFAULT_SPEC
KEY = ["player_id", "season"]
T = SPEC.target
X = "total_strikeouts"


def _latest(panel: DataFrame) -> F.Column:
    return scalars(panel.agg(F.max(SPEC.period).alias("latest")))["latest"]


def _scorer(panel: DataFrame):
    coef = fit_line(with_target(panel), X, T)
    return lambda df: score_line(df, coef, X)


def main_projection_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = season_panel(spark, sf_dir)
    current = panel.filter(c(SPEC.period) == _latest(panel))
    return project(_scorer(panel)(current), SPEC)


def supplemental_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = season_panel(spark, sf_dir)
    latest = _latest(panel)
    absent = absent_entities(panel, SPEC, lookback=3)
    return project_absent(panel, absent, _scorer(panel), latest, SPEC)


def latest_with_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = season_panel(spark, sf_dir)
    risk = injury_features(panel, SPEC)
    return _scorer(panel)(risk.filter(c(SPEC.period) == _latest(panel)))


PROJ_CTES = f"""
coef_all AS (
  SELECT regr_slope({T}, {X}) AS slope, regr_intercept({T}, {X}) AS intercept FROM panel WHERE {T} IS NOT NULL
),
latest AS (SELECT max(season) AS s FROM panel),
proj AS (
  SELECT player_id, full_name AS pitcher, team, season AS last_season, total_innings_pitched AS last_ip,
         {X} AS last_so, k_per_9 AS last_k9, age,
         CAST(round_even((SELECT intercept FROM coef_all) + (SELECT slope FROM coef_all) * {X}, 0) AS INTEGER) AS projected_so
  FROM panel WHERE season = (SELECT s FROM latest)
),
main_proj AS (
  SELECT *, greatest(projected_so - 29, 0) AS range_low, projected_so + 29 AS range_high,
         CAST(row_number() OVER (ORDER BY projected_so DESC, player_id) AS INTEGER) AS rank
  FROM proj
),
absent AS (
  SELECT player_id FROM panel WHERE season < (SELECT s FROM latest) AND season >= (SELECT s FROM latest) - 3
  EXCEPT SELECT player_id FROM panel WHERE season = (SELECT s FROM latest)
),
lastrow AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT p.*, row_number() OVER (PARTITION BY p.player_id ORDER BY p.season DESC) AS rn
    FROM panel p WHERE p.player_id IN (SELECT player_id FROM absent)) WHERE rn = 1
),
supp0 AS (
  SELECT *, CAST((SELECT s FROM latest) - season AS INTEGER) AS years_away,
         (SELECT intercept FROM coef_all) + (SELECT slope FROM coef_all) * {X} AS predicted
  FROM lastrow
),
supp1 AS (
  SELECT *,
         predicted * (1.0::DOUBLE - 0.05::DOUBLE * years_away
                      - CASE WHEN age > 32 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END) AS adj,
         29.0::DOUBLE * (1.0::DOUBLE + 0.2::DOUBLE * years_away) AS width
  FROM supp0 WHERE years_away <= 3 AND total_innings_pitched >= 30
),
supp AS (
  SELECT player_id, full_name AS pitcher, team, season AS last_season, years_away,
         total_innings_pitched AS last_ip, {X} AS last_so, k_per_9 AS last_k9, age + years_away AS age,
         CAST(round_even(predicted, 0) AS INTEGER) AS base_projection,
         CAST(round_even(adj, 0) AS INTEGER) AS adjusted_so,
         greatest(CAST(round_even(adj - width, 0) AS INTEGER), 0) AS range_low,
         CAST(round_even(adj + width, 0) AS INTEGER) AS range_high,
         CASE WHEN years_away >= 2 THEN 'Low' ELSE 'Medium' END AS confidence,
         format('Based on {{}} season, {{}}yr away', season, years_away) AS note
  FROM supp1
),
supp_ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY adjusted_so DESC, player_id) AS INTEGER) AS rank FROM supp
)"""


def pq(select_sql: str, keep: tuple[str, ...] = (), extra: str = "") -> str:
    ctes = PROJ_CTES + ("," + extra if extra else "")
    return ob.panel_query(select_sql, keep=keep, extra_ctes=ctes)


@query("main_projection", "R1 W21 M22 P3 P6 P12 T1", pq("SELECT * FROM main_proj", keep=("pitcher", "team")))
def main_projection_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest-season entities scored by the model fitted on all labelled rows:
    half-even integer projection, +-29 range clipped at 0, unique rank."""
    return main_projection_df(spark, sf_dir)


@query("projection_tiers", "R3", pq(" UNION ALL ".join(
    f"SELECT {k} AS at_least, count(CASE WHEN projected_so >= {k} THEN 1 END) AS n, count(*) AS total FROM main_proj"
    for k in (200, 150, 100))))
def projection_tiers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected rows at or above 200 / 150 / 100."""
    return tier_counts(main_projection_df(spark, sf_dir))


@query("elite_tier", "R7", pq(
    "SELECT rank, pitcher, team, projected_so, range_low, range_high FROM main_proj WHERE projected_so >= 200",
    keep=("pitcher", "team")))
def elite_tier_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200+ tier of the main projection."""
    return elite_tier(main_projection_df(spark, sf_dir))


OWN_CUT = 175


@query("elite_tier_own_cut", "R7", pq(
    f"SELECT rank, pitcher, team, projected_so, range_low, range_high FROM main_proj WHERE projected_so >= {OWN_CUT}",
    keep=("pitcher", "team")))
def elite_tier_own_cut_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier from a cut of one's own up, where the stand-in's partial season reaches no 200."""
    return elite_tier(main_projection_df(spark, sf_dir), OWN_CUT)


@query("supplemental_projection", "R2 J3 W20 P14 W21", pq(
    "SELECT * FROM supp_ranked", keep=("pitcher", "team", "confidence", "note")))
def supplemental_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities absent from the latest season: last row, time-away decay, widening range, confidence, rank."""
    return supplemental_df(spark, sf_dir)


@query("supplemental_counts", "R4", pq("""
SELECT 'years_away' AS dimension, CAST(years_away AS VARCHAR) AS value, count(*) AS n FROM supp GROUP BY years_away
UNION ALL
SELECT 'confidence', confidence, count(*) FROM supp GROUP BY confidence""", keep=("dimension", "value")))
def supplemental_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplemental rows by years away and by confidence."""
    return supplemental_counts(supplemental_df(spark, sf_dir))


_SCEN_BASE = """
scen_base AS (
  SELECT a.player_id, a.season, a.injury_risk_score, a.missed_previous_season, p.k_per_9, p.total_innings_pitched,
         (SELECT intercept FROM coef_all) + (SELECT slope FROM coef_all) * p.total_strikeouts AS predicted
  FROM availability a JOIN panel p ON a.player_id = p.player_id AND a.season = p.season
  WHERE a.season = (SELECT s FROM latest)
)"""


def _factor_sql(i: int) -> str:
    miss, high, med, low = (0.65, 0.75, 0.85), (0.70, 0.80, 0.90), (0.80, 0.90, 0.95), (0.90, 0.95, 1.00)
    return (f"CASE WHEN missed_previous_season = 1 THEN {miss[i]}::DOUBLE WHEN injury_risk_score > 0.6 THEN {high[i]}::DOUBLE "
            f"WHEN injury_risk_score > 0.3 THEN {med[i]}::DOUBLE ELSE {low[i]}::DOUBLE END")


@query("injury_scenarios", "R5 W14-W19", pq(
    " UNION ALL ".join(
        f"SELECT player_id, season, injury_risk_score, missed_previous_season, k_per_9, total_innings_pitched, "
        f"predicted, '{name}' AS scenario, total_innings_pitched * {_factor_sql(i)} AS ip, "
        f"total_innings_pitched * {_factor_sql(i)} / 9 * (k_per_9 * 0.97::DOUBLE) AS strikeouts FROM scen_base"
        for i, name in enumerate(["conservative", "moderate", "optimistic"])),
    keep=("scenario",), extra=AVAILABILITY_CTES + "," + _SCEN_BASE))
def scenarios_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conservative / moderate / optimistic innings and strikeouts from the availability risk, latest season."""
    return scenarios(latest_with_risk(spark, sf_dir), SPEC)


@query("scenario_choice", "R6", pq(f"""
SELECT player_id, season, injury_risk_score,
       CASE WHEN injury_risk_score > 0.5 THEN 'conservative' WHEN injury_risk_score > 0.3 THEN 'moderate' ELSE 'model' END AS choice,
       CASE WHEN injury_risk_score > 0.5 THEN total_innings_pitched * {_factor_sql(0)} / 9 * (k_per_9 * 0.97::DOUBLE)
            WHEN injury_risk_score > 0.3 THEN total_innings_pitched * {_factor_sql(1)} / 9 * (k_per_9 * 0.97::DOUBLE)
            ELSE predicted END AS projection
FROM scen_base""", keep=("choice",), extra=AVAILABILITY_CTES + "," + _SCEN_BASE))
def scenario_choice_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk-based choice between the conservative, moderate scenario and the model value."""
    return pick_scenario(latest_with_risk(spark, sf_dir), SPEC)


_RISK_COLS = ["player_id", "season", "injury_risk_score", "missed_previous_season", "consecutive_active_years",
              "career_availability_rate"]


@query("top_injury_risk", "T2 P3 W19", pq(
    f"SELECT {', '.join(_RISK_COLS)} FROM availability WHERE season >= (SELECT s FROM latest) - 1 "
    "ORDER BY injury_risk_score DESC, player_id, season LIMIT 10", extra=AVAILABILITY_CTES))
def top_risk_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest injury-risk rows over the last two seasons (top-k is the feature)."""
    panel = season_panel(spark, sf_dir)
    risk = injury_features(panel, SPEC).filter(c(SPEC.period) >= _latest(panel) - 1)
    return top_k(risk.select(*_RISK_COLS), "injury_risk_score", 10, ["player_id", "season"])
