"""Join, set-operation and imputation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.features import pitch_mix_features
from panelcast.operators.bitmaps import career_shape
from panelcast.operators.filters import with_target
from panelcast.operators.impute import fill_constants, fill_counts, median_impute, null_profile, typed_impute
from panelcast.operators.joins import absent_entities, left_join_normalized, match_rate, missing_periods
from panelcast.operators.profile import rows_per_period
from panelcast.operators.quantiles import grouped_quantiles
from panelcast.plans import oracle_base as ob
from panelcast.plans.panel import season_panel
from panelcast.plans.registry import query
from panelcast.session import ensure_checkpoint_dir
from panelcast.sources.contract import rename_present
from panelcast.sources.standin import game_log, pitch_share_table
from panelcast.spec import (
    DEFAULT_SPEC, LEAGUE_AVERAGE_FILL, MODEL_FEATURES, PITCH_MIX_FEATURES, PITCH_SHARE_SOURCE, PITCH_SHARES,
)

c = F.col
SPEC = DEFAULT_SPEC
KEY = ["player_id", "season"]
PITCH_COLS = [*PITCH_MIX_FEATURES, *PITCH_SHARES]


def pitch_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-vendor pitch-share table, renamed, with the row-level mix features."""
    side = rename_present(pitch_share_table(spark, sf_dir),
                          {"Name": "full_name", "Season": "season", **PITCH_SHARE_SOURCE})
    return pitch_mix_features(side, PITCH_SHARES)


def pitch_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the panel and the vendor table are built once each: the sketch of the names reads the
    # checkpointed panel, and medians and fills the checkpointed join
    ensure_checkpoint_dir(spark)
    panel = season_panel(spark, sf_dir).select(*KEY, "full_name").checkpoint(eager=True)
    return left_join_normalized(panel, pitch_side(spark, sf_dir), name="full_name", period="season",
                                hot_share=0.01).checkpoint(eager=True)


_SHARE_SQL = ",\n         ".join(
    f"CASE WHEN count(CASE WHEN l.l_linenumber = {k} THEN 1 END) > 0 "
    f"THEN count(CASE WHEN l.l_linenumber = {k} THEN 1 END) / count(*) END AS {name}"
    for k, name in enumerate(PITCH_SHARES, start=1))
_POS = [f"CASE WHEN {s} > 0 THEN {s} END" for s in PITCH_SHARES]
_TOTAL = " + ".join(f"COALESCE({p}, 0.0)" for p in _POS)
_ENTROPY = " - ".join(["0.0"] + [f"COALESCE({p} / tot * log2({p} / tot + 1e-10), 0.0)" for p in _POS])
PITCH_CTES = f"""
side0 AS (
  SELECT ' ' || upper(c.c_name) || '.' AS full_name, CAST(year(l.l_shipdate) AS INTEGER) AS season,
         {_SHARE_SQL}
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  GROUP BY o.o_custkey, c.c_name, year(l.l_shipdate)
),
side AS (
  SELECT *,
         {" + ".join(f"CAST(COALESCE({s} > 0, false) AS INTEGER)" for s in PITCH_SHARES)} AS pitch_diversity,
         CASE WHEN ({" + ".join(f"CAST(COALESCE({s} > 0, false) AS INTEGER)" for s in PITCH_SHARES)}) > 0
              THEN {_ENTROPY} ELSE 0.0 END AS pitch_mix_entropy,
         greatest({", ".join(PITCH_SHARES)}) AS primary_pitch_pct,
         CAST(COALESCE(fb_pct > 0.5, false) AS INTEGER) AS fastball_heavy,
         COALESCE(sl_pct, 0.0) + COALESCE(cb_pct, 0.0) AS breaking_ball_pct
  FROM (SELECT *, {_TOTAL} AS tot FROM side0)
),
joined AS (
  SELECT p.player_id, p.season, p.full_name, {", ".join(f"s.{x}" for x in PITCH_COLS)}
  FROM panel p LEFT JOIN side s
    ON trim(replace(replace(lower(strip_accents(p.full_name)), '.', ''), '''', ''))
     = trim(replace(replace(lower(strip_accents(s.full_name)), '.', ''), '''', ''))
   AND p.season = s.season
)"""


@query("pitch_mix_join", "J1 F30-F35 P18",
       ob.panel_query(
           "SELECT player_id, season, full_name, "
           + ", ".join(f"COALESCE({x}, (SELECT quantile_cont({x}, 0.5) FROM joined)) AS {x}" for x in PITCH_COLS)
           + " FROM joined", keep=("full_name",), extra_ctes=PITCH_CTES))
def pitch_mix_join_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch-mix features on the vendor table, left-joined on (normalised name, season),
    unmatched values filled with the column median."""
    return median_impute(pitch_joined(spark, sf_dir), PITCH_COLS)


@query("pitch_fill_counts", "P18",
       ob.panel_query(
           " UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) - count({x}) AS filled, "
                              f"CAST(quantile_cont({x}, 0.5) AS DOUBLE) AS fill_value FROM joined" for x in PITCH_COLS),
           keep=("column_name",), extra_ctes=PITCH_CTES))
def pitch_fill_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each pitch-mix column ``pitch_mix_join`` fills, and with what."""
    return fill_counts(pitch_joined(spark, sf_dir), PITCH_COLS)


@query("pitch_match_rate", "J2",
       ob.panel_query(
           "SELECT count(CASE WHEN COALESCE(" + ", ".join(f"CAST({x} AS DOUBLE)" for x in PITCH_COLS)
           + ") IS NOT NULL THEN 1 END) AS matched, count(*) AS total, "
           "count(CASE WHEN COALESCE(" + ", ".join(f"CAST({x} AS DOUBLE)" for x in PITCH_COLS)
           + ") IS NOT NULL THEN 1 END) * 100.0 / count(*) AS match_pct FROM joined",
           extra_ctes=PITCH_CTES))
def pitch_match_rate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of panel rows that found a vendor row."""
    return match_rate(pitch_joined(spark, sf_dir), PITCH_COLS)


@query("null_profile", "P15",
       ob.panel_query(
           "SELECT * FROM (" + " UNION ALL ".join(
               f"SELECT '{x}' AS column_name, count(*) - count({x}) AS null_count FROM joined"
               for x in [*KEY, "full_name", *PITCH_COLS]) + ") WHERE null_count > 0",
           keep=("column_name",), extra_ctes=PITCH_CTES))
def null_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL count per column of the joined table (only columns with NULLs), one pass."""
    return null_profile(pitch_joined(spark, sf_dir))


_EXT_NUMERIC = [x for x in MODEL_FEATURES] + ["total_pitches", "games_started"]
_ZERO = [x for x in _EXT_NUMERIC if "pct" in x.lower() or "%" in x]
_MED = [x for x in _EXT_NUMERIC if x not in _ZERO]


@query("typed_impute", "P16 P17 P19",
       ob.panel_query(
           "SELECT player_id, season, "
           + ", ".join([f"COALESCE({x}, 0) AS {x}" for x in _ZERO]
                       + [f"COALESCE({x}, (SELECT quantile_cont({x}, 0.5) FROM filled)) AS {x}" for x in _MED])
           + " FROM filled",
           variant="extended",
           extra_ctes="filled AS (SELECT * REPLACE (COALESCE(stuff_plus, 100.0) AS stuff_plus, "
                      "COALESCE(command_plus, 100.0) AS command_plus) FROM panel "
                      "WHERE next_season_strikeouts IS NOT NULL)"))
def typed_impute_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended panel cleaning: ratings to 100, then per numeric column 0 for
    percentage columns and the exact median otherwise."""
    panel = fill_constants(with_target(season_panel(spark, sf_dir, variant="extended")), LEAGUE_AVERAGE_FILL)
    out = typed_impute(panel.select(*KEY, *_EXT_NUMERIC), exclude=KEY)
    return out.select(*KEY, *_ZERO, *_MED)


@query("absent_entities", "J3 A4",
       ob.panel_query("""
SELECT player_id FROM panel
WHERE season < (SELECT max(season) FROM panel) AND season >= (SELECT max(season) FROM panel) - 3
EXCEPT
SELECT player_id FROM panel WHERE season = (SELECT max(season) FROM panel)"""))
def absent_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities seen in the three seasons before the latest but not in the latest."""
    return absent_entities(season_panel(spark, sf_dir), SPEC, lookback=3)


@query("season_counts", "A5 P3",
       ob.panel_query("SELECT season, count(*) AS n FROM panel GROUP BY season"))
def season_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per season."""
    return rows_per_period(season_panel(spark, sf_dir), SPEC)


@query("game_log_coverage", "S8 J4",
       ob.panel_query("""
SELECT g.season, g.n_games,
       CAST(g.season IN (SELECT DISTINCT season FROM panel) AS INTEGER) AS in_model
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS season, count(*) AS n_games FROM lineitem GROUP BY 1) g"""))
def game_log_coverage_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game-log rows per season, flagged by whether the season is in the model panel."""
    logs = game_log(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("n_games"))
    in_panel = season_panel(spark, sf_dir).select("season").distinct().withColumn("_in", F.lit(1))
    return logs.join(in_panel, "season", "left").select(
        "season", "n_games", F.coalesce("_in", F.lit(0)).alias("in_model"))


@query("missing_log_seasons", "J4",
       ob.panel_query("""
SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS season FROM lineitem
EXCEPT SELECT season FROM panel"""))
def missing_log_seasons_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of the game log that the panel does not hold."""
    return missing_periods(game_log(spark, sf_dir), season_panel(spark, sf_dir), "season")


@query("career_shape", "A13 J3 W14-W17",
       ob.panel_query("""
SELECT player_id, min(a) AS first, max(z) AS last, CAST(sum(n) AS BIGINT) AS n_periods,
       CAST(max(z) - min(a) + 1 - sum(n) AS BIGINT) AS missing, arg_max(n, z) AS current_run, max(n) AS longest_run
FROM (SELECT player_id, count(*) AS n, CAST(min(season) AS BIGINT) AS a, CAST(max(season) AS BIGINT) AS z
      FROM (SELECT player_id, season, season - row_number() OVER (PARTITION BY player_id ORDER BY season) AS island FROM panel)
      GROUP BY player_id, island)
GROUP BY player_id"""))
def career_shape_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, gaps and streaks of every career, from bitmaps."""
    return career_shape(season_panel(spark, sf_dir), SPEC)


@query("season_quantiles", "A16 P17",
       ob.panel_query("""
SELECT season, quantile_cont(total_strikeouts::DOUBLE, 0.1) AS p10, quantile_cont(total_strikeouts::DOUBLE, 0.5) AS p50,
       quantile_cont(total_strikeouts::DOUBLE, 0.9) AS p90 FROM panel GROUP BY season"""))
def season_quantiles_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact strikeout quantiles per season."""
    return grouped_quantiles(season_panel(spark, sf_dir), ["season"], "total_strikeouts", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
