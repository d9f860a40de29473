"""Profiling queries (A1-A14, A17) and the deterministic split (M1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.models.split import hash_split
from panelcast.operators.composite import momentum_features
from panelcast.operators.filters import with_target
from panelcast.operators.profile import (
    correlated_pairs, dataset_size, describe, flag_group_stats, flag_share, group_mean, group_peak, histogram,
    periods_per_entity, quadratic_trend, split_stats, target_correlation,
)
from panelcast.plans import oracle_base as ob
from panelcast.plans.panel import season_panel
from panelcast.plans.q_panel import MOMENTUM_CTES
from panelcast.plans.registry import query
from panelcast.spec import DEFAULT_SPEC, MODEL_FEATURES

c = F.col
SPEC = DEFAULT_SPEC
KEY = ["player_id", "season"]
TARGET = SPEC.target

SPLIT_SQL = ("CASE WHEN ('0x' || substr(md5(CAST(player_id AS VARCHAR) || '|' || CAST(season AS VARCHAR)), 1, 8))"
             "::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END")


@query("aging_curve", "A1", ob.panel_query(
    "SELECT age, avg(k_per_9) AS mean_k_per_9, count(*) AS n FROM panel GROUP BY age"))
def aging_curve_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean K/9 per age."""
    return group_mean(season_panel(spark, sf_dir), "age", "k_per_9")


@query("aging_peak", "A2", ob.panel_query("""
SELECT arg_max(age, struct_pack(m := mean_k_per_9, a := -age)) AS peak_age, max(mean_k_per_9) AS peak_mean_k_per_9
FROM (SELECT age, avg(k_per_9) AS mean_k_per_9 FROM panel GROUP BY age)"""))
def aging_peak_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age with the highest mean K/9 and that mean."""
    return group_peak(season_panel(spark, sf_dir), "age", "k_per_9")


_FLAGS = ["is_young", "is_prime_age", "is_veteran"]


@query("age_group_means", "A3", ob.panel_query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS \"group\", count(CASE WHEN {f} = 1 THEN 1 END) AS n, "
        f"avg(CASE WHEN {f} = 1 THEN total_strikeouts END) AS mean_total_strikeouts, "
        f"avg(CASE WHEN {f} = 1 THEN k_per_9 END) AS mean_k_per_9 FROM panel" for f in _FLAGS),
    keep=('"group"',)))
def age_group_means_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strikeouts and K/9 for the overlapping young / prime / veteran groups."""
    return flag_group_stats(season_panel(spark, sf_dir), _FLAGS, ["total_strikeouts", "k_per_9"])


@query("dataset_size", "A4 A6 A15", ob.panel_query("""
SELECT count(*) AS total_rows, count(next_season_strikeouts) AS with_target,
       count(*) - count(next_season_strikeouts) AS without_target,
       count(DISTINCT player_id) AS distinct_entities, min(season) AS first_period, max(season) AS last_period
FROM panel"""))
def dataset_size_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with/without target, distinct entities, first and last season."""
    return dataset_size(season_panel(spark, sf_dir), SPEC)


_DESCRIBE = ["total_strikeouts", "k_per_9", "total_innings_pitched", "age", TARGET]


@query("describe_columns", "A7 A16", ob.panel_query(
    " UNION ALL ".join(
        f"SELECT '{x}' AS column_name, count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, "
        f"CAST(min({x}) AS DOUBLE) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, "
        f"quantile_cont({x}, 0.75) AS q75, CAST(max({x}) AS DOUBLE) AS max FROM panel" for x in _DESCRIBE),
    keep=("column_name",)))
def describe_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count / mean / std / min / exact quartiles / max of key columns."""
    return describe(season_panel(spark, sf_dir), _DESCRIBE)


_MOM_FLAGS = ["is_improving", "is_declining", "is_breakout", "is_collapse", "has_hit_200k", "coming_off_injury"]


@query("momentum_flag_shares", "A8 W5", ob.panel_query(
    " UNION ALL ".join(f"SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS n, avg({f}) * 100 AS pct FROM momentum"
                       for f in _MOM_FLAGS), keep=("flag",), extra_ctes=MOMENTUM_CTES))
def flag_shares_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and share of rows per momentum flag."""
    return flag_share(momentum_features(season_panel(spark, sf_dir), SPEC), _MOM_FLAGS)


def _nan_null(expr: str) -> str:
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END"


@query("target_correlation", "A9", ob.panel_query(
    "SELECT feature, r, abs(r) AS abs_r FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {_nan_null(f'corr(CAST({f} AS DOUBLE), {TARGET})')} AS r FROM panel "
        f"WHERE {TARGET} IS NOT NULL" for f in MODEL_FEATURES) + ")", keep=("feature",)))
def target_correlation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson r of each of the 58 model features with the next-season target."""
    return target_correlation(with_target(season_panel(spark, sf_dir)), MODEL_FEATURES, TARGET)


_PAIRS = [(a, b) for i, a in enumerate(MODEL_FEATURES) for b in MODEL_FEATURES[i + 1:]]


@query("correlated_pairs", "A10", ob.panel_query(
    "SELECT split_part(pair, '|', 1) AS feature_a, split_part(pair, '|', 2) AS feature_b, r FROM ("
    "UNPIVOT (SELECT " + ", ".join(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS "{a}|{b}"' for a, b in _PAIRS)
    + " FROM panel) ON COLUMNS(*) INTO NAME pair VALUE r) WHERE abs(r) > 0.9 AND NOT isnan(r)",
    keep=("feature_a", "feature_b")))
def correlated_pairs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature pairs with |r| > 0.9 among the 58 model features (1,653 pairs, one scan)."""
    return correlated_pairs(season_panel(spark, sf_dir), MODEL_FEATURES, 0.9)


def _d3(a11, a12, a13, a21, a22, a23, a31, a32, a33) -> str:
    return (f"({a11} * ({a22} * {a33} - {a23} * {a32}) - {a12} * ({a21} * {a33} - {a23} * {a31})"
            f" + {a13} * ({a21} * {a32} - {a22} * {a31}))")


_DET = _d3("s4", "s3", "s2", "s3", "s2", "s1", "s2", "s1", "s0")
_MEAN_AGE = f"(SELECT avg(CAST(age AS DOUBLE)) FROM panel WHERE {TARGET} IS NOT NULL)"


@query("aging_trend", "A12", ob.panel_query(f"""
SELECT a AS coef_x2, b - 2 * a * mx AS coef_x, a * (mx * mx) - b * mx + cc AS intercept FROM (
  SELECT {_d3("t2", "s3", "s2", "t1", "s2", "s1", "t0", "s1", "s0")} / {_DET} AS a,
         {_d3("s4", "t2", "s2", "s3", "t1", "s1", "s2", "t0", "s0")} / {_DET} AS b,
         {_d3("s4", "s3", "t2", "s3", "s2", "t1", "s2", "s1", "t0")} / {_DET} AS cc,
         {_MEAN_AGE} AS mx
  FROM (SELECT CAST(count(*) AS DOUBLE) AS s0, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3,
               sum(u * u * u * u) AS s4, sum(y) AS t0, sum(u * y) AS t1, sum(u * u * y) AS t2
        FROM (SELECT CAST(age AS DOUBLE) - {_MEAN_AGE} AS u, {TARGET} AS y
              FROM panel WHERE {TARGET} IS NOT NULL)))"""))
def aging_trend_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic least-squares trend of next-season strikeouts on age."""
    return quadratic_trend(with_target(season_panel(spark, sf_dir)), "age", TARGET)


@query("seasons_per_entity", "A13", ob.panel_query(
    "SELECT player_id, CAST(count(DISTINCT season) AS INTEGER) AS n_periods, "
    "array_to_string(list_sort(list(DISTINCT season)), ',') AS periods FROM panel GROUP BY player_id",
    keep=("periods",)))
def seasons_per_entity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted list of seasons per entity."""
    return periods_per_entity(season_panel(spark, sf_dir), SPEC)


@query("target_histogram", "A14", ob.panel_query(f"""
SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS n FROM (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({TARGET} - lo) / w), 29) END AS INTEGER) AS bin, lo, w
  FROM panel, (SELECT min({TARGET}) AS lo, max({TARGET}) AS hi, (max({TARGET}) - min({TARGET})) / 30 AS w FROM panel)
  WHERE {TARGET} IS NOT NULL)
GROUP BY bin, lo, w"""))
def histogram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 equal-width bins of the next-season target."""
    return histogram(season_panel(spark, sf_dir), TARGET, 30)


@query("hash_split", "M1", ob.panel_query(f"SELECT player_id, season, {SPLIT_SQL} AS split FROM panel",
                                         keep=("split",)))
def hash_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic 80/20 split of (entity, season) rows from an md5 bucket."""
    return hash_split(season_panel(spark, sf_dir), SPEC).select(*KEY, "split")


@query("split_target_stats", "A17 M1", ob.panel_query(
    f"SELECT split, count({TARGET}) AS n, avg({TARGET}) AS mean_target, stddev_samp({TARGET}) AS std_target "
    f"FROM (SELECT *, {SPLIT_SQL} AS split FROM panel) GROUP BY split", keep=("split",)))
def split_stats_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target count / mean / std on each side of the split."""
    return split_stats(hash_split(season_panel(spark, sf_dir), SPEC), "split", TARGET)
