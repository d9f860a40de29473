"""Evaluation queries over the scored test split.

The scored table comes from the SQL-reproducible baseline predictor (a
least-squares line fitted on the train split), so every report is checked
against SQL end to end.  The Spark ML models produce the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.models.baseline import baseline_scored
from panelcast.models.split import hash_split
from panelcast.operators.evaluate import (
    BIAS_RULES, accuracy_bands, bias_rules, deployment_summary, directional_accuracy, error_by_flag, error_by_prior_level,
    error_by_role, error_by_tier, error_quartiles, error_table, intervals, regression_metrics,
)
from panelcast.operators.profile import target_correlation
from panelcast.operators.rank import top_k
from panelcast.plans import oracle_base as ob
from panelcast.plans.panel import season_panel
from panelcast.plans.q_profile import SPLIT_SQL
from panelcast.plans.registry import query
from panelcast.spec import (
    ACTUAL_TIER_EDGES, ACTUAL_TIER_LABELS, DEFAULT_SPEC, DIRECTION_MARGIN, ERROR_CORRELATION_FEATURES,
    IP_TIER_EDGES, IP_TIER_LABELS, K9_TIER_EDGES, K9_TIER_LABELS, PRIOR_LEVEL_CUT,
)

c = F.col
SPEC = DEFAULT_SPEC
KEY = ["player_id", "season"]
T = SPEC.target


def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_scored(hash_split(season_panel(spark, sf_dir), SPEC), SPEC)


def test_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_panel(spark, sf_dir).filter((c("split") == "test") & c(T).isNotNull())
    return error_table(s.withColumn("actual", c(T)))


EVAL_CTES = f"""
splitp AS (SELECT *, {SPLIT_SQL} AS split FROM panel),
coef AS (
  SELECT regr_slope({T}, total_strikeouts) AS slope, regr_intercept({T}, total_strikeouts) AS intercept
  FROM splitp WHERE split = 'train' AND {T} IS NOT NULL
),
scored AS (
  SELECT *, (SELECT intercept FROM coef) + (SELECT slope FROM coef) * total_strikeouts AS predicted FROM splitp
),
errs AS (
  SELECT *, {T} AS actual, {T} - predicted AS error, abs({T} - predicted) AS abs_error,
         abs({T} - predicted) / NULLIF({T}, 0) * 100 AS percent_error
  FROM scored WHERE split = 'test' AND {T} IS NOT NULL
)"""


def eq(select_sql: str, keep: tuple[str, ...] = ()) -> str:
    return ob.panel_query(select_sql, keep=keep, extra_ctes=EVAL_CTES)


_ERR_COLS = ["actual", "predicted", "error", "abs_error", "percent_error", "age", "is_young", "is_prime_age",
             "is_veteran", "k_per_9", "swstr_pct", "total_innings_pitched"]


@query("error_table", "E1 J5 M1", eq(f"SELECT player_id, season, {', '.join(_ERR_COLS)} FROM errs"))
def error_table_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed, absolute and percent error of every test row, with its segment columns (joined by key)."""
    return test_errors(spark, sf_dir).select(*KEY, *_ERR_COLS)


_AGE_FLAGS = ["is_young", "is_prime_age", "is_veteran"]


@query("error_by_age_group", "E2", eq(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS \"group\", count(CASE WHEN {f} = 1 THEN 1 END) AS n, "
        f"avg(CASE WHEN {f} = 1 THEN abs_error END) AS mean_abs_error, "
        f"quantile_cont(CASE WHEN {f} = 1 THEN abs_error END, 0.5) AS median_abs_error, "
        f"avg(CASE WHEN {f} = 1 THEN percent_error END) AS mean_percent_error FROM errs" for f in _AGE_FLAGS)
    + ") WHERE n > 0", keep=('"group"',)))
def error_by_age_group_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, exact median and mean-percent absolute error for young / prime / veteran."""
    return error_by_flag(test_errors(spark, sf_dir), _AGE_FLAGS)


def _tier_sql(column: str, edges, labels) -> str:
    cases = " ".join(f"WHEN {column} > {lo} AND {column} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return eq(f"""
SELECT tier, count(*) AS n, avg(abs_error) AS mae, avg(error) AS bias, avg(percent_error) AS mean_percent_error
FROM (SELECT *, CASE {cases} END AS tier FROM errs) WHERE tier IS NOT NULL GROUP BY tier""", keep=("tier",))


@query("error_by_k9_tier", "E3", _tier_sql("k_per_9", K9_TIER_EDGES, K9_TIER_LABELS))
def error_by_k9_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by right-closed K/9 tier."""
    return error_by_tier(test_errors(spark, sf_dir), "k_per_9", K9_TIER_EDGES, K9_TIER_LABELS)


@query("error_by_workload_tier", "E4", _tier_sql("total_innings_pitched", IP_TIER_EDGES, IP_TIER_LABELS))
def error_by_workload_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by right-closed innings tier."""
    return error_by_tier(test_errors(spark, sf_dir), "total_innings_pitched", IP_TIER_EDGES, IP_TIER_LABELS)


@query("error_by_actual_tier", "E5", _tier_sql("actual", ACTUAL_TIER_EDGES, ACTUAL_TIER_LABELS))
def error_by_actual_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by right-closed tier of the actual value."""
    return error_by_tier(test_errors(spark, sf_dir), "actual", ACTUAL_TIER_EDGES, ACTUAL_TIER_LABELS)


@query("error_by_role", "E6", eq("""
SELECT is_starter, count(*) AS n, avg(abs_error) AS mae, avg(error) AS bias,
       count(*) * 100.0 / (SELECT count(*) FROM errs) AS share_pct
FROM errs GROUP BY is_starter"""))
def error_by_role_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starter vs reliever: n, share, MAE, bias."""
    return error_by_role(test_errors(spark, sf_dir), "is_starter")


@query("accuracy_bands", "E7", eq(" UNION ALL ".join(
    f"SELECT {w} AS band, count(CASE WHEN abs_error <= {w} THEN 1 END) AS n_within, count(*) AS total, "
    f"count(CASE WHEN abs_error <= {w} THEN 1 END) * 100.0 / count(*) AS share_pct FROM errs" for w in (10, 20, 30))))
def accuracy_bands_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of test predictions within +-10/20/30 of the actual value."""
    return accuracy_bands(test_errors(spark, sf_dir))


_DIR = f"""(SELECT CAST(sign(actual - total_strikeouts) = sign(predicted - total_strikeouts) AS INTEGER) AS correct,
  CASE WHEN actual - total_strikeouts > {DIRECTION_MARGIN} THEN 'improved'
       WHEN actual - total_strikeouts < -{DIRECTION_MARGIN} THEN 'declined' ELSE 'stable' END AS direction_class
  FROM errs)"""


@query("directional_accuracy", "E8", eq(f"""
SELECT direction_class, n, n_correct, n_correct * 100.0 / n AS pct_correct FROM (
  SELECT 'overall' AS direction_class, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct FROM {_DIR}
  UNION ALL
  SELECT direction_class, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct FROM {_DIR} GROUP BY direction_class
)""", keep=("direction_class",)))
def directional_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did the predicted change from this season have the sign of the actual change? Overall and per class."""
    return directional_accuracy(test_errors(spark, sf_dir), "total_strikeouts")


@query("prediction_intervals", "E9", eq("""
SELECT stddev_pop(error) AS residual_std, stddev_pop(error) * 1.28 AS ci80,
       stddev_pop(error) * 1.645 AS ci90, stddev_pop(error) * 1.96 AS ci95 FROM errs"""))
def intervals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual population std and the 80/90/95% half-widths."""
    return intervals(test_errors(spark, sf_dir))


@query("error_quartiles", "E10", eq("""
SELECT 'high_confidence' AS "group", q25 AS threshold, count(CASE WHEN abs_error <= q25 THEN 1 END) AS n,
       avg(CASE WHEN abs_error <= q25 THEN abs_error END) AS mean_abs_error
FROM errs, (SELECT quantile_cont(abs_error, 0.25) AS q25 FROM errs) GROUP BY q25
UNION ALL
SELECT 'low_confidence', q75, count(CASE WHEN abs_error >= q75 THEN 1 END),
       avg(CASE WHEN abs_error >= q75 THEN abs_error END)
FROM errs, (SELECT quantile_cont(abs_error, 0.75) AS q75 FROM errs) GROUP BY q75""", keep=('"group"',)))
def quartiles_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst quarter of predictions by absolute error (exact quartiles)."""
    return error_quartiles(test_errors(spark, sf_dir))


@query("error_by_prior_level", "E11", eq(f"""
SELECT CASE WHEN total_strikeouts > {PRIOR_LEVEL_CUT} THEN 'above' ELSE 'at_or_below' END AS level,
       count(*) AS n, avg(abs_error) AS mae FROM errs GROUP BY 1""", keep=("level",)))
def prior_level_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE for entities above vs at-or-below 150 this season."""
    return error_by_prior_level(test_errors(spark, sf_dir), "total_strikeouts", PRIOR_LEVEL_CUT)


_RULES = [("A", "is_starter = 1", 3.0), ("B", "is_starter = 0", 3.0), ("C", "age < 27", 5.0),
          ("D", "age > 32", 5.0), ("E", "is_ace = 1", 5.0)]


@query("bias_rules", "E12", eq(" UNION ALL ".join(
    f"SELECT '{r}' AS rule, COALESCE(avg(CASE WHEN {cond} THEN error END), 0.0) AS bias, "
    f"CAST({t} AS DOUBLE) AS threshold, CAST(abs(COALESCE(avg(CASE WHEN {cond} THEN error END), 0.0)) > {t} AS INTEGER) AS fires "
    f"FROM errs" for r, cond, t in _RULES), keep=("rule",)))
def bias_rules_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment biases checked against the improvement-suggestion thresholds."""
    return bias_rules(test_errors(spark, sf_dir)).drop("suggestion")


@query("bias_suggestions", "E12", eq("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, COALESCE(avg(CASE WHEN {cond} THEN error END), 0.0) AS bias, '{text}' AS suggestion "
    f"FROM errs HAVING abs(COALESCE(avg(CASE WHEN {cond} THEN error END), 0.0)) > {t}" for r, cond, t, text in BIAS_RULES) + ")",
    keep=("rule", "suggestion")))
def bias_suggestions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The improvement suggestions of the rules that fire, with their biases."""
    return bias_rules(test_errors(spark, sf_dir)).where("fires = 1").select("rule", "bias", "suggestion")


_WORST = ["player_id", "season", "actual", "predicted", "error", "abs_error", "is_starter", "k_per_9",
          "total_innings_pitched", "age"]


@query("worst_predictions", "E13 T2 T3", eq(
    f"SELECT {', '.join(_WORST)} FROM errs ORDER BY abs_error DESC, player_id, season LIMIT 10"))
def worst_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest absolute errors (top-k is the feature)."""
    return top_k(test_errors(spark, sf_dir).select(*_WORST), "abs_error", 10, ["player_id", "season"])


@query("error_correlation", "A11", eq(
    "SELECT feature, r, abs(r) AS abs_r FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN isnan(corr(CAST({f} AS DOUBLE), abs_error)) THEN NULL "
        f"ELSE corr(CAST({f} AS DOUBLE), abs_error) END AS r FROM errs" for f in ERROR_CORRELATION_FEATURES) + ")",
    keep=("feature",)))
def error_correlation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of 12 features with the absolute error."""
    return target_correlation(test_errors(spark, sf_dir), ERROR_CORRELATION_FEATURES, "abs_error")


@query("eval_metrics", "M15 E14 E15 E7 E8", ob.panel_query(f"""
SELECT split, n, mae, rmse, r2, mean_actual, mae * 100.0 / mean_actual AS mae_pct_of_mean, rmse / mae AS rmse_mae_ratio,
       directional_pct, within20_share,
       CASE WHEN rmse > mae * 1.2 THEN 'large errors present' ELSE 'consistent errors' END AS outlier_class,
       CASE WHEN r2 > 0.7 AND directional_pct > 70 AND within20_share > 0.75 THEN 'STRONG'
            WHEN r2 > 0.5 AND directional_pct > 60 THEN 'GOOD' ELSE 'CAUTION' END AS verdict
FROM (
  SELECT split, count(*) AS n, avg(abs({T} - predicted)) AS mae, sqrt(avg(({T} - predicted) * ({T} - predicted))) AS rmse,
         1 - sum(({T} - predicted) * ({T} - predicted)) / (sum({T} * {T}) - sum({T}) * sum({T}) / count(*)) AS r2,
         avg({T}) AS mean_actual,
         avg(CAST(sign({T} - total_strikeouts) = sign(predicted - total_strikeouts) AS INTEGER)) * 100 AS directional_pct,
         avg(CAST(abs({T} - predicted) <= 20 AS INTEGER)) AS within20_share
  FROM scored WHERE {T} IS NOT NULL GROUP BY split)""", keep=("split", "outlier_class", "verdict"),
    extra_ctes=EVAL_CTES))
def eval_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE / RMSE / R^2 per split in one pass, with MAE-%-of-mean, outlier class and deployment verdict."""
    s = scored_panel(spark, sf_dir).filter(c(T).isNotNull())
    m = regression_metrics(s.withColumn("actual", c(T)), group=["split"], prior="total_strikeouts", band=20)
    return deployment_summary(m)
