"""Written results (S5, S6) and runs side by side (J8): the tables that an experiment leaves
behind are written by tasks and read back from their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.joins import compare_side_by_side
from panelcast.plans.q_eval import error_correlation_q, eval_metrics_q
from panelcast.plans.q_ingest import _folder
from panelcast.plans.registry import REGISTRY, query
from panelcast.sources.sinks import write_list, write_table
from panelcast.sources.tables import read_csv

c = F.col
STRONGEST = 0.05
METRICS = ["mae", "rmse", "r2", "mean_actual", "directional_pct", "within20_share"]


@query("metrics_file", "S5", REGISTRY["eval_metrics"].sql)
def metrics_file_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table of a run, written as Parquet and read back."""
    path = _folder(spark, "metrics")
    write_table(eval_metrics_q(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("feature_list_file", "S6", f"SELECT feature FROM ({REGISTRY['error_correlation'].sql}) WHERE abs_r > {STRONGEST}")
def feature_list_file_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features whose correlation with the error exceeds a cut, as a headed CSV list."""
    path = _folder(spark, "features")
    write_list(error_correlation_q(spark, sf_dir).where(c("abs_r") > STRONGEST), "feature", path)
    return read_csv(spark, path, "feature string")


@query("split_comparison", "J8 M15", "WITH m AS (" + REGISTRY["eval_metrics"].sql + ")\n" + " UNION ALL ".join(
    f"SELECT '{x}' AS metric, max(CASE WHEN split = 'train' THEN {x} END) AS train, "
    f"max(CASE WHEN split = 'test' THEN {x} END) AS test FROM m" for x in METRICS))
def split_comparison_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test metrics of one fit, a row for each metric."""
    metrics = eval_metrics_q(spark, sf_dir).select("split", *[c(x).cast("double").alias(x) for x in METRICS])
    long = metrics.unpivot(["split"], METRICS, "metric", "value").checkpoint(eager=True)
    return compare_side_by_side({s: long.where(c("split") == s) for s in ("train", "test")})
