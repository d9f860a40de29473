"""Spark ML model jobs.

Every model is a ``Pipeline`` (VectorAssembler [-> StandardScaler] ->
regressor) fitted on a DataFrame; training aggregates run distributed
(normal-equation / L-BFGS / OWL-QN sums for linear models, histogram
aggregation per tree level for forests and boosting).  Scored output keeps
the key columns, so predictions are attached by key, never by position.
Only coefficients, importances and metric tables reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.trees import HistogramTrees
from panelcast.operators.evaluate import regression_metrics

c = F.col

#: Upper limit that no fit here reaches: the solver works on aggregated moments,
#: so iterations past a hundred cost little.
LASSO_ITERATIONS = 10_000

Factory = Callable[[DataFrame], Pipeline]


def _assemble(features: Sequence[str], scaled: bool) -> list:
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    return stages


def label_stats(train: DataFrame, label: str) -> tuple[int, float]:
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return int(row["n"]), float(row["sd"] or 1.0)


def ridge(features: Sequence[str], label: str, alpha: float = 0.5) -> Factory:
    """M4: penalised least squares ||y - Xw||^2 + alpha ||w||^2 on standardised
    features.  Spark's objective is 1/(2n) SSE + lambda/2 ||w||^2 on a
    standardised label, hence lambda = alpha * sd(y) / n."""
    def make(train: DataFrame) -> Pipeline:
        n, sd = label_stats(train, label)
        lr = LinearRegression(featuresCol="features", labelCol=label, predictionCol="predicted",
                              elasticNetParam=0.0, regParam=alpha * sd / max(n, 1), solver="normal",
                              standardization=False)
        return Pipeline(stages=[*_assemble(features, True), lr])
    return make


def ols(features: Sequence[str], label: str) -> Factory:
    """M3: ordinary least squares (collinear columns are fine: predictions, not coefficients, are compared)."""
    def make(train: DataFrame) -> Pipeline:
        lr = LinearRegression(featuresCol="features", labelCol=label, predictionCol="predicted", regParam=0.0,
                              solver="normal")
        return Pipeline(stages=[*_assemble(features, True), lr])
    return make


def lasso(features: Sequence[str], label: str, alpha: float = 1.0) -> Factory:
    """M5: L1-penalised least squares, (1/2n) SSE + alpha ||w||_1 on standardised features."""
    def make(train: DataFrame) -> Pipeline:
        lr = LinearRegression(featuresCol="features", labelCol=label, predictionCol="predicted",
                              elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=LASSO_ITERATIONS, tol=1e-10)
        return Pipeline(stages=[*_assemble(features, True), lr])
    return make


def random_forest(features: Sequence[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> Factory:
    """M7: every split considers all features (the regression default samples a third)."""
    def make(train: DataFrame) -> Pipeline:
        rf = RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="predicted",
                                   numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
        return Pipeline(stages=[*_assemble(features, False), HistogramTrees(rf, features)])
    return make


def gradient_boosting(features: Sequence[str], label: str, iters: int = 100, depth: int = 5,
                      step: float = 0.1, seed: int = 42) -> Factory:
    """M8."""
    def make(train: DataFrame) -> Pipeline:
        gb = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="predicted",
                          maxIter=iters, maxDepth=depth, stepSize=step, seed=seed)
        return Pipeline(stages=[*_assemble(features, False), HistogramTrees(gb, features)])
    return make


#: Rows of a training partition above which a fit takes another round of partitions.
PARTITION_ROWS = 2_000_000


def few_partitions(train: DataFrame, rows: int = PARTITION_ROWS) -> DataFrame:
    """The same rows in no more partitions than cores, or in as many rounds of them as keep a
    partition near ``rows``.  Every pass of a tree fit shuffles one histogram a partition and open node, whatever the
    rows in it: with partitions that grow with the input a forest's histograms outgrow its rows."""
    cores, have = train.sparkSession.sparkContext.defaultParallelism, train.rdd.getNumPartitions()
    if have <= cores:
        return train
    return train.coalesce(cores * max(1, math.ceil(train.count() / (cores * rows))))


def fit(train: DataFrame, factory: Factory) -> PipelineModel:
    train = few_partitions(train)
    return factory(train).fit(train)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Batch scoring; returns the key/keep columns plus ``predicted``."""
    return model.transform(df).select(*keep, "predicted")


def fit_and_score(train: DataFrame, test: DataFrame, factory: Factory, keep: Sequence[str]) -> DataFrame:
    return score(fit(train, factory), test, keep)


def compare_models(train: DataFrame, test: DataFrame, factories: Mapping[str, Factory], keys: Sequence[str],
                   label: str) -> DataFrame:
    """One long scored table (model, key, actual, predicted) for all models
    and one grouped metrics pass over it."""
    scored = None
    for name, fac in factories.items():
        s = fit_and_score(train, test, fac, [*keys, label]).withColumn("model", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
    return regression_metrics(scored.withColumnRenamed(label, "actual"), group=["model"])


def ensemble(models: Mapping[str, PipelineModel], weights: Mapping[str, float], df: DataFrame,
             keep: Sequence[str]) -> DataFrame:
    """M9: weighted sum of several models' predictions, all scored in one pass over ``df``."""
    total, out, pred = sum(weights.values()), df.select(*df.columns), F.lit(0.0)
    for name, model in models.items():
        out = model.transform(out).withColumnRenamed("predicted", f"pred_{name}").drop("features", "raw_features", "prediction")
        pred = pred + c(f"pred_{name}") * (weights[name] / total)
    return out.withColumn("predicted", pred).select(*keep, *[f"pred_{n}" for n in models], "predicted")


def importances(model: PipelineModel, features: Sequence[str], new_features: Sequence[str] = ()) -> list[tuple]:
    """(feature, importance, rank, is_new) from tree importances or |coefficients|."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
    order = sorted(range(len(features)), key=lambda i: (-vals[i], features[i]))
    rank = {i: r + 1 for r, i in enumerate(order)}
    return [(features[i], float(vals[i]), rank[i], int(features[i] in set(new_features))) for i in range(len(features))]


def save(model: PipelineModel, path: str) -> None:
    """The fitted pipeline carries scaler, model and feature order."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
