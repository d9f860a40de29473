"""A closed-form baseline predictor that plain SQL can reproduce.

Least-squares line of the target on one prior-period column, fitted on the
training split with ``regr_slope`` / ``regr_intercept`` (one distributed
aggregate) and applied as a projection.  It feeds the evaluation and
projection operators so that the whole chain is checkable against SQL; the
Spark ML models in ``estimators.py`` produce the same scored-table schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.composite import scalars
from panelcast.spec import DEFAULT_SPEC, PanelSpec

c = F.col


def fit_line(train: DataFrame, x: str, y: str) -> dict[str, F.Column]:
    coef = train.agg(F.regr_slope(c(y), c(x)).alias("slope"), F.regr_intercept(c(y), c(x)).alias("intercept"))
    return scalars(coef)


def score_line(df: DataFrame, coef: dict[str, F.Column], x: str, name: str = "predicted") -> DataFrame:
    return df.withColumn(name, coef["intercept"] + coef["slope"] * c(x))


def baseline_scored(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, x: str | None = None,
                    split_col: str = "split") -> DataFrame:
    """Fit on train rows with a target, score every row (train and test)."""
    x = x or spec.count
    labelled = panel.filter(c(spec.target).isNotNull())
    coef = fit_line(labelled.filter(c(split_col) == "train"), x, spec.target)
    return score_line(panel, coef, x)
