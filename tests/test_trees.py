"""Trees grown from histograms against Spark ML's own learner."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from panelcast.models import estimators as est
from panelcast.models import histograms as h
from panelcast.models import trees

COLS = ["a", "b", "c", "d", "e", "same"]


@pytest.fixture(params=["levels", "alone"])
def path(request, monkeypatch):
    """Trees grown level by level over all tasks, or each in one task."""
    monkeypatch.setattr(trees, "ALONE_ROWS", 0 if request.param == "levels" else 1 << 16)


def _rows(spark, n, whole=True, parts=3):
    """Continuous, repeated, mirrored, mostly zero and constant columns; a label that depends on some of them."""
    df = spark.range(0, n, 1, parts).select(
        "id", F.randn(1).alias("a"), (F.rand(2) * 5).cast("int").alias("b"), F.when(F.rand(3) > 0.9, F.rand(4)).otherwise(0.0).alias("d"))
    df = df.withColumns({"c": 100.0 - F.col("a"), "e": (F.col("b") > 2).cast("int"), "same": F.lit(7.0)})
    y = 60 + 15 * F.col("a") + 4 * F.col("b") * F.col("a") + 30 * F.col("d") + 8 * F.randn(5)
    df = df.withColumn("y", F.greatest(F.floor(y), F.lit(0)).cast("double") if whole else y).checkpoint(eager=True)
    return df


def _both(df, factory):
    assemble, grown = factory(df).getStages()
    return (Pipeline(stages=[assemble, stage]).fit(df) for stage in (grown, grown.regressor))


def _same(df, new, old, tolerance=0.0):
    got, want = (np.array([r[0] for r in m.transform(df).orderBy("id").select("predicted").collect()]) for m in (new, old))
    assert np.max(np.abs(got - want)) <= tolerance * np.max(np.abs(want))
    assert new.stages[-1].totalNumNodes == old.stages[-1].totalNumNodes
    a, b = (m.stages[-1].featureImportances.toArray() for m in (new, old))
    assert np.max(np.abs(a - b)) <= tolerance


def test_forest_is_spark_mls(spark, path, monkeypatch):
    df = _rows(spark, 3000)
    # several groups of trees, whose siblings are derived
    monkeypatch.setattr(trees, "HISTOGRAM_BYTES", 1 << 20)
    new, old = _both(df, est.random_forest(COLS, "y", 7, 8))
    _same(df, new, old)


def test_forest_over_sampled_thresholds_and_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(trees, "ALONE_ROWS", 0)
    df = _rows(spark, 25000, parts=2)
    monkeypatch.setattr(trees, "CHUNK_ROWS", 4000)
    new, old = _both(df, est.random_forest(COLS, "y", 3, 5))
    _same(df, new, old)


def test_forest_of_fractions(spark, path):
    df = _rows(spark, 2000, whole=False)
    new, old = _both(df, est.random_forest(COLS, "y", 3, 6))
    _same(df, new, old, 1e-9)


@pytest.mark.parametrize("whole", [True, False])
def test_boosting_is_spark_mls(spark, path, monkeypatch, whole):
    df = _rows(spark, 2500, whole, parts=1)
    # the lineage is cut on the way
    monkeypatch.setattr(trees, "CHECKPOINT_ROUNDS", 3)
    new, old = _both(df, est.gradient_boosting(COLS, "y", 8, 4, 0.1))
    _same(df, new, old, 1e-9)


def test_boosting_with_derived_siblings_keeps_its_error(spark, monkeypatch):
    df = _rows(spark, 2500, False)
    monkeypatch.setattr(trees, "ALONE_ROWS", 0)
    monkeypatch.setattr(trees, "DERIVED_ROWS", 100)
    new, old = _both(df, est.gradient_boosting(COLS, "y", 8, 4, 0.1))
    errors = [m.transform(df).agg(F.avg(F.abs(F.col("y") - F.col("predicted")))).first()[0] for m in (new, old)]
    assert abs(errors[0] - errors[1]) < 1e-6 * errors[1]


def test_a_leaf_alone_and_rows_that_cannot_be_fitted(spark, path):
    df = _rows(spark, 50).withColumn("y", F.lit(3.0)).checkpoint(eager=True)
    new, old = _both(df, est.random_forest(COLS, "y", 2, 3))
    _same(df, new, old)
    with pytest.raises(Exception):
        est.fit(df.limit(0), est.random_forest(COLS, "y", 2, 3))
    with pytest.raises(Exception):
        est.fit(df.withColumn("a", F.lit(None).cast("double")), est.random_forest(COLS, "y", 2, 3))


def test_large_sums_leave_the_shared_double():
    n = 1000
    bins, y, w = np.zeros((1, n), np.uint8), np.full(n, 2.0 ** 19), np.full(n, 3.0)
    bins[0, ::2] = 1
    sums = h.Sums(1, 2, 1, True)
    rows, base = np.arange(n), np.zeros(n, np.int64)
    for _ in range(3):
        sums.add(bins, rows, base, w, y)      # 1.5e9 a call, beyond what shares a double
    sums.add(bins, rows, base, w, y / 2 ** 19)
    got = sums.result()
    half = 3.0 * n / 2
    assert got[:, 0].tolist() == [[4 * half] * 2, [(3 * 2.0 ** 19 + 1) * half] * 2, [(3 * 2.0 ** 38 + 1) * half] * 2]
