"""Models and statistics against numpy, and edge groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelcast.functions.text import normalized_name
from panelcast.models import estimators as est
from panelcast.operators.evaluate import accuracy_bands, regression_metrics
from panelcast.operators.joins import match_rate
from panelcast.operators.profile import pairwise_correlations
from panelcast.operators.rank import global_rank

SF = "/root/testdata/sf0.001"


def coordinate_descent(x, y, alpha, rounds=20_000):
    """argmin 1/(2n) |y - xw|^2 + alpha |w|_1 on centred columns."""
    n, w = len(y), np.zeros(x.shape[1])
    rest, size = y - y.mean(), (x ** 2).sum(axis=0) / len(y)
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            rest += x[:, j] * w[j]
            rho = x[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / size[j]
            rest -= x[:, j] * w[j]
        if np.abs(w - before).max() < 1e-10:
            break
    return w


@pytest.mark.parametrize("alpha", [1.0, 0.1, 0.001])
def test_lasso_converges(spark, alpha):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 4))
    x = np.column_stack([base, base[:, 0] + 0.05 * rng.normal(size=150), base[:, 1] * 2 + 0.1 * rng.normal(size=150)])
    y = 5 * x[:, 0] - 3 * x[:, 1] + rng.normal(size=150) * 2
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in [*cols, "y"]))
    model = est.fit(df, est.lasso(cols, "y", alpha)).stages[-1]
    scaled = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want, got = coordinate_descent(scaled, y, alpha), model.coefficients.toArray()
    assert model.summary.totalIterations < est.LASSO_ITERATIONS
    assert np.allclose(got, want, atol=0.02)
    assert (np.abs(got) > 0.01).tolist() == (np.abs(want) > 0.01).tolist()


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_correlation_keeps_its_digits(spark, offset):
    rng = np.random.default_rng(1)
    a = rng.normal(size=400)
    b = 0.5 * a + rng.normal(size=400)
    rows = [(float(x + offset), float(y + offset), 7.0) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, flat double").repartition(5)
    got = {r["feature_b"]: r["r"] for r in pairwise_correlations(df, [("a", "b"), ("a", "flat")]).collect()}
    assert got["b"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6) and got["flat"] is None


def test_metrics_of_degenerate_groups(spark):
    rows = [("one", 1.0, 2.0), ("flat", 3.0, 1.0), ("flat", 3.0, 5.0), ("fine", 1.0, 1.0), ("fine", 3.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, actual double, predicted double")
    got = {r["g"]: r for r in regression_metrics(df, group=["g"]).collect()}
    assert got["one"]["r2"] is None and got["flat"]["r2"] is None and got["fine"]["r2"] == pytest.approx(0.5)
    empty = df.limit(0).withColumn("abs_error", F.lit(0.0))
    assert all(r["share_pct"] is None for r in accuracy_bands(empty).collect())
    assert match_rate(empty, ["actual"]).first()["match_pct"] is None


def test_names_lose_every_mark(spark):
    rows = [("José ",), ("José\t",), ("\n J.o'sé",), ("Łukasz",), (None,), (" Ana",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(normalized_name("n")).collect()]
    assert got == ["jose", "jose", "jose", "łukasz", None, "ana"]


def test_rank_is_long_and_total(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("double").alias("s"))
    ranked = global_rank(df, "s", ["id"])
    assert dict(ranked.dtypes)["rank"] == "bigint"
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 101))


def test_forest_projection_covers_the_season(spark):
    q = entry.queries()
    assert q["main_projection_rf"](spark, SF).count() == q["main_projection"](spark, SF).count()


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == entry.queries()["main_projection"](spark, SF).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_of_any_script_lose_their_marks(spark):
    import unicodedata

    from panelcast.functions.text import strip_accents
    blocks = [(0xC0, 0x250), (0x370, 0x530), (0x590, 0x700), (0x900, 0x980), (0x1E00, 0x2000), (0x3040, 0x3100)]
    texts = ["".join(chr(c) for c in range(lo, hi) if unicodedata.category(chr(c))[0] == "L") for lo, hi in blocks] + ["Ά\u0301й e\u0301 Łódź"]
    want = ["".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["s"] for r in df.select("i", strip_accents("t").alias("s")).orderBy("i").collect()] == want


def test_metrics_keep_their_digits_and_guard_empty_tables(spark):
    from panelcast.operators.evaluate import deployment_summary, directional_accuracy, regression_metrics
    from panelcast.operators.profile import quadratic_trend
    rows = [(1e8 + i, 1e8 + i + (0.5 if i % 2 else -0.5)) for i in range(10)]
    got = regression_metrics(spark.createDataFrame(rows, "actual double, predicted double")).first()
    assert abs(got["r2"] - (1 - 0.25 / 8.25)) < 1e-9
    same = regression_metrics(spark.createDataFrame([(5.0, 4.0)] * 3, "actual double, predicted double")).first()
    assert same["r2"] is None and same["mae"] == 1.0
    one_age = quadratic_trend(spark.createDataFrame([(30, 1.0), (30, 2.0)], "age int, y double"), "age", "y").first()
    assert tuple(one_age) == (None, None, None)
    none = spark.createDataFrame([], "actual double, predicted double, prior double")
    assert directional_accuracy(none, "prior").first()["pct_correct"] is None
    zero = regression_metrics(spark.createDataFrame([(1.0, 1.0, 0.0), (-1.0, -1.0, 0.0)], "actual double, predicted double, prior double"), prior="prior")
    assert deployment_summary(zero).first()["mae_pct_of_mean"] is None
