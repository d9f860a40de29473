"""Models from moments against closed forms, Spark ML and a plain lasso."""

import numpy as np
import pytest

from panelcast.models import estimators as est
from panelcast.models import gram as g


def frame(spark, n=500, k=6, seed=3, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * [1, 3, 0.5, 10, 2, 1] + [0, 5, -1, 50, 2, 0] + offset
    x[:, 5] = 7.0                                   # without spread
    y = (x[:, :5] - offset) @ [1.5, -0.7, 2.0, 0.05, 0.0] + rng.normal(scale=2.0, size=n) + 10
    rows = [(*map(float, r), float(t), int(i % 5), "abc"[i % 3]) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ", ".join(f"f{i} double" for i in range(k)) + ", y double, fold int, seg string")


COLS = [f"f{i}" for i in range(6)]


def test_accumulators_add_up_at_a_large_offset(spark):
    x, y, df = frame(spark, offset=1e8)
    whole = np.column_stack([x, y])
    held = g.collect(g.moments_by(df.repartition(7), [*COLS, "y"], ["fold", "seg"]))
    assert len(held) == 15 and sum(m.n for m in held.values()) == 500
    m = g.total(held)
    want = np.cov(whole, rowvar=False, ddof=0) * 500
    assert np.allclose(m.mean, whole.mean(axis=0), rtol=1e-14)
    assert np.allclose(m.co, want, atol=1e-5 * np.abs(want).max()) and m.scale()[5] == 0


def test_ridge_equals_spark_ml_and_any_union_of_keys(spark):
    x, y, df = frame(spark)
    held = g.collect(g.moments_by(df, [*COLS, "y"], ["fold"]))
    for out in range(5):
        own = g.ridge(g.total(held, lambda k: k != (out,)), 0.5)
        train = df.where(f"fold != {out}")
        model = est.fit(train, est.ridge(COLS, "y", 0.5))
        got = model.transform(df).withColumn("own", own.column(COLS)).selectExpr("max(abs(own - predicted)) / max(abs(own))").first()[0]
        assert got < 1e-6
        at = np.arange(500) % 5 != out
        z = (x[:, :5] - x[at, :5].mean(axis=0)) / x[at, :5].std(axis=0, ddof=1)
        w = np.linalg.solve(z[at].T @ z[at] + 0.5 * np.eye(5), z[at].T @ (y[at] - y[at].mean()))
        assert np.allclose(own.predict(x), y[at].mean() + z @ w, rtol=0, atol=1e-9)


def test_least_squares_with_collinear_columns(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    x = np.column_stack([a, a, 1 - a])
    y = 3 * a + rng.normal(size=200)
    model = g.ridge(g.Moments.of(np.column_stack([x, y])), 0)
    want = np.column_stack([np.ones(200), a]) @ np.linalg.lstsq(np.column_stack([np.ones(200), a]), y, rcond=None)[0]
    assert np.allclose(model.predict(x), want, atol=1e-8)


def slow_lasso(z, y, alpha, steps=4000):
    """Proximal gradient on the rows."""
    n, w = len(y), np.zeros(z.shape[1])
    rate = 1 / (np.linalg.norm(z, 2) ** 2 / n)
    for _ in range(steps):
        w = w - rate * (z.T @ (z @ w - y) / n)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * alpha, 0)
    return w


def test_lasso_path_equals_proximal_gradient(spark):
    x, y, _ = frame(spark)
    m = g.Moments.of(np.column_stack([x, y]))
    z = (x[:, :5] - x[:, :5].mean(axis=0)) / x[:, :5].std(axis=0, ddof=1)
    alphas = [0.01, 5.0, 0.3, 1.0]
    for alpha, model in zip(alphas, g.lasso_path(m, alphas)):
        want = slow_lasso(z, y - y.mean(), alpha)
        assert np.allclose(g.standardised(model, m)[:5], want, atol=1e-7) and model.coef[5] == 0


def test_lasso_cv_equals_fits_on_rows(spark):
    x, y, df = frame(spark)
    alphas = [10 ** (-3 + 5 * i / 49) for i in range(50)]
    errors, model, best = g.lasso_cv(g.collect(g.moments_by(df, [*COLS, "y"], ["fold"])), alphas)
    fold = np.arange(500) % 5
    scale = x[:, :5].std(axis=0, ddof=1)
    for k in (0, 20, 40, best):
        want = []
        for f in range(5):
            a, b = fold != f, fold == f
            mean = x[a][:, :5].mean(axis=0)
            w = slow_lasso((x[a][:, :5] - mean) / scale, y[a] - y[a].mean(), alphas[k], 1500)
            want.append(np.mean((y[b] - y[a].mean() - (x[b][:, :5] - mean) / scale @ w) ** 2))
        assert errors[k] == pytest.approx(np.mean(want), rel=1e-6)
    assert best == int(np.argmin(errors)) and np.count_nonzero(model.coef) >= 3


def test_many_segments_are_solved_in_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(s, float(a), float(s * a + 1 + e)) for s in range(300) for a, e in zip(rng.normal(size=12), rng.normal(scale=.1, size=12))]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0), (7, None, 5.0)], "seg int, a double, y double")
    models = g.ridge_by(g.moments_by(df, ["a", "y"], ["seg"]), ["seg"], 0.5)
    assert models.count() == 301
    got = {(r["seg"], r["a"]): r["predicted"] for r in g.score_by(df, models, ["seg"], ["a"], ["a"]).where("a is not null").collect()}
    assert len(got) == 3600
    for s in (0, 7, 299):
        own = np.array([r[1:] for r in rows if r[0] == s])
        model = g.ridge(g.Moments.of(own), 0.5)
        assert all(got[(s, a)] == pytest.approx(float(model.predict(np.array([[a]]))[0]), abs=1e-9) for a in own[:, 0])


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "a double, y double, fold int")
    assert g.collect(g.moments_by(df, ["a", "y"], ["fold"])) == {} and g.total({}) is None
    one = spark.createDataFrame([(1.0, 5.0, 0)], "a double, y double, fold int")
    model = g.ridge(g.collect(g.moments_by(one, ["a", "y"], []))[()], 0.5)
    assert model.intercept == 5.0 and model.coef.tolist() == [0.0]
