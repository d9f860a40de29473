"""Spark ML model semantics against closed-form numpy solutions."""

import numpy as np

from panelcast.models import estimators as est


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(7)
    n, k, alpha = 400, 5, 0.5
    x = rng.normal(size=(n, k)) * [1.0, 3.0, 0.5, 10.0, 2.0] + [0.0, 5.0, -1.0, 50.0, 2.0]
    y = x @ [1.5, -0.7, 2.0, 0.05, 0.0] + rng.normal(scale=2.0, size=n) + 10.0
    cols = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", y double")
    model = est.fit(df, est.ridge(cols, "y", alpha))
    got = np.array([r.predicted for r in model.transform(df).select("predicted").collect()])
    # squared error + alpha * ||w||^2 on features standardised with the scaler's (sample) std
    xs = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    w = np.linalg.solve(xs.T @ xs + alpha * np.eye(k), xs.T @ (y - y.mean()))
    want = y.mean() + xs @ w
    assert np.max(np.abs(got - want)) < 1e-6 * np.max(np.abs(want))


def test_ols_predictions_match_lstsq(spark):
    rng = np.random.default_rng(11)
    n = 300
    a = rng.normal(size=n)
    x = np.column_stack([a, a, 1 - a, rng.normal(size=n)])  # duplicate and complementary columns
    y = 3 * a + x[:, 3] + rng.normal(scale=0.5, size=n)
    cols = ["a", "a2", "b", "c"]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, a2 double, b double, c double, y double")
    got = np.array([r.predicted for r in est.fit(df, est.ols(cols, "y")).transform(df).select("predicted").collect()])
    design = np.column_stack([np.ones(n), x])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.max(np.abs(got - want)) < 1e-6


def test_feature_sets_and_seasons_compared(spark):
    from panelcast.plans import q_models as q
    sf = "/root/testdata/sf0.001"
    got = {r["model"]: r for r in q.feature_sets_q(spark, sf).collect()}
    assert set(q.SELECTIVE) < set(q.MOMENTUM_FEATURES)
    assert {m: r["n_features"] for m, r in got.items()} == {
        "base": 58, "base+momentum": 89, "base+selective": 68, "base+availability": 65, "base+pitch_mix": 69,
        "base, last 5 seasons": 58, "base, last 7 seasons": 58, "base, last 11 seasons": 58}
    fewest = got["base, last 5 seasons"]
    assert got["base"]["mae_change"] == 0 and fewest["mae_change"] == 0
    # the stand-in has seven seasons, so seven and eleven are the same rows
    more, most = got["base, last 7 seasons"], got["base, last 11 seasons"]
    assert abs(more["mae"] - most["mae"]) < 1e-9 and abs(more["mae_change"] - (more["mae"] - fewest["mae"])) < 1e-9
    test = q.model_table(spark, sf).filter("split = 'test'")
    last = q.season_panel(spark, sf).agg({"season": "max"}).first()[0]
    assert fewest["n"] == test.filter(test.season > last - 5).count() < most["n"] == test.count()


def test_verdicts_in_units_and_percent(spark):
    from panelcast.plans.q_models import _with_change
    maes = {"base": 20.0, "a": 19.7, "b": 19.9, "c": 20.0, "d": 20.6, "e": 19.0}
    got = _with_change(spark.createDataFrame(list(maes.items()), "model string, mae double"), "base").collect()
    assert {r["model"]: (r["verdict"], r["pct_verdict"]) for r in got} == {
        "base": ("same", "not improved"), "a": ("same", "improved"), "b": ("same", "marginal"), "c": ("same", "not improved"),
        "d": ("worse", "not improved"), "e": ("better", "improved")}


def test_training_partitions_do_not_grow_with_the_input(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(4000).repartition(10 * cores, "id")
    few = est.few_partitions(df)
    assert few.rdd.getNumPartitions() == cores and few.agg({"id": "sum"}).first()[0] == 4000 * 3999 // 2
    # rounds of partitions where they would get long; frames of few partitions stay as they are
    assert est.few_partitions(df, rows=-(-4000 // (3 * cores))).rdd.getNumPartitions() == 3 * cores
    assert est.few_partitions(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 1


def test_fits_read_few_partitions(spark, monkeypatch):
    seen = []

    class Stage:
        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())

    est.fit(spark.range(400).repartition(10 * spark.sparkContext.defaultParallelism, "id"), lambda train: Stage())
    assert seen == [spark.sparkContext.defaultParallelism]


def _tables_read_by_model_tables(query, spark, monkeypatch):
    """Whether the frames handed to ``model_table`` still hold the plan of the source tables."""
    from panelcast.plans import q_models as q
    real, seen = q.model_table, []

    def caught(spark, sf_dir, extra=None, **more):
        seen.append(extra is None or "l_orderkey" in extra._jdf.queryExecution().analyzed().toString())
        return real(spark, sf_dir, extra, **more)

    monkeypatch.setattr(q, "model_table", caught)
    query(spark, "/root/testdata/sf0.001").collect()
    return seen


def test_feature_sets_build_the_panel_once(spark, monkeypatch):
    from panelcast.plans import q_models as q
    assert _tables_read_by_model_tables(q.feature_sets_q, spark, monkeypatch) == [False, False]


def test_forest_projection_builds_the_panel_once(spark, monkeypatch):
    from panelcast.plans import q_models as q
    random_forest = q.est.random_forest
    monkeypatch.setattr(q.est, "random_forest", lambda f, t: random_forest(f, t, 2, 2))
    assert _tables_read_by_model_tables(q.main_projection_rf_q, spark, monkeypatch) == [False]
