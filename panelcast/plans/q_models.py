"""Model-training queries (M2-M13, M16-M22, S7).  Linear models come from
``models.gram``: one scan gathers moments, which every training set of an experiment
shares; those with a closed form have an SQL oracle.

The model table (labelled, complete rows with the hash split) is written
once per query with a reliable checkpoint into the cluster's checkpoint
folder: iterative fitting then reads a short lineage that survives executor
loss instead of recomputing the panel for every pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.models import estimators as est
from panelcast.models import gram
from panelcast.models.split import hash_split, with_bucket, with_folds
from panelcast.operators.composite import injury_features, momentum_features
from panelcast.operators.evaluate import regression_metrics
from panelcast.operators.filters import drop_incomplete, with_target
from panelcast.plans import oracle_models as om
from panelcast.plans.panel import season_panel
from panelcast.plans.q_joins import PITCH_COLS, pitch_side
from panelcast.operators.impute import column_medians, median_impute
from panelcast.operators.joins import left_join_normalized
from panelcast.operators.rank import best_by
from panelcast.plans.registry import query
from panelcast.session import ensure_checkpoint_dir
from panelcast.spec import AVAILABILITY_FEATURES, DEFAULT_SPEC, ENGINEERED, MODEL_FEATURES, MOMENTUM_FEATURES, SELECTIVE

c = F.col
SPEC = DEFAULT_SPEC
KEY = ["player_id", "season"]
T = SPEC.target
FEATURES = list(MODEL_FEATURES)
def model_table(spark: SparkSession, sf_dir: str, extra: DataFrame | None = None,
                features: list[str] = FEATURES) -> DataFrame:
    """Labelled rows without NULL features (P4, P5) plus split/bucket/fold columns, checkpointed."""
    ensure_checkpoint_dir(spark)
    panel = season_panel(spark, sf_dir) if extra is None else extra
    df = drop_incomplete(with_target(panel), [*features, T])
    df = with_folds(with_bucket(hash_split(df, SPEC), SPEC), 5, SPEC)
    return df.select(*KEY, "split", "bucket", "fold", "is_starter", "total_strikeouts", *[
        x for x in features if x not in ("is_starter", "total_strikeouts")], T).checkpoint(eager=True)


def _train_test(df: DataFrame):
    return df.filter(c("split") == "train"), df.filter(c("split") == "test")


def _metrics(scored: DataFrame, name: str) -> DataFrame:
    return regression_metrics(scored.withColumnRenamed(T, "actual")).withColumn("model", F.lit(name))


def _held(df: DataFrame, *by: str, features: list[str] = FEATURES) -> dict[tuple, gram.Moments]:
    """Moments of the features and the label by keys of a fixed number (split, fold, bucket, season)."""
    return gram.collect(gram.moments_by(df, [*features, T], by))


def _compared(df: DataFrame, models: dict[str, tuple[gram.Linear, list[str]]], name: str = "model", keep: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of several linear models over the same rows, from one pass."""
    return regression_metrics(gram.score_all(df, models, T, keep, name), group=[name, *keep])


def _with_change(metrics: DataFrame, baseline: str) -> DataFrame:
    """MAE change against the baseline model, in units and percent, with
    the +-0.5 units verdict and that of improvements above 1 and 0 percent."""
    base = metrics.filter(c("model") == baseline).select(c("mae").alias("_base")).scalar()
    out = metrics.withColumns({"mae_change": c("mae") - base, "pct_change_vs_baseline": (c("mae") - base) / F.nullif(base, F.lit(0.0)) * 100})
    return out.withColumns({
        "verdict": F.when(c("mae_change") < -0.5, F.lit("better")).when(c("mae_change") > 0.5, F.lit("worse")).otherwise(F.lit("same")),
        "pct_verdict": F.when(c("pct_change_vs_baseline") < -1, F.lit("improved"))
                        .when(c("pct_change_vs_baseline") < 0, F.lit("marginal")).otherwise(F.lit("not improved"))})


@query("model_comparison", "M2 M3 M4 M5 M7 M8 M15 M16 M20")
def model_comparison_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge (alpha .5), OLS, lasso (alpha 1), random forest (100 x depth 10) and
    gradient boosting (100 x depth 5, step .1) on the same split; one metrics
    pass over the union of their test predictions; change vs ridge."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    facs = {
        "ridge": est.ridge(FEATURES, T, 0.5),
        "ols": est.ols(FEATURES, T),
        "lasso": est.lasso(FEATURES, T, 1.0),
        "random_forest": est.random_forest(FEATURES, T, 100, 10),
        "gradient_boosting": est.gradient_boosting(FEATURES, T, 100, 5, 0.1),
    }
    return _with_change(est.compare_models(train, test, facs, KEY, T), "ridge")


@query("ensemble_model", "M9 M15")
def ensemble_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted ensemble .5 ridge + .25 forest + .25 boosting; the models score one after the other, without a join."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    models = {
        "ridge": est.fit(train, est.ridge(FEATURES, T, 0.5)),
        "random_forest": est.fit(train, est.random_forest(FEATURES, T)),
        "gradient_boosting": est.fit(train, est.gradient_boosting(FEATURES, T)),
    }
    weights = {"ridge": 0.5, "random_forest": 0.25, "gradient_boosting": 0.25}
    return _metrics(est.ensemble(models, weights, test, [*KEY, T]), "ensemble")


@query("segment_models", "M10 M15", om.SEGMENTS)
def segment_models_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate ridge models for starters and relievers, fitted and scored in one pass each; per-segment and overall metrics."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    models = gram.ridge_by(gram.moments_by(train, [*FEATURES, T], ["is_starter"]), ["is_starter"], 0.5)
    scored = gram.score_by(test, models, ["is_starter"], FEATURES, [T]).withColumnRenamed(T, "actual")
    per = regression_metrics(scored.withColumn("segment", F.concat(F.lit("is_starter="), c("is_starter").cast("string"))), group=["segment"])
    return per.unionByName(regression_metrics(scored.withColumn("segment", F.lit("segmented")), group=["segment"]))


@query("cross_validation", "M12 M15", om.CROSS_VALIDATION)
def cross_validation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-fold CV of ridge on hash folds: train/test MAE, RMSE, R^2 per fold,
    their mean/std/min/max and the stability class (std of test R^2 < .05 / < .1)."""
    df = model_table(spark, sf_dir)
    held = _held(df, "fold")
    models = {str(k): (gram.ridge(gram.total(held, lambda key: key != (k,)), 0.5), FEATURES) for k in range(5) if any(key != (k,) for key in held)}
    scored = gram.score_all(df, models, T, ["fold"], "left_out") if models else df.select(F.lit("").alias("left_out"), "fold", c(T).alias("actual"), c(T).alias("predicted"))
    part = F.when(c("fold") == c("left_out").cast("int"), F.lit("test")).otherwise(F.lit("train"))
    per_fold = regression_metrics(scored.withColumn("part", part), group=["left_out", "part"])
    long = per_fold.unpivot(["left_out", "part"], ["mae", "rmse", "r2"], "metric", "value")
    summary = long.groupBy("part", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return summary.withColumn("stability", F.when(c("metric") != "r2", F.lit(None).cast("string"))
                              .when(c("std") < 0.05, F.lit("very stable"))
                              .when(c("std") < 0.1, F.lit("stable")).otherwise(F.lit("variable")))


@query("learning_curve", "M13 M14", om.LEARNING_CURVE)
def learning_curve_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge (alpha 1) test MAE for nested training shares .3-.8 against one fixed
    test split; percent improvement per step; the MAE projected at 500, 1000 and 2000
    rows from the mean improvement per 100 rows (NULL below the present size); and
    whether the last step gains less than the first.  The shares are unions of the same hash buckets' moments."""
    df = model_table(spark, sf_dir)
    held = _held(df, "bucket")
    fits = {share: gram.total(held, lambda key: 20 <= key[0] < 20 + share * 80) for share in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)}
    fits = {share: m for share, m in fits.items() if m is not None}
    rows = _compared(df.filter(c("split") == "test"), {str(share): (gram.ridge(m, 1.0), FEATURES) for share, m in fits.items()}, "train_share")
    sizes = F.create_map(*[F.lit(x) for share, m in fits.items() for x in (str(share), int(m.n))])
    rows = rows.withColumns({"model": F.lit("ridge"), "train_rows": sizes[c("train_share")].cast("long"), "train_share": c("train_share").cast("double")})
    w = Window.orderBy("train_share")  # six rows
    last, size = F.lag("mae").over(w), F.lag("train_rows").over(w)
    gain = (last - c("mae")) / F.nullif(last, F.lit(0.0)) * 100
    out = rows.withColumns({
        "mae_decrease": last - c("mae"), "improvement_pct": gain,
        "improvement_pct_per_100": gain / F.nullif(c("train_rows") - size, F.lit(0)) * 100}).checkpoint(eager=True)
    now = out.agg(F.avg("improvement_pct_per_100").alias("rate"), F.max_by("mae", "train_share").alias("mae"),
                  F.min_by("mae_decrease", F.when(c("mae_decrease").isNotNull(), c("train_share"))).alias("first"),
                  F.max_by("mae_decrease", "train_share").alias("last")).first()
    have = sum(m.n for m in held.values())
    for goal in (500, 1000, 2000):
        value = now["mae"] * (1 - now["rate"] * (goal - have) / 100 / 100) if goal > have and now["rate"] is not None else None
        out = out.withColumn(f"projected_mae_at_{goal}", F.lit(value).cast("double"))
    falling = None not in (now["last"], now["first"]) and now["last"] < now["first"]
    return out.withColumn("returns", F.lit("diminishing" if falling else "stable"))


@query("feature_importance", "M17")
def feature_importance_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-forest importances of the 58 features, ranked, with the ridge |coefficient| rank,
    the engineered-feature flag and how many of them are among the first 20."""
    df = model_table(spark, sf_dir)
    train, _ = _train_test(df)
    rf = est.importances(est.fit(train, est.random_forest(FEATURES, T)), FEATURES, ENGINEERED)
    rd = {f: r for f, _, r, _ in est.importances(est.fit(train, est.ridge(FEATURES, T, 0.5)), FEATURES)}
    new_in_top = sum(new for _, _, rank, new in rf if rank <= 20)
    rows = [(f, imp, rank, rd[f], int(rank <= 20), new, new_in_top) for f, imp, rank, new in rf]
    return spark.createDataFrame(rows, "feature string, importance double, rank int, ridge_rank int, in_top20 int, "
                                       "is_new int, new_in_top20 int")


def _by_coefficient(model: gram.Linear, m: gram.Moments, threshold: float = 0.0) -> list[str]:
    """Features whose standardised coefficient exceeds ``threshold``, largest first."""
    w = abs(gram.standardised(model, m)).tolist()
    return [FEATURES[i] for i in sorted(range(len(FEATURES)), key=lambda i: (-w[i], FEATURES[i])) if w[i] > threshold]


def _at(features: list[str]) -> list[int]:
    """Places of features, and of the label, in the moments of all features."""
    return [*[FEATURES.index(f) for f in features], len(FEATURES)]


def _first_sizes(order: list[str]) -> list[int]:
    return sorted({min(n, len(order)) for n in (*range(10, 51, 5), len(order))})


def _sweep(test: DataFrame, m: gram.Moments, order: list[str]) -> DataFrame:
    """Ridge on the first N of ``order`` for N = 10, 15 .. 50 and all; N = 0, if there are none, predicts the mean."""
    models = {str(n): (gram.ridge(m.take(_at(order[:n])), 0.5), order[:n]) for n in _first_sizes(order)}
    rows = _compared(test, models, "top_n").withColumns({"model": F.lit("ridge"), "top_n": c("top_n").cast("int")})
    best = rows.agg(F.min_by("top_n", F.struct("mae", "top_n")).alias("b")).select("b").scalar()
    return rows.withColumn("is_best", (c("top_n") == best).cast("int"))


@query("lasso_selection", "M5 M18")
def lasso_selection_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasso (alpha 1) keeps features with |coef| > .01 on standardised inputs; ridge refit on them."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    m = gram.total(_held(train))
    chosen = set(_by_coefficient(gram.lasso_path(m, [1.0])[0], m, 0.01))
    kept = [f for f in FEATURES if f in chosen]
    out = _compared(test, {"lasso_selected_ridge": (gram.ridge(m.take(_at(kept)), 0.5), kept)})
    return out.withColumns({"n_selected": F.lit(len(kept)), "selected": F.lit(",".join(kept))})


@query("alpha_sweep", "M11 T4", om.ALPHA_SWEEP)
def alpha_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge test MAE for alpha in .1 .5 1 2 5 10, all from the same moments and scored in one pass; the best is flagged."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    m = gram.total(_held(train))
    rows = _compared(test, {str(a): (gram.ridge(m, a), FEATURES) for a in (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)}, "alpha")
    rows = rows.withColumns({"model": F.lit("ridge"), "alpha": c("alpha").cast("double")}).checkpoint(eager=True)
    best = best_by(rows, "mae", tie=["alpha"]).select("alpha").scalar()
    return rows.withColumn("is_best", (c("alpha") == best).cast("int"))


LASSO_ALPHAS = [10 ** (-3 + 5 * i / 49) for i in range(50)]


@query("lasso_cv", "M6")
def lasso_cv_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasso alpha of least squared error by 5-fold CV over 50 log-spaced values (1e-3..1e2), from the folds' moments."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    errors, model, best = gram.lasso_cv(_held(train, "fold"), LASSO_ALPHAS)
    m = _compared(test, {"lasso_cv": (model, FEATURES)})
    return m.withColumns({"best_alpha": F.lit(LASSO_ALPHAS[best]), "cv_mse": F.lit(errors[best]),
                          "n_nonzero": F.lit(int((model.coef != 0).sum()))})


@query("topn_feature_sweep", "M19")
def topn_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on the first N features by |coefficient| of the cross-validated lasso,
    N = 10, 15 .. 50 and all that are not zero; best N flagged.  If all are zero, N = 0 predicts the training mean."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    held = _held(train, "fold")
    m = gram.total(held)
    return _sweep(test, m, _by_coefficient(gram.lasso_cv(held, LASSO_ALPHAS)[1], m))


@query("topn_path_sweep", "M19")
def topn_path_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sweep over the lasso of the least alpha (1e-3), which keeps enough features for all sizes."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    m = gram.total(_held(train))
    return _sweep(test, m, _by_coefficient(gram.lasso_path(m, LASSO_ALPHAS[:1])[0], m))


#: The base features are compared over so many last seasons.
LAST_SEASONS = (5, 7, 11)


def _seasons_comparison(panel: DataFrame, df: DataFrame) -> DataFrame:
    """Ridge with the base features on the last 5, 7 and 11 seasons of ``panel``, each fitted on and scored over
    its own seasons' split of the model table ``df``; change vs the fewest.  The training sets are unions of the seasons' moments."""
    latest = panel.agg(F.max("season")).first()[0] or 0
    train, test = _train_test(df)
    held = _held(train, "season")
    models = {n: (gram.ridge(m, 0.5), FEATURES) for n in LAST_SEASONS if (m := gram.total(held, lambda key: key[0] > latest - n)) is not None}
    scored = gram.score_all(test, {str(n): model for n, model in models.items()}, T, ["season"], "last")
    own = scored.where(c("season") > latest - c("last").cast("int"))
    rows = regression_metrics(own.withColumn("model", F.concat(F.lit("base, last "), "last", F.lit(" seasons"))), group=["model"])
    return _with_change(rows.withColumn("n_features", F.lit(len(FEATURES))), f"base, last {LAST_SEASONS[0]} seasons")


@query("feature_set_comparison", "M21 J8")
def feature_sets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on the same split with the 58 base features, + 31 momentum, + 10 selective momentum, + 7 availability,
    + 11 pitch-mix; and with the base features over fewer against more seasons."""
    # the panel is built once, and its features and the join once: statistics, medians and both model tables read the landed rows
    ensure_checkpoint_dir(spark)
    panel = season_panel(spark, sf_dir).checkpoint(eager=True)
    enriched = injury_features(momentum_features(panel, SPEC), SPEC)
    side = pitch_side(spark, sf_dir)
    joined = left_join_normalized(enriched, side, name="full_name", period="season").checkpoint(eager=True)
    enriched = median_impute(joined, PITCH_COLS)
    sets = {
        "base": FEATURES,
        "base+momentum": FEATURES + MOMENTUM_FEATURES,
        "base+selective": FEATURES + SELECTIVE,
        "base+availability": FEATURES + AVAILABILITY_FEATURES,
        "base+pitch_mix": FEATURES + PITCH_COLS,
    }
    all_feats = list(dict.fromkeys(x for v in sets.values() for x in v))
    df = model_table(spark, sf_dir, extra=enriched, features=all_feats)
    train, test = _train_test(df)
    m = gram.total(_held(train, features=all_feats))
    models = {name: (gram.ridge(m.take([*[all_feats.index(f) for f in feats], len(all_feats)]), 0.5), feats) for name, feats in sets.items()}
    widths = F.create_map(*[F.lit(x) for name, feats in sets.items() for x in (name, len(feats))])
    rows = _compared(test, models).withColumn("n_features", widths[c("model")]).checkpoint(eager=True)
    return _with_change(rows, "base").unionByName(_seasons_comparison(panel, model_table(spark, sf_dir, extra=panel)))


@query("main_projection_rf", "R1 M7 M22 W21")
def main_projection_rf_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship projection with the random forest fitted on all labelled rows
    whose features are complete; every row of the latest season is scored, missing features
    with their median over the season panel."""
    from panelcast.operators.project import project
    ensure_checkpoint_dir(spark)
    panel = season_panel(spark, sf_dir).checkpoint(eager=True)     # built once, for the model table and the scored rows
    df = model_table(spark, sf_dir, extra=panel)
    model = est.fit(df, est.random_forest(FEATURES, T))
    latest = panel.agg(F.max("season").alias("s")).select("s").scalar()
    med = column_medians(panel, FEATURES)
    current = panel.filter(c("season") == latest).withColumns({x: F.coalesce(c(x).cast("double"), med[x], F.lit(0.0)) for x in FEATURES})
    # materialise the forest's scores once: ranking samples and re-reads its input
    scored = model.transform(current).drop("features", "raw_features").checkpoint(eager=True)
    return project(scored, SPEC)


@query("model_persistence", "S7 M22", om.PERSISTENCE)
def persistence_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save the fitted pipeline (scaler + model + feature order) to the checkpoint folder,
    load it back and check the reloaded model scores identically."""
    df = model_table(spark, sf_dir)
    train, test = _train_test(df)
    model = est.fit(train, est.ridge(FEATURES, T, 0.5))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/ridge-{uuid.uuid4().hex}"
    est.save(model, path)
    again = est.load(path)
    a = est.score(model, test, KEY).withColumnRenamed("predicted", "p1")
    b = est.score(again, test, KEY).withColumnRenamed("predicted", "p2")
    return a.join(b, KEY).agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(c("p1") - c("p2"))).alias("max_abs_diff"))

