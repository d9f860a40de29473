"""Profiling aggregations.

All are single aggregation passes with map-side partial aggregation; wide
summaries are unpivoted into long rows.  Exact quantiles use the bounded
two-step algorithm of ``quantiles.py``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.composite import scalars
from panelcast.operators.quantiles import exact_quantiles
from panelcast.spec import DEFAULT_SPEC, PanelSpec

c = F.col


def group_mean(df: DataFrame, by: str, metric: str) -> DataFrame:
    """A1: mean of ``metric`` per ``by`` value (aging curve)."""
    return df.groupBy(by).agg(F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n"))


def group_peak(df: DataFrame, by: str, metric: str) -> DataFrame:
    """A2: the group with the highest mean (ties -> smallest key) and that mean."""
    curve = group_mean(df, by, metric)
    m = f"mean_{metric}"
    return curve.agg(F.max_by(c(by), F.struct(c(m), -c(by))).alias(f"peak_{by}"), F.max(m).alias(f"peak_{m}"))


def flag_group_stats(df: DataFrame, flags: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A3: mean of each metric within each (overlapping) flag group, one pass."""
    aggs = [F.count(F.when(c(f) == 1, 1)).alias(f"{f}__n") for f in flags]
    aggs += [F.avg(F.when(c(f) == 1, c(m))).alias(f"{f}__{m}") for f in flags for m in metrics]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("group"), c(f"{f}__n").alias("n"),
                     *[c(f"{f}__{m}").alias(f"mean_{m}") for m in metrics]) for f in flags]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dataset_size(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows, rows with and without target, distinct entities, period range."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(c(spec.target)).alias("with_target"),
        F.count(F.when(c(spec.target).isNull(), 1)).alias("without_target"),
        F.countDistinct(spec.entity).alias("distinct_entities"),
        F.min(spec.period).alias("first_period"),
        F.max(spec.period).alias("last_period"),
    )


def rows_per_period(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A5."""
    return df.groupBy(spec.period).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column (long)."""
    aggs = []
    for x in columns:
        aggs += [F.count(x).alias(f"{x}__count"), F.avg(x).alias(f"{x}__mean"),
                 F.stddev_samp(x).alias(f"{x}__std"), F.min(x).cast("double").alias(f"{x}__min"),
                 F.max(x).cast("double").alias(f"{x}__max")]
    wide = df.agg(*aggs)
    qs = exact_quantiles(df, {x: x for x in columns}, [0.25, 0.5, 0.75])
    wide = wide.withColumns({f"{x}__q{int(q * 100)}": F.lit(qs[(x, q)]).cast("double")
                             for x in columns for q in (0.25, 0.5, 0.75)})
    fields = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    rows = [F.struct(F.lit(x).alias("column_name"), *[c(f"{x}__{f}").alias(f) for f in fields]) for x in columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def flag_share(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Count and percent of rows with each flag set."""
    wide = df.agg(*[F.sum(c(f)).cast("bigint").alias(f"{f}__n") for f in flags],
                  *[(F.avg(c(f)) * 100).alias(f"{f}__pct") for f in flags])
    rows = [F.struct(F.lit(f).alias("flag"), c(f"{f}__n").alias("n"), c(f"{f}__pct").alias("pct")) for f in flags]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pairwise_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r for many column pairs over pairwise-complete rows (NULL-safe).

    Each task reduces its rows to the six sufficient sums of every pair
    (n, sum a, sum b, sum a^2, sum b^2, sum ab) with numpy matrix products --
    the Gram-matrix pass of a correlation matrix -- and yields one array per
    partition; Spark adds the arrays position-wise (map-side combined) and
    finishes r per pair.  One scan, one small shuffle, no per-pair expression
    tree for the optimiser.  Result: feature_a, feature_b, r (NULL when a side
    is constant or fewer than two rows are complete).
    """
    import numpy as np
    import pandas as pd

    cols = sorted({x for p in pairs for x in p})
    idx = {x: i for i, x in enumerate(cols)}
    ia = np.array([idx[a] for a, _ in pairs])
    ib = np.array([idx[b] for _, b in pairs])
    n_stats = 6

    def moments(batches):
        acc = np.zeros((len(pairs), n_stats))
        for pdf in batches:
            v = pdf[cols].to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(v)
            v0 = np.where(m, v, 0.0)
            mf = m.astype("float64")
            mm = mf.T @ mf
            vm = v0.T @ mf
            v2m = (v0 * v0).T @ mf
            vv = v0.T @ v0
            acc[:, 0] += mm[ia, ib]
            acc[:, 1] += vm[ia, ib]
            acc[:, 2] += vm[ib, ia]
            acc[:, 3] += v2m[ia, ib]
            acc[:, 4] += v2m[ib, ia]
            acc[:, 5] += vv[ia, ib]
        yield pd.DataFrame({"m": [acc.ravel()]})

    # sums of squares of raw values lose their digits where a mean is far from
    # zero, so the columns' means are taken off first (r does not depend on them)
    values = df.select(*[c(f"`{x}`").cast("double").alias(x) for x in cols])
    means = values.agg(*[F.avg(F.when(~F.isnan(c(f"`{x}`")), c(f"`{x}`"))).alias(x) for x in cols]).first()
    centred = values.select(*[(c(f"`{x}`") - F.lit(means[x] or 0.0)).alias(x) for x in cols])
    parts = centred.mapInPandas(moments, "m array<double>")
    sums = (parts.select(F.posexplode("m").alias("pos", "v"))
            .groupBy((c("pos") / n_stats).cast("int").alias("k"))
            .agg(*[F.sum(F.when(c("pos") % n_stats == s_, c("v"))).alias(name)
                   for s_, name in enumerate(["n", "sa", "sb", "saa", "sbb", "sab"])]))
    cov = c("sab") - c("sa") * c("sb") / c("n")
    va = c("saa") - c("sa") * c("sa") / c("n")
    vb = c("sbb") - c("sb") * c("sb") / c("n")
    r = F.when((c("n") >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    names = df.sparkSession.createDataFrame(
        [(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, feature_a string, feature_b string")
    return sums.select("k", r.alias("r")).join(F.broadcast(names), "k").select("feature_a", "feature_b", "r")


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson r of each feature with the target (pairwise-complete rows), one pass."""
    out = pairwise_correlations(df, [(f, target) for f in features])
    return out.select(c("feature_a").alias("feature"), "r", F.abs("r").alias("abs_r"))


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """A10: feature pairs with |r| above the threshold, from one moments pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    return pairwise_correlations(df, pairs).filter(F.abs("r") > threshold)


def quadratic_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares y = a x^2 + b x + c from moment sums (one pass), 3x3
    normal equations solved by Cramer's rule in column expressions.  ``x`` is
    centred on its mean first for numerical stability."""
    d = df.select(c(x).cast("double").alias("x"), c(y).cast("double").alias("y")).filter(
        c("x").isNotNull() & c("y").isNotNull())
    mean_x = scalars(d.agg(F.avg("x").alias("m")))["m"]
    t = d.select((c("x") - mean_x).alias("u"), "y")
    u, yv = c("u"), c("y")
    s = t.agg(F.count(F.lit(1)).cast("double").alias("s0"), F.sum(u).alias("s1"),
              F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
              F.sum(yv).alias("t0"), F.sum(u * yv).alias("t1"), F.sum(u * u * yv).alias("t2"))
    s0, s1, s2, s3, s4, t0, t1, t2 = (c(k) for k in ["s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"])

    def det3(a11, a12, a13, a21, a22, a23, a31, a32, a33):
        return a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31)

    # normal equations in the centred variable u: [s4 s3 s2; s3 s2 s1; s2 s1 s0] [A B C]' = [t2 t1 t0]'
    # fewer than three distinct x: what is left of the determinant is rounding error
    raw = det3(s4, s3, s2, s3, s2, s1, s2, s1, s0)
    det = F.when(F.abs(raw) > 1e-12 * s4 * s2 * s0, raw)
    a = det3(t2, s3, s2, t1, s2, s1, t0, s1, s0) / det
    b = det3(s4, t2, s2, s3, t1, s1, s2, t0, s0) / det
    cc = det3(s4, s3, t2, s3, s2, t1, s2, s1, t0) / det
    out = s.select(a.alias("qa"), b.alias("qb"), cc.alias("qc"), mean_x.alias("mx"))
    # back to the original variable: y = A(x-m)^2 + B(x-m) + C
    return out.select(
        c("qa").alias("coef_x2"),
        (c("qb") - 2 * c("qa") * c("mx")).alias("coef_x"),
        (c("qa") * (c("mx") * c("mx")) - c("qb") * c("mx") + c("qc")).alias("intercept"),
    )


def periods_per_entity(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Sorted distinct periods per entity (as a list and a comma string)."""
    return df.groupBy(spec.entity).agg(F.sort_array(F.collect_set(spec.period)).alias("periods")).select(
        spec.entity, F.size("periods").alias("n_periods"), F.concat_ws(",", c("periods").cast("array<string>")).alias("periods"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max; the top edge
    belongs to the last bin.  Empty bins are omitted."""
    st = scalars(df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))
    lo, hi = st["lo"], st["hi"]
    width = (hi - lo) / bins
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((c(column) - lo) / width), F.lit(bins - 1))).cast("int")
    binned = df.filter(c(column).isNotNull()).select(idx.alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (lo + c("bin") * width).alias("bin_start"), (lo + (c("bin") + 1) * width).alias("bin_end"), "n")


def split_stats(df: DataFrame, split_col: str, target: str) -> DataFrame:
    """Target count, mean and sample std per split."""
    return df.groupBy(split_col).agg(F.count(c(target)).alias("n"), F.avg(target).alias("mean_target"),
                                     F.stddev_samp(target).alias("std_target"))
