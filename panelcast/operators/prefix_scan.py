"""Career measures of long careers (W2, W7-W11, W14-W18) as segmented prefix scans.

``windows.py`` gives an entity to one task, which suits careers of tens of periods.  Here an
entity's periods are range-split into pieces, and each piece is scanned by itself:

1. rows are range-partitioned by (entity, period, tie) and checkpointed, so that a lost executor
   cannot move a row to another piece; a piece is an entity's rows in one partition;
2. a window a piece gives its running states: row number, maximum, count, mean and sum of squares
   about the mean;
3. the states at the ends of the pieces, one row a piece, are combined in order for the entities that
   have several; these have at most two pieces a partition, so the table is bounded by the
   number of partitions and is broadcast;
4. each row combines its own state with the state before its piece.

Sums of squares are combined about an entity's first piece's mean, which keeps their digits at
any offset.  NULL values leave a state as it is.  Entities may be NULL, and form one career.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.exprs import flag
from panelcast.session import ensure_checkpoint_dir
from panelcast.spec import DEFAULT_SPEC, NEVER_GAPPED, PanelSpec

c = F.col
PIECE = "_piece"


def split_careers(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, pieces: int | None = None) -> DataFrame:
    """``df`` checkpointed with its piece's number; ``pieces`` partitions, as many as a shuffle's by default."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, spec.entity, spec.period, *spec.tie).withColumn(PIECE, F.spark_partition_id()).checkpoint(eager=True)


def _several(ends: DataFrame, spec: PanelSpec) -> DataFrame:
    """The pieces of entities that have more than one."""
    return ends.withColumn("_pieces", F.count(F.lit(1)).over(Window.partitionBy(spec.entity))).filter(c("_pieces") > 1).drop("_pieces")


def _attach(df: DataFrame, before: DataFrame, spec: PanelSpec) -> DataFrame:
    """``df`` with the states before each piece, NULL where there is none."""
    other = before.withColumnsRenamed({spec.entity: "_entity", PIECE: "_before"})
    same = (c("_before") == c(PIECE)) & c(spec.entity).eqNullSafe(c("_entity"))
    return df.join(F.broadcast(other), same, "left").drop("_entity", "_before")


def row_numbers_and_lags(df: DataFrame, lags: Mapping[str, tuple[str, int]], number: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """``df`` of ``split_careers`` with each row's number in its career, and lags: name -> (column, rows back)."""
    w = Window.partitionBy(spec.entity, PIECE).orderBy(spec.period, *spec.tie)
    deepest = max((k for _, k in lags.values()), default=0)
    sources = sorted({src for src, _ in lags.values()})
    row = F.struct(*[c(s).alias(f"c{i}") for i, s in enumerate(sources)], F.lit(0).alias("z"))
    at = {s: f"c{i}" for i, s in enumerate(sources)}
    own = df.withColumn("_n", F.row_number().over(w).cast("long"))
    # the last rows of a piece, latest first
    tail = F.filter(F.array(row, *[F.lag(row, i).over(w) for i in range(1, deepest)]), lambda r: r.isNotNull())
    ends = (df.withColumn("_tail", tail) if deepest else df).groupBy(spec.entity, PIECE).agg(
        F.count(F.lit(1)).alias("_size"), *([F.max_by("_tail", F.struct(spec.period, *spec.tie)).alias("_tail")] if deepest else []))
    along = Window.partitionBy(spec.entity).orderBy(PIECE)
    ends = _several(ends, spec)
    if deepest:
        # a piece has a row at least, so ``deepest`` pieces hold enough of them
        tails = [F.coalesce(F.lag("_tail", i + 1).over(along), F.array().cast(ends.schema["_tail"].dataType)) for i in range(deepest)]
        ends = ends.withColumn("_halo", F.slice(F.concat(*tails), 1, deepest))
    before = ends.withColumn("_offset", F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1))).drop("_size", "_tail")
    out = _attach(own, before, spec)
    for name, (src, k) in lags.items():
        halo = F.get(c("_halo"), (F.lit(k) - c("_n")).cast("int"))[at[src]]
        out = out.withColumn(name, F.when(c("_n") > k, F.lag(c(src), k).over(w)).otherwise(halo))
    return out.withColumn(number, c("_n") + F.coalesce(c("_offset"), F.lit(0).cast("long"))).drop("_n", "_offset", *(["_halo"] if deepest else []))


def running_extremes(df: DataFrame, highest: Mapping[str, Column], lowest: Mapping[str, Column], spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """``df`` of ``split_careers`` with running maxima and minima of the given expressions."""
    w = Window.partitionBy(spec.entity, PIECE).orderBy(spec.period, *spec.tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(spec.entity).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    every = {**{n: (F.max, F.greatest, x) for n, x in highest.items()}, **{n: (F.min, F.least, x) for n, x in lowest.items()}}
    ends = _several(df.groupBy(spec.entity, PIECE).agg(*[f(x).alias(n) for n, (f, _, x) in every.items()]), spec)
    before = ends.select(spec.entity, PIECE, *[f(n).over(along).alias(f"_{n}_before") for n, (f, _, _) in every.items()])
    own = df.withColumns({n: f(x).over(w) for n, (f, _, x) in every.items()})
    out = _attach(own, before, spec)
    return out.withColumns({n: pick(c(n), c(f"_{n}_before")) for n, (_, pick, _) in every.items()}).drop(*[f"_{n}_before" for n in every])


def running_moments(df: DataFrame, values: Mapping[str, str], spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """``df`` of ``split_careers`` with a struct (n, mean, m2) for each name: the count, the mean and the sum of
    squares about the mean of a column's values so far."""
    w = Window.partitionBy(spec.entity, PIECE).orderBy(spec.period, *spec.tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    career = Window.partitionBy(spec.entity).orderBy(PIECE)
    along = career.rowsBetween(Window.unboundedPreceding, -1)

    def state(src, over=None):
        parts = [F.count(c(src)), F.avg(c(src).cast("double")), F.var_pop(c(src).cast("double"))]
        n, mean, var = [p.over(over) for p in parts] if over is not None else parts
        return F.struct(n.alias("n"), mean.alias("mean"), (var * n).alias("m2"))

    ends = _several(df.groupBy(spec.entity, PIECE).agg(*[state(src).alias(n) for n, src in values.items()]), spec)
    before = ends
    for name in values:
        s = c(name)
        # sums about the first known mean of the career
        centre = F.first(s["mean"], ignorenulls=True).over(career.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        before = before.withColumn("_centre", centre).withColumn("_off", s["mean"] - c("_centre"))
        n = F.sum(s["n"]).over(along)
        s1, s2 = F.sum(s["n"] * c("_off")).over(along), F.sum(s["m2"] + s["n"] * c("_off") * c("_off")).over(along)
        before = before.withColumn(f"_{name}_before", F.when(n > 0, F.struct(
            n.alias("n"), (c("_centre") + s1 / n).alias("mean"), F.greatest(s2 - s1 * s1 / n, F.lit(0.0)).alias("m2"))))
    before = before.select(spec.entity, PIECE, *[f"_{n}_before" for n in values])
    out = _attach(df.withColumns({n: state(src, w) for n, src in values.items()}), before, spec)
    for name in values:
        a, b = c(f"_{name}_before"), c(name)
        total, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(total.alias("n"), (a["mean"] + gap * b["n"] / total).alias("mean"),
                        (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / total).alias("m2"))
        out = out.withColumn(name, F.when(a.isNull(), b).when(b["n"] == 0, a).otherwise(both))
    return out.drop(*[f"_{n}_before" for n in values])


def long_career_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, pieces: int | None = None) -> DataFrame:
    """``df`` with the career measures of ``windows.py`` for careers of any length: previous count and rate, career highs,
    experience, the rate's mean and deviation over three periods, and the availability block."""
    taken = [x for x in (PIECE, "_p1", "_p2", "_prev", "_rn", "_first", "_start", "_broken", "_moments") if x in df.columns]
    if taken:
        raise ValueError(f"columns in use: {taken}")
    rate, k, p = c(spec.rate).cast("double"), c(spec.count), c(spec.period)
    out = row_numbers_and_lags(split_careers(df, spec, pieces), {
        "_prev": (spec.period, 1), "prev_total_k": (spec.count, 1), "_p1": (spec.rate, 1), "_p2": (spec.rate, 2)}, "_rn", spec)
    broken = c("_prev").isNotNull() & (p - c("_prev") != 1)
    out = running_extremes(out, {
        "career_high_k": k, "career_high_k9": c(spec.rate),
        "_start": F.when(c("_prev").isNull() | broken, c("_rn")), "_broken": F.when(broken, c("_prev"))}, {"_first": p}, spec)
    out = running_moments(out, {"_moments": spec.exposure}, spec)
    three = F.filter(F.array(rate, c("_p1").cast("double"), c("_p2").cast("double")), lambda x: x.isNotNull())
    n = F.size(three)
    mean = F.aggregate(three, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    off = F.aggregate(three, F.lit(0.0), lambda s, x: s + (x - c("k9_3yr_avg")) * (x - c("k9_3yr_avg")))
    span, m = p - c("_first"), c("_moments")
    missed = flag((p - c("_prev")) > 1)
    return out.withColumn("k9_3yr_avg", mean).withColumns({
        "k9_rolling_std": F.when(n > 1, F.sqrt(off / F.nullif(n - 1, F.lit(0)))),
        "career_high_k": F.when(k.isNotNull(), c("career_high_k")),
        "career_high_k9": F.when(c(spec.rate).isNotNull(), c("career_high_k9")),
        "years_experience": c("_rn"),
        "missed_previous_season": missed,
        "consecutive_active_years": (c("_rn") - c("_start") + 1).cast("long"),
        "years_since_injury": F.coalesce((p - c("_broken") - 1).cast("long"), F.lit(NEVER_GAPPED).cast("long")),
        "career_availability_rate": F.when(span > 0, c("_rn") / (span + 1)).otherwise(F.lit(1.0)),
        "ip_volatility": F.when(c("_rn") >= 3, F.sqrt(m["m2"] / F.nullif(m["n"], F.lit(0)))).otherwise(F.lit(0.0)),
        "coming_back_from_injury": missed,
    }).drop(PIECE, "_p1", "_p2", "_prev", "_rn", "_first", "_start", "_broken", "_moments")
