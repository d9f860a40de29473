"""Exact quantiles without holding a column in one task or on the driver.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, which does not survive a 100 TB column.  Here the exact
linear-interpolated quantile (pandas' default, SQL ``quantile_cont``) of any
number of columns and probabilities is found by selection:

0. the value columns alone are materialised once (reliable checkpoint);
1. every wanted rank starts with the open interval of all values.  While more
   than ``LIMIT`` values are in its interval, one aggregation proposes two pivots around the
   rank (``percentile_approx`` within the interval) and another counts the values
   below, at, between and above them.  The rank is at a pivot, which settles
   it, or in one of the three open intervals, which replaces the old one;
2. the values of the intervals that are left, at most ``LIMIT`` each, are
   collected, and the ranks floor(q(n-1)) and ceil(q(n-1)) read off.

So the driver gets at most ``LIMIT`` values a rank, whatever the number of rows, and
heavy ties settle at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

c = F.col

DEFAULT_ACCURACY = 10_000
LIMIT = 1_000


@dataclass
class _Rank:
    """A wanted rank (from 0) of column ``v<i>`` within the open interval."""
    i: int
    rank: int
    size: int                       # values in the interval
    base: int = 0                   # values below it
    above: float | None = None      # the interval's ends, None where it is open-ended
    below: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        v = c(f"v{self.i}")
        cond = v.isNotNull()
        if self.above is not None:
            cond = cond & (v > F.lit(self.above))
        if self.below is not None:
            cond = cond & (v < F.lit(self.below))
        return cond

    def narrow(self, pivots: tuple[float, float], counts: Sequence[int]) -> None:
        """``counts``: values below, at the first pivot, between, at the second."""
        lo, hi = pivots
        under, at_lo, between, at_hi = counts
        r = self.rank - self.base
        if r < under:
            self.size, self.below = under, lo
        elif r < under + at_lo:
            self.value = lo
        elif r < under + at_lo + between:
            self.base, self.size, self.above, self.below = self.base + under + at_lo, between, lo, hi
        elif r < under + at_lo + between + at_hi:
            self.value = hi
        else:
            passed = under + at_lo + between + at_hi
            self.base, self.size, self.above = self.base + passed, self.size - passed, hi


def exact_quantiles(df: DataFrame, values: Mapping[str, Column | str], probs: Sequence[float],
                    accuracy: int = DEFAULT_ACCURACY) -> dict[tuple[str, float], float | None]:
    """Exact quantiles ``{(name, q): value}`` of each value expression (NULL/NaN ignored)."""
    names = list(values)
    if not names:
        return {}
    exprs = [F.col(f"`{v}`") if isinstance(v, str) else v for v in values.values()]
    vals = df.select(*[F.when(~F.isnan(e.cast("double")), e.cast("double")).alias(f"v{i}")
                       for i, e in enumerate(exprs)])
    # all scans read the narrow value columns from one reliable checkpoint
    # instead of recomputing the upstream plan
    ensure_checkpoint_dir(df.sparkSession)
    vals = vals.checkpoint(eager=True)
    counts = vals.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
    n = [counts[f"n{i}"] for i in range(len(names))]
    wanted = {(i, r): _Rank(i, r, n[i]) for i in range(len(names)) if n[i] for q in probs
              for r in (math.floor(q * (n[i] - 1)), math.ceil(q * (n[i] - 1)))}
    while open_ranks := [w for w in wanted.values() if w.value is None and w.size > LIMIT]:
        _narrow(vals, open_ranks, accuracy)
    _collect(vals, [w for w in wanted.values() if w.value is None])
    out: dict[tuple[str, float], float | None] = {}
    for i, name in enumerate(names):
        for q in probs:
            if not n[i]:
                out[name, q] = None
                continue
            pos = q * (n[i] - 1)
            lo, hi = wanted[i, math.floor(pos)].value, wanted[i, math.ceil(pos)].value
            out[name, q] = lo + (pos - math.floor(pos)) * (hi - lo)
    return out


def _neighbours(ranks: Sequence[_Rank]) -> list[list[_Rank]]:
    """Ranks of one interval that follow each other, as the two of a median do."""
    out: list[list[_Rank]] = []
    for w in sorted(ranks, key=lambda w: (w.i, w.rank)):
        last = out[-1][-1] if out else None
        if last and (last.i, last.above, last.below) == (w.i, w.above, w.below) and w.rank - last.rank <= 1:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def _narrow(vals: DataFrame, ranks: Sequence[_Rank], accuracy: int) -> None:
    """One pair of pivots for neighbouring ranks, whose sketch and counts they share."""
    delta = 2.0 / accuracy
    groups, proposed = _neighbours(ranks), []
    for k, near in enumerate(groups):
        w = near[0]
        first, last = ((r.rank - w.base + 0.5) / w.size for r in (w, near[-1]))
        ends = F.array(F.lit(max(first - delta, 0.0)), F.lit(min(last + delta, 1.0)))
        proposed.append(F.percentile_approx(F.when(w.inside(), c(f"v{w.i}")), ends, accuracy).alias(f"p{k}"))
    row = vals.agg(*proposed).first()
    pivots = [tuple(row[f"p{k}"]) for k in range(len(groups))]
    counted = []
    for k, (near, (lo, hi)) in enumerate(zip(groups, pivots)):
        v, inside = c(f"v{near[0].i}"), near[0].inside()
        for name, cond in (("a", v < lo), ("b", v == lo), ("c", (v > lo) & (v < hi)), ("d", (v == hi) & F.lit(hi > lo))):
            counted.append(F.count(F.when(inside & cond, 1)).alias(f"{name}{k}"))
    row = vals.agg(*counted).first()
    for k, near in enumerate(groups):
        for w in near:
            w.narrow(pivots[k], [row[f"{name}{k}"] for name in "abcd"])


def _collect(vals: DataFrame, ranks: Sequence[_Rank]) -> None:
    """Settle ranks whose intervals hold at most ``LIMIT`` values."""
    if not ranks:
        return
    items = [F.when(w.inside(), F.struct(F.lit(k).alias("k"), c(f"v{w.i}").alias("v"))) for k, w in enumerate(ranks)]
    rows = vals.select(F.explode(F.array_compact(F.array(*items))).alias("e")).select("e.*").collect()
    own: dict[int, list[float]] = {k: [] for k in range(len(ranks))}
    for k, v in rows:
        own[k].append(v)
    for k, w in enumerate(ranks):
        w.value = sorted(own[k])[w.rank - w.base]


def column_medians(df: DataFrame, columns: Sequence[str], accuracy: int = DEFAULT_ACCURACY) -> dict[str, Column]:
    """Exact medians of many columns in the same scans, as literal Columns."""
    res = exact_quantiles(df, {x: x for x in columns}, [0.5], accuracy)
    return {x: F.lit(res[(x, 0.5)]).cast("double") for x in columns}


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: Column | str, probs: Mapping[str, float],
                      partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` in every group of ``by``, a column for
    each of ``probs`` (name -> q).  NULL and NaN values are ignored, a NULL key is a group.

    Equal values of a group are counted first, so that ties shrink before the shuffle.  The counts
    are range-partitioned by (group, value): a large group lies in many pieces, and many small
    ones share a partition.  A group's piece sizes give its length and each piece's offset; only
    the pieces that hold a wanted rank are numbered.  Nothing reaches the driver.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    v = (c(f"`{value}`") if isinstance(value, str) else value).cast("double")
    group = F.struct(*[c(f"`{x}`") for x in by]).alias("_g")        # a struct, so that NULL keys are equal
    counted = (df.select(group, v.alias("_v")).where(c("_v").isNotNull() & ~F.isnan("_v"))
               .groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counted.repartitionByRange(n, "_g", "_v").withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    # at most one row a group and one a partition more
    pieces = ranged.groupBy("_g", "_part").agg(F.sum("_n").alias("_size"))
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"_total": F.sum("_size").over(whole),
                                 "_offset": F.coalesce(F.sum("_size").over(before), F.lit(0))})
    at = {name: F.lit(float(q)) * (c("_total") - 1) for name, q in probs.items()}
    ranks = F.array(*[r for x in at.values() for r in (F.floor(x), F.ceil(x))])
    held = pieces.where(F.exists(ranks, lambda r: (r >= c("_offset")) & (r < c("_offset") + c("_size"))))
    within = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.join(held, ["_g", "_part"]).withColumn("_upto", c("_offset") + F.sum("_n").over(within))

    def at_rank(r: Column) -> Column:
        return F.max(F.when((r < c("_upto")) & (r >= c("_upto") - c("_n")), c("_v")))

    found = numbered.groupBy("_g", "_total").agg(
        *[at_rank(f(x)).alias(f"_{side}{i}") for i, x in enumerate(at.values())
          for side, f in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(*[c("_g").getField(x).alias(x) for x in by],
                        *[F.when(c(f"_lo{i}") == c(f"_hi{i}"), c(f"_lo{i}"))
                          .otherwise(c(f"_lo{i}") + (x - F.floor(x)) * (c(f"_hi{i}") - c(f"_lo{i}"))).alias(name)
                          for i, (name, x) in enumerate(at.items())])
