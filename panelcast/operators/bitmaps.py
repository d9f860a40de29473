"""Career bitmaps: an entity's periods as the bits of one long.

One hash aggregate per entity keeps the first and last period and the OR of one
bit a period, the period modulo 64; it combines before the shuffle, and ships one row an
entity and task however long the panel is.  Turned by the last period, bit k of the result says whether the
entity was there k periods before its last.  Absence, streaks and gaps are then bit operations
on a table with one row per entity, without a sort.

A career of 64 periods or more does not fit in the bits: its ``bits`` is NULL, and
``career_shape`` reads the same measures for it from windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir
from panelcast.spec import DEFAULT_SPEC, PanelSpec

c = F.col
WIDTH = 64


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _right(x: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, k.cast("int"))


def _turned(bits: Column, last: Column) -> Column:
    """Bit k: the period k before ``last``.  The bits are rotated so that ``last`` is the top
    one, and read from the top down."""
    k = F.pmod(F.lit(WIDTH - 1) - last, F.lit(WIDTH))
    left = F.call_function("shiftleft", bits, k.cast("int"))
    top = F.when(k == 0, bits).otherwise(left.bitwiseOR(_right(bits, F.lit(WIDTH) - k)))
    return F.conv(F.reverse(F.lpad(F.bin(top), WIDTH, "0")), 2, -10).cast("long")


def career_bitmaps(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """(entity, first, last, bits) of every entity, checkpointed; rows without a period do not count."""
    ensure_checkpoint_dir(df.sparkSession)
    p = c(spec.period).cast("long")
    found = df.filter(p.isNotNull()).groupBy(spec.entity).agg(
        F.min(p).alias("first"), F.max(p).alias("last"), F.bit_or(_bit(F.pmod(p, F.lit(WIDTH)))).alias("_any"))
    bits = F.when(c("last") - c("first") < WIDTH, _turned(c("_any"), c("last")))
    return found.select(spec.entity, "first", "last", bits.alias("bits")).checkpoint(eager=True)


def seen_before(careers: DataFrame, latest: int | None, lookback: int) -> DataFrame:
    """Careers with a period in the ``lookback`` ones before ``latest`` but none at ``latest``.  Those
    that go on past ``latest`` are read from their bits."""
    if latest is None:
        return careers.filter(F.lit(False))
    end = F.lit(int(latest))
    ago = c("last") - end                                       # periods after ``latest``
    inside = F.coalesce(_right(c("bits"), F.greatest(ago, F.lit(0))), F.lit(0).cast("long"))
    wanted = F.lit(((1 << lookback) - 1) << 1).cast("long")
    later = (ago > 0) & (ago < WIDTH) & (inside.bitwiseAND(F.lit(1).cast("long")) == 0) & (inside.bitwiseAND(wanted) != 0)
    return careers.filter(((c("last") < end) & (c("last") >= end - lookback)) | later)


def _longest_run(bits: Column) -> Column:
    """Each step drops the last bit of every run, until none is left."""
    start = F.struct(bits.alias("x"), F.lit(0).alias("n"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(WIDTH)), start, lambda s, _: F.when(s["x"] == 0, s).otherwise(F.struct(
        s["x"].bitwiseAND(F.call_function("shiftleft", s["x"], F.lit(1))).alias("x"), (s["n"] + 1).alias("n"))))
    return step["n"]


def career_shape(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Per entity: first and last period, n_periods, missing (periods without a row between them),
    current_run (unbroken periods up to the last) and longest_run."""
    careers = career_bitmaps(df, spec)
    bits, span = c("bits"), c("last") - c("first") + 1
    run = F.length(F.regexp_extract(F.reverse(F.bin(bits)), "^1*", 0))
    short = careers.filter(bits.isNotNull()).select(
        spec.entity, "first", "last", F.bit_count(bits).cast("long").alias("n_periods"),
        (span - F.bit_count(bits)).alias("missing"), run.cast("long").alias("current_run"),
        _longest_run(bits).cast("long").alias("longest_run"))
    long = careers.filter(bits.isNull())
    if long.isEmpty():
        return short
    # periods less their number within the career are the same along an unbroken run
    p = c(spec.period).cast("long")
    own = df.filter(p.isNotNull()).select(spec.entity, p.alias("p")).join(long.select(spec.entity), spec.entity, "left_semi").distinct()
    island = c("p") - F.row_number().over(Window.partitionBy(spec.entity).orderBy("p"))
    runs = own.withColumn("island", island).groupBy(spec.entity, "island").agg(
        F.count(F.lit(1)).alias("n"), F.min("p").alias("a"), F.max("p").alias("z"))
    shape = runs.groupBy(spec.entity).agg(
        F.min("a").alias("first"), F.max("z").alias("last"), F.sum("n").alias("n_periods"),
        (F.max("z") - F.min("a") + 1 - F.sum("n")).alias("missing"),
        F.max_by("n", "z").alias("current_run"), F.max("n").alias("longest_run"))
    return short.unionByName(shape)
