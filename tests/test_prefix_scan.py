"""Segmented scans of long careers against the window operators."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelcast.operators.prefix_scan import PIECE, long_career_features, running_moments, split_careers
from panelcast.operators.windows import availability_features, career_window, running, trailing
from panelcast.spec import PanelSpec

SPEC = PanelSpec(entity="e", period="p", exposure="x", count="k", rate="r")
WANTED = ["prev_total_k", "career_high_k", "career_high_k9", "years_experience", "k9_3yr_avg", "k9_rolling_std", "missed_previous_season",
          "consecutive_active_years", "years_since_injury", "career_availability_rate", "ip_volatility", "coming_back_from_injury"]


def by_windows(df):
    w = career_window(SPEC)
    return availability_features(df, SPEC).withColumns({
        "prev_total_k": F.lag("k").over(w), "years_experience": F.row_number().over(w),
        "career_high_k": F.when(F.col("k").isNotNull(), F.max("k").over(running(SPEC))),
        "career_high_k9": F.when(F.col("r").isNotNull(), F.max("r").over(running(SPEC))),
        "k9_3yr_avg": F.avg("r").over(trailing(SPEC)), "k9_rolling_std": F.stddev_samp("r").over(trailing(SPEC))})


def same(got, want):
    got, want = ({(r["e"], r["p"]): r for r in df.select("e", "p", *WANTED).collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for key, r in want.items():
        for name in WANTED:
            assert got[key][name] == (r[name] if r[name] is None else pytest.approx(r[name], rel=1e-9, abs=1e-9)), (key, name)


@pytest.mark.parametrize("pieces", [1, 7, 64])
def test_pieces_give_what_windows_give(spark, pieces):
    rng = random.Random(pieces)

    def own(x):
        return None if rng.random() < 0.2 else x
    rows = [(e, p, own(rng.uniform(0, 200)), own(rng.randrange(300)), own(rng.gauss(9, 2)))
            for e, n in [(1, 400), (2, 1), (3, 60), (None, 50), *((i, 2) for i in range(10, 40))]
            for p in sorted(rng.sample(range(2 * n), n))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "e int, p int, x double, k int, r double").withColumn("extra", F.lit("y"))
    made = long_career_features(df, SPEC, pieces)
    assert "extra" in made.columns and not [x for x in made.columns if x.startswith("_")]
    same(made, by_windows(df))
    assert long_career_features(df.limit(0), SPEC, pieces).collect() == []
    with pytest.raises(ValueError, match="in use"):
        long_career_features(df.withColumn("_rn", F.lit(1)), SPEC)


def test_a_long_career_runs_in_several_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("e"), (F.col("id") + F.floor(F.col("id") / 1000)).alias("p"), (F.col("id") % 97 + 1e8).alias("x"),
                               (F.col("id") * 7919 % 1009).cast("int").alias("k"), (F.col("id") % 13).cast("double").alias("r"))
    cut = split_careers(df, SPEC, 16)
    sizes = [r["count"] for r in cut.groupBy(PIECE).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * statistics.median(sizes)
    got = long_career_features(df, SPEC, 16)
    every = got.agg(F.max("years_experience"), F.max("consecutive_active_years"), F.max("career_high_k")).first()
    assert tuple(every) == (n, 1000, 1008)
    some = F.col("p") % 9973 == 0
    same(got.where(some), by_windows(df).where(some))


def test_moments_keep_their_digits(spark):
    rng = random.Random(2)
    values = [1e9 + rng.random() for _ in range(500)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "e int, p int, x double")
    spec = PanelSpec(entity="e", period="p")
    got = {r["p"]: r["m"] for r in running_moments(split_careers(df, spec, 9), {"m": "x"}, spec).collect()}
    for i in (0, 1, 100, 499):
        assert got[i]["n"] == i + 1 and got[i]["m2"] == pytest.approx(statistics.pvariance(values[:i + 1]) * (i + 1), rel=1e-5, abs=1e-9)
