"""Edge fixtures for the operators (literal rows, checked against hand-computed values)."""

import math

import numpy as np
from pyspark.sql import functions as F

from panelcast.functions.exprs import right_closed_cut, round_half_even
from panelcast.functions.features import mix_entropy
from panelcast.functions.text import normalized_name
from panelcast.operators.composite import risk_score
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.rank import global_rank
from panelcast.operators.windows import availability_features, latest_row, next_period_target
from panelcast.spec import PanelSpec

SPEC = PanelSpec()


def test_gap_career_windows(spark):
    df = spark.createDataFrame(
        [(1, 2021, 100.0, 10), (1, 2023, 120.0, 20), (1, 2024, 80.0, 30), (2, 2022, 60.0, 5)],
        "player_id long, season int, total_innings_pitched double, total_strikeouts int")
    out = availability_features(next_period_target(df, SPEC), SPEC)
    strict = next_period_target(df, SPEC, strict=True, name="strict")
    rows = {(r.player_id, r.season): r for r in out.join(strict.select("player_id", "season", "strict"),
                                                           ["player_id", "season"]).collect()}
    r1, r2, r3 = rows[(1, 2021)], rows[(1, 2023)], rows[(1, 2024)]
    assert [r1.next_season_strikeouts, r2.next_season_strikeouts, r3.next_season_strikeouts] == [20.0, 30.0, None]
    assert [r1.strict, r2.strict, r3.strict] == [None, 30.0, None]
    assert [r1.years_since_injury, r2.years_since_injury, r3.years_since_injury] == [99, 1, 2]
    assert [r1.consecutive_active_years, r2.consecutive_active_years, r3.consecutive_active_years] == [1, 1, 2]
    assert [r1.missed_previous_season, r2.missed_previous_season, r3.missed_previous_season] == [0, 1, 0]
    assert math.isclose(r2.career_availability_rate, 2 / 3) and math.isclose(r3.career_availability_rate, 3 / 4)
    assert r3.ip_volatility == float(np.std([100.0, 120.0, 80.0]))
    single = rows[(2, 2022)]
    assert single.next_season_strikeouts is None and single.career_availability_rate == 1.0


def test_risk_score_bounds(spark):
    df = spark.createDataFrame(
        [(1, 2021, 100.0), (1, 2023, 120.0), (1, 2024, 80.0), (2, 2022, 60.0)],
        "player_id long, season int, total_innings_pitched double")
    out = risk_score(availability_features(df, SPEC)).collect()
    assert all(0.0 <= r.injury_risk_score <= 1.0 for r in out)


def test_latest_row(spark):
    df = spark.createDataFrame([(1, 2021, "a"), (1, 2023, "b"), (2, 2020, "c")], "player_id long, season int, x string")
    got = sorted((r.player_id, r.season, r.x) for r in latest_row(df, SPEC).collect())
    assert got == [(1, 2023, "b"), (2, 2020, "c")]


def test_entropy_and_names(spark):
    df = spark.createDataFrame(
        [(None, None, None), (1.0, None, None), (0.5, 0.5, None)], "a double, b double, c double")
    ent = [r[0] for r in df.select(mix_entropy("a", "b", "c")).collect()]
    assert ent[0] == 0.0 and abs(ent[1]) < 1e-9 and abs(ent[2] - 1.0) < 1e-6
    names = spark.createDataFrame([("José Berríos",), ("J.D. O'Neil ",), (None,)], "n string")
    got = [r[0] for r in names.select(normalized_name("n")).collect()]
    assert got == ["jose berrios", "jd oneil", None]


def test_right_closed_tiers_and_rounding(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 7.0, 9.0, 11.0, 100.0, 101.0]], "k double")
    got = [r[0] for r in df.select(right_closed_cut("k", [0, 7, 9, 11, 100], ["L", "A", "H", "E"])).collect()]
    assert got == [None, "L", "A", "H", "E", None]
    r = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (28.0,)], "p double")
    assert [x[0] for x in r.select(round_half_even("p")).collect()] == [2.0, 4.0, -0.0, 28.0]


def test_global_rank_is_unique_and_ordered(spark):
    rows = [(i, float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "player_id long, score double").repartition(5)
    out = global_rank(df, "score", ["player_id"], partitions=4).collect()
    ranks = sorted(r["rank"] for r in out)
    assert ranks == list(range(1, 1001))
    expect = sorted(rows, key=lambda t: (-t[1], t[0]))
    by_rank = {r["rank"]: r.player_id for r in out}
    assert [by_rank[i + 1] for i in range(1000)] == [t[0] for t in expect]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 2.0)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = exact_quantiles(df, {"x": "x", "pos": F.when(F.col("x") > 0, F.col("x"))}, [0.25, 0.5, 0.75], accuracy=50)
    for q in (0.25, 0.5, 0.75):
        assert math.isclose(got[("x", q)], float(np.quantile(vals, q)), rel_tol=0, abs_tol=1e-12)
        assert math.isclose(got[("pos", q)], float(np.quantile(vals[vals > 0], q)), rel_tol=0, abs_tol=1e-12)
