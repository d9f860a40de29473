"""Operators built for skew and growth: grouped quantiles, bitmaps, the name join, refresh."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.bitmaps import career_bitmaps, career_shape
from panelcast.operators.joins import absent_entities, frequent_keys, left_join_normalized
from panelcast.operators.quantiles import grouped_quantiles
from panelcast.operators.windows import next_period_target
from panelcast.sources.refresh import refresh_panel
from panelcast.spec import PanelSpec

SPEC = PanelSpec()


def test_grouped_quantiles_of_many_and_hot_groups(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randrange(50)) if g % 3 else rng.random()) for g in range(10_000) for _ in range(rng.randrange(1, 4))]
    rows += [(7, rng.gauss(0, 1)) for _ in range(20_000)] + [(None, 1.0), (None, 4.0), (8, None), (-1, None), (9, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double")
    own = {}
    for g, v in rows:
        if v is not None and v == v:
            own.setdefault(g, []).append(v)
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.3, "c": 1.0}, partitions=16).collect()}
    assert got.keys() == own.keys()
    for g, vs in own.items():
        assert np.allclose([got[g]["a"], got[g]["b"], got[g]["c"]], np.quantile(vs, [0.0, 0.3, 1.0]), rtol=1e-12, atol=1e-12)
    assert grouped_quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).collect() == []


def shape(seasons):
    seasons = sorted(set(seasons))
    runs = [1]
    for a, b in zip(seasons, seasons[1:]):
        runs = [*runs[:-1], runs[-1] + 1] if b == a + 1 else [*runs, 1]
    return seasons[0], seasons[-1], len(seasons), seasons[-1] - seasons[0] + 1 - len(seasons), runs[-1], max(runs)


def test_career_bitmaps_against_sets(spark):
    rng = random.Random(5)
    careers = {i: [rng.randrange(1900, 1900 + rng.choice([1, 5, 64])) for _ in range(rng.randrange(1, 40))] for i in range(300)}
    careers |= {1000: list(range(1950, 2014)), 1001: list(range(1900, 2100, 2)), 1002: [-3, 0, 1, 2], 1003: [1, 400]}
    df = spark.createDataFrame([(i, s) for i, ss in careers.items() for s in ss] + [(5000, None)], "player_id long, season int")
    got = {r[0]: tuple(r)[1:] for r in career_shape(df, SPEC).collect()}
    assert got == {i: shape(ss) for i, ss in careers.items()}
    assert {r["player_id"] for r in career_bitmaps(df, SPEC).where("bits is null").collect()} == {1001, 1003}


@pytest.mark.parametrize("latest", [None, 1930, 1940])
def test_absent_entities_against_sets(spark, latest):
    rng = random.Random(7)
    careers = {i: {rng.randrange(1915, 1955) for _ in range(rng.randrange(1, 25))} for i in range(300)}
    df = spark.createDataFrame([(i, s) for i, ss in careers.items() for s in ss], "player_id long, season int")
    end = latest or max(max(ss) for ss in careers.values())
    want = {i for i, ss in careers.items() if end not in ss and ss & set(range(end - 3, end))}
    assert {r[0] for r in absent_entities(df, SPEC, latest).collect()} == want
    assert absent_entities(df.limit(0), SPEC).collect() == []


def test_name_join_spreads_null_and_frequent_names(spark):
    rng = random.Random(11)
    n = 40_000
    rows = [(i, None if i % 10 < 3 else "Hot Name" if i % 10 < 5 else f"P. {rng.randrange(3000)}", 2020) for i in range(n)]
    left = spark.createDataFrame(rows, "id int, full_name string, season int")
    side = spark.createDataFrame([("HOT NAME", 2020, 0.5), (None, 2020, 9.0)] + [(f"p {k}", 2020, k / 3000) for k in range(0, 3000, 2)],
                                 "full_name string, season int, fb_pct double")
    keys = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keys, ("false", "-1", "16")):
            spark.conf.set(k, v)
        joined = left_join_normalized(left, side, "full_name", "season", hot_share=0.05, check_unique=True)
        got = joined.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v)
    sizes = [sum(1 for r in got if r["part"] == p) for p in {r["part"] for r in got}]
    assert len(sizes) == 16 and max(sizes) <= 2 * statistics.median(sizes)
    plain = {"hot name": 0.5} | {f"p {k}": k / 3000 for k in range(0, 3000, 2)}
    assert {r["id"]: r["fb_pct"] for r in got} == {i: plain.get((name or "").lower().replace(".", "")) for i, name, _ in rows}
    assert len(got) == n


def test_name_join_reports_repeated_side_keys(spark):
    left = spark.createDataFrame([("A", 1)], "full_name string, season int")
    side = spark.createDataFrame([("a", 1, 2), ("A.", 1, 3)], "full_name string, season int, x int")
    assert left_join_normalized(left, side, "full_name", "season").count() == 2
    with pytest.raises(Exception, match="side table repeats"):
        left_join_normalized(left, side, "full_name", "season", check_unique=True).collect()


def test_frequent_keys(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    hot = frequent_keys(df, F.xxhash64("k"), 0.1)
    assert hot == [df.where("k = 0").select(F.xxhash64("k")).first()[0]]
    assert frequent_keys(df.limit(0), F.xxhash64("k"), 0.1) == []


def panel(spark, rows):
    return next_period_target(spark.createDataFrame(rows, "player_id long, season int, total_strikeouts int, x string"), SPEC)


@pytest.mark.parametrize("change", [2024, 2022])
def test_refresh_equals_a_full_rebuild(spark, tmp_path, change):
    rng = random.Random(change)
    old = [(i, s, rng.randrange(300), "old") for i in range(60) for s in range(2018, 2024) if rng.random() < 0.95 and not (i < 30 and s == 2023)]
    new = [(i, change, rng.randrange(300), "new") for i in range(0, 60, 2)]
    path = str(tmp_path / "panel")
    panel(spark, old).write.partitionBy("season").parquet(path)

    def files():
        return {p.parent.name: sorted(f.name for f in p.parent.glob("*.parquet")) for p in (tmp_path / "panel").glob("season=*/*.parquet")}

    before = files()
    done = refresh_panel(path, panel(spark, new), SPEC)
    whole = panel(spark, [r for r in old if r[1] != change] + new)
    cols = ["player_id", "season", "total_strikeouts", "x", "next_season_strikeouts"]
    assert sorted(map(tuple, spark.read.parquet(path).select(cols).collect()), key=str) == sorted(map(tuple, whole.select(cols).collect()), key=str)
    after = files()
    assert {k for k in after if after[k] != before.get(k)} == {f"season={s}" for s in done}
    assert change in done and 2018 not in done
    assert refresh_panel(path, panel(spark, new[:0] or [(0, 0, 0, "")]).limit(0), SPEC) == []
