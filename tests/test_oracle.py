"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import os

import pytest

from tools.compare import duck, value_hash

SF = "/root/testdata/sf0.001"
FAST = ["season_panel", "season_panel_extended", "momentum_features", "availability_features",
        "pitch_mix_join", "typed_impute", "describe_columns", "correlated_pairs", "error_quartiles",
        "eval_metrics", "main_projection", "supplemental_projection", "injury_scenarios", "game_log_coverage"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF)
    res = duck(SF).execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    srows = [tuple(r) for r in sdf.collect()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert value_hash(sdf.columns, srows)[0] == value_hash(dcols, drows)[0]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "rank" in df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ["pitch_fill_counts", "bias_suggestions", "season_quantiles", "career_shape", "panel_refresh",
                                  "metrics_file", "feature_list_file", "split_comparison"])
def test_reports_match_their_oracles(spark, name):
    test_query_matches_oracle(spark, name)


def test_only_rules_that_fire_suggest(spark):
    from panelcast.operators.evaluate import bias_rules
    errors = spark.createDataFrame([(1, 30, 0, 4.0), (0, 30, 0, 1.0)], "is_starter int, age int, is_ace int, error double")
    fired = bias_rules(errors).where("fires = 1").collect()
    assert [(r["rule"], r["bias"]) for r in fired] == [("A", 4.0)] and "rows with starts" in fired[0]["suggestion"]
