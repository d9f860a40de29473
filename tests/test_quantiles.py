"""Exact quantiles by selection against numpy, with ties and small limits."""

import numpy as np
import pytest

from panelcast.operators import quantiles


@pytest.mark.parametrize("limit", [5, 1000])
def test_selection_matches_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    rng = np.random.default_rng(limit)
    a, b = rng.normal(size=900), rng.integers(0, 3, 900).astype(float)
    far = np.concatenate([[-1.7e308, 1.7e308], np.full(898, 2.0)])
    rows = [(float(x), float(y), float(z), None) for x, y, z in zip(a, b, far)]
    df = spark.createDataFrame([*rows, (None, float("nan"), None, None)], "a double, b double, far double, none double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999]
    got = quantiles.exact_quantiles(df, {x: x for x in ("a", "b", "far", "none")}, probs, accuracy=100)
    for name, values in (("a", a), ("b", b), ("far", far)):
        for q in probs:
            assert got[name, q] == pytest.approx(np.quantile(values, q), rel=1e-12), (name, q)
    assert all(got["none", q] is None for q in probs)


def test_typed_impute_runs_its_input_once_and_medians_share_a_sketch(spark, monkeypatch):
    from panelcast.operators import quantiles as qu
    from panelcast.operators.impute import typed_impute
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    rows = [(i, None if i % 10 == 0 else float(i * 7919 % 10007), float(i % 13)) for i in range(4000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(counted), "id long, a double, b double")
    sketches = []
    sketch = qu.F.percentile_approx
    monkeypatch.setattr(qu.F, "percentile_approx", lambda *a: sketches.append(a) or sketch(*a))
    got = {r["id"]: (r["a"], r["b"]) for r in typed_impute(df, ["a", "b"]).collect()}
    values = sorted(a for _, a, _ in rows if a is not None)
    middle = (values[1799] + values[1800]) / 2
    assert got == {i: (middle if a is None else a, b) for i, a, b in rows}
    assert seen.value == 4000
    # two ranks a column, one sketch for both
    assert len(qu._neighbours([qu._Rank(0, 1799, 3600), qu._Rank(0, 1800, 3600), qu._Rank(1, 5, 3600)])) == 2
    assert len(sketches) <= 4
