"""MaxScore against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import maxscore


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        every = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in every[:k]]
    return out


@pytest.mark.parametrize("scale,shard", [(1, 64), (100, 7), (10 ** 8, 50)])
def test_exact_with_ties_and_negatives(spark, scale, shard):
    rng = np.random.default_rng(scale)
    vectors = {i: [int(x) * scale for x in rng.integers(-4, 5, 12)] for i in range(150)}
    for i in range(100, 130):
        vectors[i] = vectors[3]         # a hot vector
    vectors[140], vectors[141] = [0] * 12, [5 * scale]
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<long>").withColumn("score", F.lit("x"))
    queries = [i for i in vectors if i % 10 == 0]
    got = maxscore.top_k(df.where("id % 10 = 0"), df, 5, shard_rows=shard, block_rows=4).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert found == brute(vectors, queries, 5)


def test_edge_vectors(spark):
    rows = [(0, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.1, 0.1]), (5, [0.1, 0.1]), (None, [1.0, 1.0])]
    df = maxscore.whole_vectors(spark.createDataFrame(rows, "i long, e array<float>"), "e", 256.0, "i")
    assert {r["id"]: r["v"] for r in df.collect()} == {0: [128, -64], 5: [25, 25]}
    got = maxscore.top_k(df, df, 5).collect()
    assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in got} == {(0, 1, 5, 1600), (5, 1, 0, 1600)}
    assert maxscore.top_k(df.limit(0), df, 5).count() == 0 and maxscore.top_k(df, df.limit(0), 5).count() == 0
    assert maxscore.top_k(df.where("id = 0"), df.where("id = 0"), 5).count() == 0


def test_one_block_meets_its_shards_in_several_tasks(spark):
    rng = np.random.default_rng(3)
    vectors = {i: [int(x) for x in rng.integers(-9, 10, 6)] for i in range(400)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<long>")
    keys = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(keys, ("false", "-1")):
            spark.conf.set(k, v)
        found = maxscore.top_k(df.where("id % 50 = 0"), df, 5, shard_rows=10)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()}
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v)
    assert "hashpartitioning(part" in plan and "block" in plan
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert got == {(q, n + 1): x for q, own in want.items() for n, x in enumerate(own)}


def test_floors_leave_the_best_in_place():
    rng = np.random.default_rng(8)
    shard, queries = rng.integers(-5, 6, (200, 8)).astype(float), rng.integers(-5, 6, (20, 8)).astype(float)
    ids, own = np.arange(200), np.arange(1000, 1020)
    plain = maxscore.search(queries, own, shard, ids, 5)
    fifth = {q: min(s for a, _, s in plain if a == q) for q in own.tolist()}
    assert maxscore.search(queries, own, shard, ids, 5, [fifth[q] for q in own.tolist()]) == plain
    above = maxscore.search(queries, own, shard, ids, 5, [fifth[q] + 1 for q in own.tolist()])
    assert {x for x in above if x[2] > fifth[x[0]]} == {x for x in plain if x[2] > fifth[x[0]]}
