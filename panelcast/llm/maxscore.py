"""Exact top-k inner products by MaxScore.

Components of a vector are its terms; a vector's weight for a term is its
component.  Weights may be negative, so a shard's postings hold each weight
above the least of its term, and a query's terms with negative weight are
served from the top down: every term then has contributions from 0 to a bound.
For a query a shard's terms are ordered by bound; the trailing terms whose
bounds together cannot lift a vector over the k-th best score so far are
non-essential.  The essential postings are traversed for all vectors, and
the others are probed, strongest first, only for vectors that can still compete.
Each shard gives its k best per query, and a ranking merges the shards.  One shard is searched
first: its k-th best score of each query is the threshold that every other shard starts with.

A vector is an array of integers.  Vectors of different length are compared
over their common components.  Null vectors and vectors with null components are left
out, as are rows with null ids; of rows that share an id the smallest vector counts.
Ties go to the smaller id.  Scores are exact integers: above what doubles hold
exactly, the work is done in whole numbers without limit, and a score beyond 64 bits raises.
Other columns are ignored.  Queries without candidates give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import by_key, map_rows, written

SHARD, QUERIES, STEP = 1024, 512, 8


def whole_vectors(df: DataFrame, vector: str, scale: float, ident: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors that are null or
    hold null or non-finite components are left out, one vector stays of each id."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).where(fine)
            .select(F.col(ident).alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Rows padded to ``width``; doubles where all products and sums are
    exact in them, else Python's whole numbers."""
    most = max((abs(e) for v in vectors for e in v), default=0)
    kind = np.float64 if most * most * max(width, 1) < 2 ** 52 else object
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def search(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int,
           floors: list[int | None] | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's ``k`` best in a shard, by MaxScore.  Vectors that
    score below a query's floor may be left out."""
    out = []
    if not len(ids):
        return out
    low, high = shard.min(axis=0), shard.max(axis=0)
    # postings: a row per term, one for either sign of the query's weight
    above, below = np.ascontiguousarray((shard - low).T), np.ascontiguousarray((high - shard).T)
    span = high - low
    for q, own, floor in zip(queries, query_ids, floors or [None] * len(queries)):
        size = abs(q)
        bound = size * span                                     # contributions lie between 0 and this
        base = (np.where(q > 0, low, high) * q).sum()           # of a vector without contributions
        order = np.argsort(-bound.astype(np.float64), kind="stable")
        order = order[bound[order] > 0]
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive), shard.dtype)
        least, at = -1 if floor is None else max(-1, floor - base), 0
        while at < len(order):
            upto = min(len(order), at + STEP)
            for t in order[at:upto]:
                posting = above[t] if q[t] > 0 else below[t]
                score = score + size[t] * (posting if len(alive) == len(ids) else posting[alive])
            at = upto
            if len(alive) > k or least >= 0:
                if len(alive) > k:
                    # the k-th best score that is certain so far
                    least = max(least, np.partition(score.astype(np.float64), len(score) - k)[len(score) - k])
                # doubles may round whole numbers without limit: leave room
                stay = (score + rest[at]).astype(np.float64) >= least * (1 if shard.dtype != object else 1 - 1e-12)
                if not stay.all():
                    alive, score = alive[stay], score[stay]
        best = sorted(zip((-(s + base) for s in score.tolist()), ids[alive].tolist()))[:k]
        out += [(int(own), i, -int(s)) for s, i in best]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, shard_rows: int = SHARD, block_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` candidates (id, v) of highest inner product
    with each query (id, v), but the row of the query's own id.

    Candidates are packed into shards and queries into blocks of fixed sizes;
    a task joins one shard with one block, and the key is both, so that neither few
    blocks nor few shards meet in one task.
    """
    spark = candidates.sparkSession
    candidates, queries = written(candidates.select("id", "v"), "candidates"), written(queries.select("id", "v"), "queries")
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))

    def dealt(df, n, *more):
        """Rows of a part gathered: width, ids, vectors and, where given, floors."""
        def gather(key, rows):
            yield key[0], max(len(r[1]) for r in rows), *([r[i] for r in rows] for i in range(2 + len(more)))
        kind = "part int, width int, ids array<long>, vectors array<array<long>>" + ", floors array<long>" * len(more)
        return by_key(df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"), "id", "v", *more), ["part"], gather, kind)

    def run(cols):
        for width, ids, vectors, q_width, q_ids, q_vectors, floors in zip(*cols):
            both = _matrix(vectors + q_vectors, max(width, q_width))
            yield from search(both[len(vectors):], np.array(q_ids, np.int64), both[:len(vectors)], np.array(ids, np.int64), k, floors)

    def met(shard, asked, own):
        """Each of ``own`` shards' rows with each block's."""
        asked = asked.select(F.col("part").alias("block"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"),
                             F.col("vectors").alias("q_vectors"), "floors").withColumn("part", F.explode(F.sequence(F.lit(own[0]), F.lit(own[1]))))
        each = shard.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = each.join(asked.hint("shuffle_hash"), ["part", "block"])
        return map_rows(pairs.select("width", "ids", "vectors", "q_width", "q_ids", "q_vectors", "floors"), run, "query_id long, id long, score long", rows=1)

    packed = written(dealt(candidates, shards), "shards")
    first = written(met(packed.where("part = 0"), dealt(queries.withColumn("floor", F.lit(None).cast("long")), blocks, "floor"), (0, 0)), "first")
    found = first
    if shards > 1:
        floor = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        asked = queries.join(floor.withColumnRenamed("query_id", "id"), "id", "left")
        found = first.unionByName(met(packed.where("part > 0"), dealt(asked, blocks, "floor"), (1, shards - 1)))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
