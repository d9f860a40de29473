"""Forests and boosting (M7, M8): Spark ML's trees, grown from histograms in numpy.

The learner keeps Spark ML's method step by step: its candidate thresholds (from the same sampled rows), its bootstrap
(the same Poisson stream a partition), its variance gain with the first best split, its leaf rules and pruning.  Sums
of whole labels are exact, so a forest equals Spark ML's; boosting sums residuals, which agree but for the last bits.
What differs is the work:

* a feature value is one byte (its bin), so the rows of a fit stay in memory and a pass reads 58 bytes a row;
* histograms are filled feature by feature, a tree at a time, in arrays that fit the processor's caches;
* of two siblings the smaller is counted, the other is its parent less that (half of the rows and of the shuffle).

A forest's histograms are summed and searched in tasks, by tree; the driver sees the best split of each node.  Trees
are grown in groups whose histograms fit ``HISTOGRAM_BYTES`` a task, so memory grows with neither rows nor trees.
Up to ``ALONE_ROWS`` rows each tree is grown in one task, by the same functions.
The fitted model is Spark ML's own, loaded from files in its format.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyspark
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.mllib.common import _java2py
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.histograms import (
    INVALID, Tree, advanced, apply_splits, best_splits, binned, boosted_alone, boosting_sums, completed, forest_sums, grown_alone, new_tree, parents, read,
    searched, step_of, thresholds, variance,
)
from panelcast.session import ensure_checkpoint_dir, ship_package

#: Rows that Spark ML samples for the thresholds.
SAMPLED_ROWS = 10_000
#: Rows of a chunk, the unit in which binned rows are kept and read.
CHUNK_ROWS = 1 << 18
#: Rows up to which a tree is grown whole in one task: jobs for each level would take longer.
ALONE_ROWS = 1 << 16
#: Histograms of a task at once (Spark ML's own bound, ``maxMemoryInMB``).
HISTOGRAM_BYTES = 256 << 20
#: Rows of a sibling from which it is derived though its sums are not exact.
DERIVED_ROWS = 1 << 16
#: Rounds of boosting between two checkpoints of the predictions.
CHECKPOINT_ROUNDS = 10
#: Partitions whose histograms the driver adds itself.
DRIVER_PARTITIONS = 64


# -- binned rows ---------------------------------------------------------------

def sampled_thresholds(dataset: DataFrame, rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds of each column from Spark ML's sample: all rows, or about ``SAMPLED_ROWS`` of them, which are the only ones to reach the driver."""
    fraction, spark = min(1.0, SAMPLED_ROWS / rows), dataset.sparkSession
    if fraction < 1.0:
        first_int = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sample = dataset._jdf.toJavaRDD().sample(False, fraction, first_int)
        dataset = DataFrame(spark._jsparkSession.createDataFrame(sample, dataset._jdf.schema()), spark)
    table = dataset.toArrow()
    return [thresholds(column.to_numpy(), fraction * rows, min(max_bins, rows) - 1) for column in table.columns]


def binned_rows(dataset: DataFrame, cuts: list[np.ndarray]) -> RDD:
    """(bins, labels) a chunk, in the partitions and the order of ``dataset``, whose last column is the label."""
    most = CHUNK_ROWS
    chunks = dataset.mapInArrow(lambda batches: binned(batches, cuts, most), "bins binary, y binary")
    return chunks.rdd.map(lambda row: (bytes(row[0]), bytes(row[1])))


def poisson_rows(sc, rows: int, trees: int, seed: int) -> RDD:
    """``rows`` vectors of Poisson draws (mean 1) in one partition whose generator starts from ``seed`` itself.
    ``RandomRDDs`` derives a partition's seed from the one given, so it is set in the partition."""
    drawn = sc._jvm.org.apache.spark.mllib.random.RandomRDDs.poissonJavaVectorRDD(sc._jsc, 1.0, rows, trees, 1, seed)
    part = drawn.rdd().partitions()[0]
    held = part.getClass().getDeclaredField("seed")
    held.setAccessible(True)
    held.setLong(part, seed)
    return _java2py(sc, drawn)


def bootstrap_counts(sc, rows: list[list[int]], trees: int, seed: int) -> RDD:
    """How often each tree draws each row, a byte each, by tree, for chunks of ``rows`` rows a partition.  As in Spark
    ML: in row order, from a generator seeded by ``seed + partition + 1``."""
    parts = [poisson_rows(sc, max(1, sum(sizes)), trees, seed + p + 1) for p, sizes in enumerate(rows)]

    def chunked(p: int, draws: Iterator) -> Iterator[bytes]:
        for size in rows[p]:
            counts = np.empty((size, trees), np.uint8)
            for i in range(size):
                counts[i] = next(draws).array
            yield np.ascontiguousarray(counts.T).tobytes()
        for _ in draws:
            pass

    return sc.union(parts).mapPartitionsWithIndex(chunked)


def zipped(chunks: RDD, more: RDD) -> RDD:
    """Chunks with one more part each, serialised one at a time: ``zip`` would batch a hundred of them."""
    one = BatchedSerializer(CPickleSerializer(), 1)
    return chunks._reserialize(one).zip(more._reserialize(one)).map(lambda pair: (*pair[0], pair[1]))


# -- forest --------------------------------------------------------------------

def forest_alone(data: RDD, cuts: list[np.ndarray], trees: int, depth: int, whole: bool) -> list[Tree]:
    """Each task grows whole trees from all rows, of which there are few."""
    sc, splits = data.context, np.array([len(cut) for cut in cuts])
    shared, derive_from = sc.broadcast(data.collect()), 0 if whole else DERIVED_ROWS
    widths = (len(cuts), int(splits.max(initial=0)) + 1)
    found = sc.parallelize(range(trees), min(trees, 2 * sc.defaultParallelism)).map(
        lambda t: grown_alone(shared.value, t, widths, splits, depth, whole, derive_from)).collect()
    shared.destroy()
    return found


def grow_forest(data: RDD, cuts: list[np.ndarray], trees: int, depth: int, whole: bool) -> list[Tree]:
    """``data``: bins, labels and bootstrap counts.  Trees are grown level by level, in groups."""
    splits = np.array([len(cut) for cut in cuts])
    widths = (len(cuts), int(splits.max(initial=0)) + 1)
    bytes_a_tree = (1 << max(0, depth - 2)) * widths[0] * widths[1] * 8 * (2 if whole else 6)
    group, grown, parallel = max(1, HISTOGRAM_BYTES // bytes_a_tree), {t: new_tree(depth) for t in range(trees)}, data.context.defaultParallelism
    group = -(-trees // -(-trees // group))
    for first in range(0, trees, group):
        active, kept = {t: grown[t] for t in range(first, min(first + group, trees))}, None
        for level in range(depth):
            sent = {t: Tree(tree.feature, tree.cut, plan=tree.plan) for t, tree in active.items()}
            found = data.mapPartitions(partial(forest_sums, trees=sent, widths=widths, whole=whole))
            if kept is not None:
                found = found.union(kept.flatMap(partial(parents, wanted=[t for t in sent if sent[t].plan.derived])))
            full = found.partitionBy(min(parallel, len(active)), int).mapPartitions(partial(searched, trees=sent, splits=splits))
            if level + 1 < depth:
                full = full.persist(StorageLevel.MEMORY_AND_DISK)
            for t, best in full.map(lambda x: (x[0], x[2])).collect():
                apply_splits(active[t], best, depth, 0 if whole else DERIVED_ROWS)
            if kept is not None:
                kept.unpersist()
            kept, active = full, {t: tree for t, tree in active.items() if tree.open}
            if not active:
                break
        kept.unpersist()
    return [grown[t] for t in range(trees)]


# -- boosting ------------------------------------------------------------------

def boosting_alone(data: RDD, cuts: list[np.ndarray], rounds: int, depth: int, step: float, whole: bool) -> list[Tree]:
    """All rounds in one task, over few rows."""
    sc, splits = data.context, np.array([len(cut) for cut in cuts])
    shared, derive_from = sc.broadcast(data.collect()), DERIVED_ROWS
    widths = (len(cuts), int(splits.max(initial=0)) + 1)
    found = sc.parallelize([0], 1).flatMap(lambda _: boosted_alone(shared.value, rounds, step, widths, splits, depth, whole, derive_from)).collect()
    shared.destroy()
    return found


def grow_boosted(data: RDD, cuts: list[np.ndarray], rounds: int, depth: int, step: float, whole: bool) -> list[Tree]:
    """``data``: bins and labels.  Each round fits the residuals doubled, as Spark ML's squared loss does; the
    driver adds the histograms of one tree (at most a few MB a partition)."""
    splits = np.array([len(cut) for cut in cuts])
    widths, parts, grown, work = (len(cuts), int(splits.max(initial=0)) + 1), data.getNumPartitions(), [], data
    for m in range(rounds):
        tree, above, exact = new_tree(depth), None, whole and not m
        for _ in range(depth):
            sent = {0: Tree(tree.feature, tree.cut, plan=tree.plan)}
            sums = work.mapPartitions(partial(boosting_sums, trees=sent, widths=widths, whole=exact, residuals=m > 0))
            counted = sums.treeReduce(np.add, depth=1 if parts <= DRIVER_PARTITIONS else 2)
            above = completed(tree.plan, counted, above)
            apply_splits(tree, best_splits(above, tree.plan.impurity, splits), depth, 0 if exact else DERIVED_ROWS)
            if not tree.open:
                break
        grown.append(tree)
        if m + 1 == rounds:
            break
        after = work.map(partial(advanced, **step_of(tree, depth, step if m else 1.0, widths[0])))
        if (m + 1) % CHECKPOINT_ROUNDS == 0:
            after = _cut_lineage(data, after)
        after.persist(StorageLevel.MEMORY_AND_DISK)
        after.foreachPartition(read)
        if work is not data:
            work.unpersist()
        work = after
    if work is not data:
        work.unpersist()
    return grown


def _cut_lineage(data: RDD, work: RDD) -> RDD:
    """The same chunks, their predictions read from a reliable checkpoint."""
    predicted = work.map(lambda chunk: chunk[2])
    predicted.checkpoint()
    predicted.count()
    return zipped(data, predicted)


# -- Spark ML's model ----------------------------------------------------------

def node_rows(tree: Tree, cuts: list[np.ndarray]) -> list[tuple]:
    """Nodes in Spark ML's format, numbered from the root on; splits between leaves of equal predictions are pruned."""
    def built(node: int):
        stats = tree.stats[node]
        value, impurity = stats[1] / stats[0], variance(*stats)
        if node >= tree.feature.size or tree.feature[node] < 0:
            return value, impurity if tree.gain.get(node, 0.0) != INVALID else -1.0, stats, None
        left, right = built(2 * node), built(2 * node + 1)
        if left[3] is None and right[3] is None and left[0] == right[0]:
            return value, impurity, stats, None
        return value, impurity, stats, (tree.gain[node], int(tree.feature[node]), float(cuts[tree.feature[node]][tree.cut[node]]), left, right)

    out: list[tuple] = []

    def numbered(item) -> int:
        value, impurity, stats, split = item
        at = len(out)
        out.append(())
        if split is None:
            out[at] = (at, value, impurity, list(stats), int(stats[0]), -1.0, -1, -1, (-1, [], -1))
        else:
            gain, f, cut, left, right = split
            a, b = numbered(left), numbered(right)
            out[at] = (at, value, impurity, list(stats), int(stats[0]), gain, a, b, (f, [cut], -1))
        return at

    numbered(built(1))
    return out


NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
         "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def spark_model(spark, regressor, cls, trees: list[Tree], weights: list[float], cuts: list[np.ndarray]):
    """Spark ML's model of the trees, written in its format to the checkpoint folder and loaded."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/trees-{uuid.uuid4().hex}"
    stamp = {"timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__}
    given = {param.name: value for param, value in regressor.extractParamMap().items()}
    named = {k: v for k, v in given.items() if k in ("featuresCol", "labelCol", "predictionCol", "seed", "maxDepth")}
    of_tree = json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **stamp, "paramMap": named, "defaultParamMap": {}})
    head = json.dumps({"class": f"org.apache.spark.ml.regression.{cls.__name__}", **stamp, "uid": regressor.uid, "paramMap": given,
                       "defaultParamMap": {}, "numFeatures": len(cuts), "numTrees": len(trees)})
    nodes = [(t, node) for t, tree in enumerate(trees) for node in node_rows(tree, cuts)]
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(t, json.dumps({**json.loads(of_tree), "uid": f"{regressor.uid}_{t}"}), float(w)) for t, w in enumerate(weights)],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/data")
    return cls.load(path)


class HistogramTrees(Estimator):
    """Fits a ``RandomForestRegressor`` or ``GBTRegressor`` of Spark ML, all features at every split, from histograms.
    ``features`` are the columns that the frame's features vector holds."""

    def __init__(self, regressor: RandomForestRegressor | GBTRegressor, features: Sequence[str]):
        super().__init__()
        self.regressor, self.features = regressor, list(features)

    def _fit(self, dataset: DataFrame):
        reg, spark = self.regressor, dataset.sparkSession
        sc, depth = spark.sparkContext, reg.getMaxDepth()
        forest = isinstance(reg, RandomForestRegressor)
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        trees = reg.getNumTrees() if forest else reg.getMaxIter()
        numbers = dataset.select(*[F.col(x).cast("double").alias(f"f{i}") for i, x in enumerate([*self.features, reg.getLabelCol()])])
        if not (rows := numbers.count()):
            raise ValueError("no rows to fit")
        cuts = sampled_thresholds(numbers.drop(f"f{len(self.features)}"), rows, reg.getMaxBins(), reg.getSeed())
        data = binned_rows(numbers, cuts).persist(StorageLevel.MEMORY_AND_DISK)
        seen = data.mapPartitionsWithIndex(lambda p, chunks: [(p, [_about(y) for _, y in chunks])]).collect()
        about = [found for _, found in sorted(seen)]
        whole = all(ok for part in about for _, ok in part)
        if forest:
            counts = bootstrap_counts(sc, [[n for n, _ in part] for part in about], trees, reg.getSeed())
            drawn = zipped(data, counts).persist(StorageLevel.MEMORY_AND_DISK)
            drawn.foreachPartition(read)
            data.unpersist()
            grow = forest_alone if rows <= ALONE_ROWS else grow_forest
            grown, weights = grow(drawn, cuts, trees, depth, whole), [1.0] * trees
            drawn.unpersist()
            return spark_model(spark, reg, RandomForestRegressionModel, grown, weights, cuts)
        grow = boosting_alone if rows <= ALONE_ROWS else grow_boosted
        grown = grow(data, cuts, trees, depth, reg.getStepSize(), whole)
        data.unpersist()
        return spark_model(spark, reg, GBTRegressionModel, grown, [1.0] + [reg.getStepSize()] * (trees - 1), cuts)


def _about(y: bytes) -> tuple[int, bool]:
    """Rows of a chunk, and whether its labels are whole numbers whose sums are exact."""
    y = np.frombuffer(y)
    return y.size, bool(np.all((y >= 0) & (y < 2 ** 20) & (y == np.floor(y))))
