"""Histograms of trees (M7, M8): what tasks run, without Spark.  ``models.trees`` grows the trees from them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Counts and sums of whole labels share one double: count * PACK + sum.
PACK = float(1 << 30)
PACKED_ROWS = 1 << 22
EPSILON = 2.0 ** -52
INVALID = -np.finfo(np.float64).max


# -- binned rows ---------------------------------------------------------------

def thresholds(values: np.ndarray, expected: float, splits: int) -> np.ndarray:
    """Spark ML's candidate thresholds of a feature from its sampled values, of which ``expected`` are counted on:
    what is missing counts as zeros."""
    seen = values[values != 0.0]
    if not seen.size:
        return np.empty(0)
    distinct, counts = np.unique(seen, return_counts=True)
    counts = counts.astype(np.float64)
    if expected - seen.size > EPSILON * seen.size * 100:
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, expected - seen.size)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if middles.size <= splits:
        return middles
    out, stride = [], expected / (splits + 1)
    target, before = stride, float(counts[0])
    for middle, count in zip(middles.tolist(), counts[1:].tolist()):
        now = before + count
        if abs(before - target) < abs(now - target):
            out.append(middle)
            target += stride
        before = now
    return np.array(out)


def binned(batches: Iterable[pa.RecordBatch], cuts: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of at most ``most`` rows as bins (the number of thresholds below a value), a feature after the other, and labels."""
    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        if any(column.null_count or not np.isfinite(column.to_numpy()).all() for column in table.columns):
            raise ValueError("a feature or label to fit is NULL, NaN or infinite")
        bins = b"".join(np.searchsorted(cut, table.column(i).to_numpy()).astype(np.uint8).tobytes() for i, cut in enumerate(cuts))
        y = table.column(len(cuts)).to_numpy().astype(np.float64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([bins], pa.binary()), pa.array([y], pa.binary())], ["bins", "y"])

    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == most:
                yield chunk(held)
                held, rows = [], 0
    if rows:
        yield chunk(held)


# -- trees ---------------------------------------------------------------------

@dataclass
class Tree:
    """A growing tree: nodes by heap number (children of i: 2i, 2i + 1), those to be split at the next level, in order."""
    feature: np.ndarray
    cut: np.ndarray
    stats: dict[int, tuple] = field(default_factory=dict)     # count, sum, sum of squares
    gain: dict[int, float] = field(default_factory=dict)      # of the best split of each node that was searched
    open: list[int] = field(default_factory=lambda: [1])
    plan: Plan | None = None


@dataclass
class Plan:
    """A level of a tree: which nodes are counted, in which place; the others are their parent less the sibling."""
    level: int
    slot: np.ndarray                      # place by node of the level, -1: not counted
    counted: list[int]                    # places of ``open`` that are counted
    derived: list[tuple[int, int, int]]   # place, the parent's in the level above, the sibling's
    impurity: np.ndarray | None           # of the open nodes; None at the root


def variance(count, total, squares):
    """Spark's variance, in the order of its operations."""
    return (squares - (total * total) / count) / count


def new_tree(depth: int) -> Tree:
    tree = Tree(np.full(1 << depth, -1, np.int64), np.zeros(1 << depth, np.uint8))
    tree.plan = Plan(0, np.zeros(1, np.int64), [0], [], None)
    return tree


def _route(tree: Tree, rows: np.ndarray, bins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that reach a node of ``level``, and their nodes."""
    n, flat = bins.shape[1], bins.reshape(-1)
    node = np.ones(rows.size, np.int64)
    for _ in range(level):
        f = tree.feature[node]
        if f.size and f.min() < 0:
            inner = f >= 0
            rows, node, f = rows[inner], node[inner], f[inner]
        f *= n
        f += rows
        right = flat[f] > tree.cut[node]
        node *= 2
        node += right
    return rows, node


class Sums:
    """A tree's histograms of count, sum and sum of squares, filled chunk by chunk."""

    def __init__(self, features: int, width: int, slots: int, whole: bool):
        self.shape, self.whole = (features, slots * width), whole
        self.held = np.zeros((2 if whole else 3, *self.shape))
        self.done, self.rows, self.total = None, 0.0, 0.0

    def add(self, bins: np.ndarray, rows: np.ndarray | None, base: np.ndarray | None, w: np.ndarray | None, y: np.ndarray) -> None:
        size = self.shape[1]
        wy = y if w is None else w * y
        if self.whole:
            count, total = float(y.size if w is None else w.sum()), float(wy.sum())
            if self.rows + count >= PACKED_ROWS or self.total + total >= PACK:
                self._unpack()
            self.rows, self.total = self.rows + count, self.total + total
            weights = [(1.0 if w is None else w) * PACK + wy, wy * y]
            if count >= PACKED_ROWS or total >= PACK:
                # too large to share a double, even alone
                weights = [np.ones(y.size) if w is None else w, wy, wy * y]
        else:
            weights = [w, wy, wy * y]
        into = self.held if len(weights) == len(self.held) else np.zeros((3, *self.shape))
        for f in range(self.shape[0]):
            at = bins[f] if rows is None else bins[f][rows]
            at = at.astype(np.int64) if base is None else base + at
            for k, x in enumerate(weights):
                into[k, f] += np.bincount(at, x, size)
        if into is not self.held:
            self._unpack(into)

    def _unpack(self, more: np.ndarray | None = None) -> None:
        out = np.zeros((3, *self.shape)) if self.done is None else self.done
        if more is not None:
            out += more
        else:
            count = np.floor(self.held[0] / PACK)
            out[0] += count
            out[1] += self.held[0] - count * PACK
            out[2] += self.held[1]
            self.held[:] = 0.0
        self.done, self.rows, self.total = out, 0.0, 0.0

    def result(self) -> np.ndarray:
        if self.whole:
            self._unpack()
        return self.done if self.whole else self.held


def histograms(chunks: Iterable[tuple], trees: dict[int, Tree], widths: tuple[int, int], whole: bool, label=None) -> Iterator[tuple[int, np.ndarray]]:
    """(tree, histograms of its counted nodes) of a partition's rows.  ``chunks``: bins, labels and, for a forest, how often each tree draws a row."""
    features, width = widths
    sums = {t: Sums(features, width, len(tree.plan.counted), whole) for t, tree in trees.items()}
    for bins, y, *more in chunks:
        y = np.frombuffer(y)
        bins = np.frombuffer(bins, np.uint8).reshape(features, y.size)
        counts = np.frombuffer(more[0], np.uint8).reshape(-1, y.size) if more and label is None else None
        if label is not None:
            y = label(y, *more)
        for t, tree in trees.items():
            level = tree.plan.level
            if counts is None and level == 0:
                sums[t].add(bins, None, None, None, y)
                continue
            rows = np.arange(y.size) if counts is None else np.flatnonzero(counts[t])
            rows, node = _route(tree, rows, bins, level)
            node -= 1 << level
            slot = tree.plan.slot[node]
            if slot.size and slot.min() < 0:
                wanted = slot >= 0
                rows, slot = rows[wanted], slot[wanted]
            slot *= width
            sums[t].add(bins, rows, slot, None if counts is None else counts[t][rows].astype(np.float64), y[rows])
    for t in list(sums):
        yield t, sums.pop(t).result().reshape(3, features, -1, width)


def _small(found: Iterable[tuple[int, np.ndarray]], whole: bool) -> Iterator[tuple[int, tuple]]:
    """Whole numbers in four bytes, for the shuffle."""
    for t, sums in found:
        yield t, ("sum", [x.astype(np.int32) if whole and x.max(initial=0.0) < 2 ** 31 else x for x in sums])


def completed(plan: Plan, counted: np.ndarray, above: np.ndarray | None) -> np.ndarray:
    """Histograms of all open nodes of a level: those counted, and what their siblings leave of the parent."""
    if not plan.derived:
        return counted
    out = np.empty((*counted.shape[:2], len(plan.counted) + len(plan.derived), counted.shape[3]))
    out[:, :, plan.counted] = counted
    place, parent, sibling = (list(x) for x in zip(*plan.derived))
    out[:, :, place] = above[:, :, parent] - out[:, :, sibling]
    return out


def best_splits(sums: np.ndarray, impurity: np.ndarray | None, splits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node: the largest gain, its feature and threshold, and the sums left and right of it.  The first of
    equal gains in the order of features and thresholds, as in Spark ML."""
    left = sums.cumsum(axis=3)
    total, left = left[..., -1:], left[..., :-1]
    right = total - left
    valid = (left[0] >= 1) & (right[0] >= 1) & (np.arange(left.shape[3]) < splits[:, None, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        if impurity is None:
            impurity = variance(*(left[:, 0, :, 0] + right[:, 0, :, 0]))
        n = left[0] + right[0]
        gain = (impurity[:, None] - left[0] / n * variance(*left)) - right[0] / n * variance(*right)
    gain = np.where(valid & (gain >= 0.0), gain, INVALID)
    flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    best, nodes = flat.argmax(axis=1), np.arange(flat.shape[0])
    f, s = np.divmod(best, left.shape[3])
    return flat[nodes, best], f, s, left[:, f, nodes, s], right[:, f, nodes, s], total[:, 0, :, 0]


def apply_splits(tree: Tree, found: tuple[np.ndarray, ...], depth: int, derive_from: int) -> None:
    """Writes a level's splits into the tree and plans the next level.  The larger of two siblings is derived if it has
    ``derive_from`` rows: any, where sums are exact, else so many that the last bits do not decide between unlike splits."""
    gain, f, s, left, right, total = found
    level, children = tree.plan.level, []
    for i, node in enumerate(tree.open):
        if level == 0:
            tree.stats[node] = tuple((left[:, i] + right[:, i] if gain[i] != INVALID else total[:, i]).tolist())
        tree.gain[node] = float(gain[i])
        if gain[i] <= 0:
            continue
        tree.feature[node], tree.cut[node] = f[i], s[i]
        below = []
        for child, stats in ((2 * node, left[:, i]), (2 * node + 1, right[:, i])):
            tree.stats[child] = tuple(stats.tolist())
            if level + 1 < depth and abs(variance(*tree.stats[child])) >= EPSILON:
                below.append(child)
        if below:
            children.append((i, below))
    opened = [x for _, below in children for x in below]
    slot, counted, derived, places = np.full(1 << (level + 1), -1, np.int64), [], [], {x: k for k, x in enumerate(opened)}
    for parent, below in children:
        least = min(below, key=lambda x: tree.stats[x][0])
        for x in below:
            if x != least and tree.stats[x][0] >= derive_from:
                derived.append((places[x], parent, places[least]))
            else:
                slot[x - (1 << (level + 1))] = len(counted)
                counted.append(places[x])
    tree.open = opened
    tree.plan = Plan(level + 1, slot, counted, derived, np.array([variance(*tree.stats[x]) for x in opened]))


def searched(records: Iterable[tuple[int, tuple]], trees: dict[int, Tree], splits: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple]]:
    """Sums of the partitions' histograms, a tree at a time: (tree, histograms of the open nodes, best splits)."""
    sums, above = {}, {}
    for t, (kind, x) in records:
        if kind == "above":
            above[t] = x
        elif t in sums:
            for k in range(3):
                sums[t][k] += x[k]
        else:
            sums[t] = np.array(x, np.float64)
    for t in sorted(sums):
        plan = trees[t].plan
        full = completed(plan, sums.pop(t), above.pop(t, None))
        yield t, full, best_splits(full, plan.impurity, splits)


def forest_sums(chunks, trees, widths, whole):
    return _small(histograms(chunks, trees, widths, whole), whole)


def parents(record, wanted):
    return [(record[0], ("above", record[1]))] if record[0] in wanted else []


def _residual(y: np.ndarray, predicted: bytes) -> np.ndarray:
    return 2.0 * (y - np.frombuffer(predicted))


def advanced(chunk: tuple, tree: Tree, leaf: np.ndarray, weight: float, features: int, depth: int) -> tuple:
    """A chunk whose predictions have the tree's added."""
    bins, y, *before = chunk
    rows = len(y) // 8
    cells = np.frombuffer(bins, np.uint8).reshape(features, rows)
    at, node = np.arange(rows), np.ones(rows, np.int64)
    for _ in range(depth):
        f = tree.feature[node]
        inner = np.flatnonzero(f >= 0)
        at, here = inner, node[inner]
        node[inner] = 2 * here + (cells[f[inner], at] > tree.cut[here])
        if not inner.size:
            break
    step = leaf[node] * weight
    return bins, y, (np.frombuffer(before[0]) + step if before else step).tobytes()


def read(chunks) -> None:
    for _ in chunks:
        pass


def boosting_sums(chunks, trees, widths, whole, residuals):
    return [sums for _, sums in histograms(chunks, trees, widths, whole, _residual if residuals else None)]


def leaf_stats(tree: Tree) -> dict[int, tuple]:
    """Sums of the nodes without a split."""
    return {node: stats for node, stats in tree.stats.items() if node >= tree.feature.size or tree.feature[node] < 0}


def step_of(tree: Tree, depth: int, weight: float, features: int) -> dict:
    """What ``advanced`` needs of a tree: also the nodes of the last level, and the leaves' predictions."""
    more, leaf = 1 << depth, np.zeros(2 << depth)
    for node, (count, total, _) in leaf_stats(tree).items():
        leaf[node] = total / count
    wide = Tree(np.concatenate([tree.feature, np.full(more, -1, np.int64)]), np.concatenate([tree.cut, np.zeros(more, np.uint8)]))
    return {"tree": wide, "leaf": leaf, "weight": weight, "features": features, "depth": depth}


# -- few rows, in one task -----------------------------------------------------

def grown_alone(chunks: list[tuple], t: int, widths: tuple[int, int], splits: np.ndarray, depth: int, whole: bool, derive_from: int, label=None) -> Tree:
    """A tree grown from all rows at once."""
    tree, above = new_tree(depth), None
    for _ in range(depth):
        counted = dict(histograms(chunks, {t: tree}, widths, whole, label))[t]
        above = completed(tree.plan, counted, above)
        apply_splits(tree, best_splits(above, tree.plan.impurity, splits), depth, derive_from)
        if not tree.open:
            break
    tree.plan = None
    return tree


def boosted_alone(chunks: list[tuple], rounds: int, step: float, widths: tuple[int, int], splits: np.ndarray, depth: int, whole: bool, derive_from: int) -> list[Tree]:
    out = []
    for m in range(rounds):
        exact = whole and not m
        out.append(grown_alone(chunks, 0, widths, splits, depth, exact, 0 if exact else derive_from, _residual if m else None))
        more = step_of(out[-1], depth, step if m else 1.0, widths[0])
        chunks = [advanced(chunk, **more) for chunk in chunks]
    return out
