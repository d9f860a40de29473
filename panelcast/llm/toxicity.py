"""Toxicity: character n-gram classifier on naive Bayes log-count ratios.

A document's features are the distinct character n-grams of its lower-cased
text, hashed.  Each is scaled by its log-count ratio between toxic and clean
training documents, shrunk smoothly where chance may have made it, and a logistic model is fitted to the scaled
features by stochastic gradient descent in numpy.  No n-gram is cut.

The model is fitted on a sample bounded by a parameter (rows per class); tasks
send each sample document's buckets, as deflated gaps or as a bitmap, whichever is smaller: at most ``buckets`` / 8 bytes a row,
however long the texts are.  The driver holds the packed rows and opens one at a time.
The classes' shares among all admitted labels are put back through the bias.
Every text is scored whole.  Null and empty texts have no features: their
score comes from the bias.  Very long texts are hashed in stretches.  Repeated rows are scored each;
the smallest text of an id is its sample row.  An empty table gives no rows.  Null labels are no sample rows; of repeated label
rows the largest label of an id counts.  Without two classes in the sample the
score is the mean label (0.5 without any).  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import code_points, keep_rows, map_rows
from panelcast.llm.subwords import sample_labels

BUCKETS, SIZES, STRETCH = 1 << 18, (2, 3, 4, 5, 6), 1 << 16


def gram_buckets(text: str | None, buckets: int, sizes: tuple[int, ...], mark: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text's n-grams.  ``mark`` is a cleared bitmap of
    ``buckets``; it is cleared again.  Long texts go in overlapping stretches."""
    if not text:
        return np.zeros(0, np.int64)
    points = code_points(text.lower())
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    with np.errstate(over="ignore"):
        for lo in range(0, len(points), STRETCH):
            part = points[lo:lo + STRETCH + max(sizes) - 1]
            rolled = np.zeros(len(part), np.uint32)
            for n in range(1, max(sizes) + 1):
                tail = part[n - 1:]
                rolled = rolled[:len(tail)] * np.uint32(0x01000193) + tail
                if n in sizes:
                    mixed = (rolled + np.uint32(n)) * np.uint32(0x9E3779B1)
                    mark[(mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift] = True
    got = np.flatnonzero(mark)
    mark[got] = False
    return got


@dataclass(frozen=True)
class Model:
    weight: np.ndarray      # per bucket: fitted weight times log-count ratio
    bias: float
    buckets: int = BUCKETS
    sizes: tuple[int, ...] = SIZES

    def scores(self, texts: list[str | None]) -> np.ndarray:
        mark = np.zeros(self.buckets, bool)
        logit = np.array([self.weight[gram_buckets(t, self.buckets, self.sizes, mark)].sum() for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def log_ratios(seen: np.ndarray, seen_1: np.ndarray, n: int, ones: int, smoothing: float = 1.0,
               doubt: float = 6.0) -> np.ndarray:
    """Per bucket the log of its share of label 1 rows over its share of the others.

    A count among label 1 rows that lies z standard deviations from an even spread keeps z^4 / (z^4 + doubt^4)
    of its ratio: of 2^18 buckets many stand a few deviations off by chance, and a clear one keeps all of it.
    The share kept depends on the bucket's own counts, not on the sample's size; none is set to 0."""
    # document frequencies against the class sizes, so that text length does not tilt the ratio
    p, q = smoothing + seen_1, smoothing + seen - seen_1
    ratio = np.log(p / (ones + 2 * smoothing)) - np.log(q / (n - ones + 2 * smoothing))
    share = ones / n
    z4 = ((seen_1 - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9)) ** 2
    return np.where(seen > 0, ratio * (z4 / (z4 + doubt ** 4)), 0.0)


def pack(own: np.ndarray, buckets: int) -> bytes:
    """Distinct buckets, ascending,  as deflated gaps, or as a bitmap where that is no longer."""
    # a gap past 254 is written as 255s and the rest
    many, rest = np.divmod(np.diff(own, prepend=0), 255)
    steps = np.full(len(own) + int(many.sum()), 255, np.uint8)
    steps[np.cumsum(many + 1) - 1] = rest
    packed = zlib.compress(steps.tobytes(), 1)
    if len(packed) < buckets // 8:
        return packed
    mark = np.zeros(buckets, bool)
    mark[own] = True
    return np.packbits(mark).tobytes()


def unpack(packed: bytes, buckets: int) -> np.ndarray:
    if len(packed) < buckets // 8:
        steps = np.frombuffer(zlib.decompress(packed), np.uint8)
        return np.cumsum(steps, dtype=np.int32)[steps < 255]
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), count=buckets)).astype(np.int32)


def train(rows: list[tuple[bytes, int]], prior: float, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES,
          penalty: float = 1e-4, epochs: int = 8, batch: int = 100, reach: float = 10.0) -> Model:
    """Fit on (packed buckets, label) rows of both labels, whose classes weigh the same;
    ``prior`` is the share of label 1 to calibrate for.  A first step moves the score of a row of mean
    length by about ``reach``, so that no row is settled at once.  Memory: the packed rows, one row opened and
    a few arrays of ``buckets``."""
    y = np.array([r[1] for r in rows], np.float64)
    n, ones = len(y), int(y.sum())
    seen, seen_1 = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for packed, label in rows:
        own = unpack(packed, buckets)
        seen[own] += 1
        seen_1[own] += label
    ratio = log_ratios(seen, seen_1, n, ones)
    rate = reach / max(float(seen @ np.abs(ratio)) / n, 1e-9)
    side = np.where(y > 0, 0.5 / ones, 0.5 / (n - ones)) * n
    weight, bias, g_weight, g_bias = np.zeros(buckets), 0.0, np.full(buckets, 1e-8), 1e-8
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(n), max(1, -(-n // batch))):
            grad, err = np.zeros(buckets), np.zeros(len(part))
            for k, i in enumerate(part):
                own = unpack(rows[i][0], buckets)
                value = ratio[own]
                logit = np.cumsum(value * weight[own])[-1:].sum() + bias
                err[k] = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[i]) * side[i] / len(part)
                grad[own] += value * err[k]
            grad += penalty * weight
            g_weight += grad ** 2
            g_bias += err.sum() ** 2
            weight -= rate * grad / np.sqrt(g_weight)
            bias -= 0.1 * err.sum() / np.sqrt(g_bias)
    return Model(weight * ratio, float(bias + np.log(prior / (1 - prior))), buckets, sizes)


def fit(docs: DataFrame, labels: DataFrame, label: str, ok: F.Column, rows_per_class: int = 1500,
        buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, prior: float | None = None) -> Model:
    """Fit on labelled rows of ``docs`` (doc_id, text) that ``ok`` admits;
    ``prior`` overrides the share of label 1 among them.  The driver gets the sample rows' packed
    buckets: with these defaults at most 3,000 x 32 kB."""
    sample = F.broadcast(sample_labels(labels, label, rows_per_class, ok))     # at most 2 x rows_per_class ids
    # one row of each id, whatever repeats
    chosen = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("label").alias("label"))

    def grams(cols):
        mark = np.zeros(buckets, bool)
        for doc_id, text, y in zip(*cols):
            yield doc_id, pack(gram_buckets(text, buckets, sizes, mark), buckets), y

    packed = map_rows(chosen, grams, "doc_id long, buckets binary, label int")
    # one row an id, so the id alone orders them
    rows = [r[1:] for r in sorted((r[0], bytes(r[1]), r[2]) for r in packed.collect())]
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        mean = float(np.clip(ones / len(rows) if rows else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros(buckets), float(np.log(mean / (1 - mean))), buckets, sizes)
    if prior is None:
        n = {r[0]: r[1] for r in labels.where(ok & F.col(label).isin(0, 1)).groupBy(label).count().collect()}
        prior = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    return train(rows, prior, buckets, sizes)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # buckets x 8 bytes, whatever the data

    def run(cols):
        return zip(cols[0], shared.value.scores(cols[1]).tolist())

    return map_rows(docs.select("doc_id", text), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda texts: shared.value.scores(texts) < threshold)
