"""Quality classifier: supervised subword embeddings.

Every word occurrence stands for its features: the word, its character
n-grams between word marks, its shape, and whether it repeats the word before.  Features are
hashed to a table of vectors; a document is the mean of its features' vectors,
a softmax over a linear output layer gives the class probabilities, and table
and layer are learned by mini-batch stochastic gradient descent in numpy.

The model is fitted on a sample that is bounded by a parameter (rows per
class); tasks turn its texts into bucket counts, so that the driver
gets at most ``rows x buckets`` pairs whatever the texts' length.  Every text
is scored whole.  Null and blank texts have no features: their score is the
softmax of the output layer's bias.  Rows with a null label are no sample
rows; of repeated label rows the largest label of an id counts.  Without two
classes in the sample the score is the mean label (0.5 without any).
Extra columns are ignored; repeated document rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import map_rows, mix64

BUCKETS, DIM, SIZES = 1 << 16, 8, (3, 4)


def vocabulary(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the texts' words as indexes into them,
    and where each text's words begin (with the end at last)."""
    known: dict[str, int] = {}
    codes: list[int] = []
    starts = [0]
    for text in texts:
        if text:
            codes += [known.setdefault(w, len(known)) for w in text.split()]
        starts.append(len(codes))
    return list(known), np.array(codes, np.int64), np.array(starts, np.int64)


class Memo:
    """Rows of numbers that ``compute`` makes of distinct words, remembered
    for at most ``limit`` words at a time."""

    def __init__(self, compute, limit: int = 300_000):
        self.compute, self.limit, self.known, self.rows, self.used = compute, limit, {}, None, 0

    def lookup(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, codes, starts): like ``vocabulary``, with the words' rows."""
        if len(self.known) > self.limit:
            self.known, self.rows, self.used = {}, None, 0
        known, codes, starts = self.known, [], [0]
        for text in texts:
            if text:
                codes += [known.setdefault(w, len(known)) for w in text.split()]
            starts.append(len(codes))
        if self.rows is None or len(known) > self.used:
            fresh = self.compute(list(islice(known, self.used, None)))
            need = self.used + len(fresh)
            if self.rows is None or need > len(self.rows):
                grown = np.empty((max(2 * need, 1024), fresh.shape[1]))
                if self.rows is not None:
                    grown[:self.used] = self.rows[:self.used]
                self.rows = grown
            self.rows[self.used:need] = fresh
            self.used = need
        return self.rows, np.array(codes, np.int64), np.array(starts, np.int64)


def gram_hashes(words: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of ``<word>`` and of the whole words, with
    the index of the word that each belongs to."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(joined))     # code points up to the word's end
    base = np.uint64(0x9E3779B97F4A7C15)
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(joined), np.uint64)
        for n in range(1, max(sizes) + 1):
            tail = joined[n - 1:]
            rolled = rolled[:len(tail)] * base + tail
            if n in sizes:
                inside = left[:len(tail)] >= n
                hashes.append(mix64(rolled[inside] + np.uint64(n)))
                owners.append(owner[:len(tail)][inside])
        # a whole word: its marked code points as a sum with position factors
        at = (lengths[owner] - left).astype(np.uint64)
        whole = np.add.reduceat(mix64(joined * base + at), ends - lengths)
    hashes.append(mix64(whole ^ np.uint64(0x5BD1E995)))
    owners.append(np.arange(len(words)))
    return np.concatenate(hashes), np.concatenate(owners)


_SHAPES: dict[int, int] = {}


def shape(word: str) -> str:
    """Runs of upper case, lower case, digits and other characters as one
    character each; other characters stand for themselves."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(words: list[str], buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' own features, and the word of each."""
    grams, owners = gram_hashes(words, sizes)
    shapes, of_word, _ = vocabulary([shape(w) for w in words])
    if len(of_word) != len(words):      # a shape with white space in it cannot be: words hold none
        raise ValueError("words must not hold white space")
    shape_hash = mix64(gram_hashes(shapes, (1,))[0][-len(shapes):] + np.uint64(77)) if shapes else np.zeros(0, np.uint64)
    hashes = np.concatenate([grams, shape_hash[of_word]]) if words else grams
    # two buckets are kept for the repeat feature
    return (hashes % np.uint64(buckets - 2)).astype(np.int64) + 2, np.concatenate([owners, np.arange(len(words))])


def repeats(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 where a word equals the word before it in its text, else 0."""
    same = np.zeros(len(codes), np.int64)
    same[1:] = codes[1:] == codes[:-1]
    same[starts[:-1][starts[:-1] < len(codes)]] = 0
    return same


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at ``starts`` (the last is the end)."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass(frozen=True)
class Model:
    weight: np.ndarray      # per bucket: its vector times the difference of the output layer's columns
    bias: float
    buckets: int = BUCKETS
    sizes: tuple[int, ...] = SIZES

    def per_word(self, known: list[str]) -> np.ndarray:
        """(words x 2) sums of the features' weights, and their counts."""
        if not known:
            return np.zeros((0, 2))
        bucket, owner = features(known, self.buckets, self.sizes)
        return np.stack([np.bincount(owner, self.weight[bucket], len(known)), np.bincount(owner, minlength=len(known))], 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of class 1.  The output layer is linear in the mean
        vector, so each bucket's share of the logit is one number."""
        memo = self.__dict__.setdefault("_memo", Memo(self.per_word))
        rows, codes, starts = memo.lookup(texts)
        again = repeats(codes, starts)
        total = sums(rows[codes, 0] + self.weight[again], starts)
        count = sums(rows[codes, 1] + 1, starts)
        logit = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}


def bucket_counts(texts: list[str | None], buckets: int, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    known, codes, starts = vocabulary(texts)
    bucket, owner = features(known, buckets, sizes)
    order = np.argsort(owner, kind="stable")
    bucket, begin = bucket[order], np.searchsorted(owner[order], np.arange(len(known) + 1))
    again, out = repeats(codes, starts), []
    for a, b in zip(starts[:-1], starts[1:]):
        words, times = np.unique(codes[a:b], return_counts=True)
        own = np.concatenate([bucket[begin[w]:begin[w + 1]] for w in words] or [np.zeros(0, np.int64)])
        got = np.bincount(own, np.repeat(times, begin[words + 1] - begin[words]), buckets) if len(own) else np.zeros(buckets)
        got[:2] += np.bincount(again[a:b], minlength=2)
        out.append((np.flatnonzero(got).astype(np.int32), got[got > 0].astype(np.int32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = DIM,
          sizes: tuple[int, ...] = SIZES, epochs: int = 20, batch: int = 64, rate: float = 0.15, seed: int = 7) -> Model:
    """Fit on (buckets, counts, label) rows; the order of rows has no
    influence beyond the seed's shuffle of the given order."""
    labels = np.array([r[2] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        mean = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros(buckets), float(np.log(mean / (1 - mean))), buckets, sizes)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = rng.uniform(-1 / dim, 1 / dim, (dim, 2)), np.zeros(2)
    # squared gradients so far scale the steps, as hashed features differ much in frequency
    g_table, g_layer, g_bias = np.full((buckets, 1), 1e-6, np.float32), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = [rows[i] for i in order[lo:lo + batch]]
            size = np.array([max(1, len(r[0])) for r in part])
            idx = np.concatenate([r[0] if len(r[0]) else np.zeros(1, np.int32) for r in part])
            val = np.concatenate([r[1] / r[1].sum() if len(r[0]) else np.zeros(1) for r in part]).astype(np.float32)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            hidden = np.add.reduceat(table[idx] * val[:, None], begin, axis=0)
            logits = hidden @ layer + bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            err = prob
            err[np.arange(len(part)), labels[order[lo:lo + batch]]] -= 1
            d_hidden = (err @ layer.T).astype(np.float32)
            d_layer, d_bias = hidden.T @ err, err.sum(0)
            used, where = np.unique(idx, return_inverse=True)
            share = d_hidden[np.repeat(np.arange(len(part)), size)] * val[:, None]
            d_table = np.stack([np.bincount(where, share[:, k], len(used)) for k in range(dim)], 1)
            g_table[used] += (d_table ** 2).mean(1, keepdims=True).astype(np.float32)
            g_layer += d_layer ** 2
            g_bias += d_bias ** 2
            table[used] -= (step * d_table / np.sqrt(g_table[used])).astype(np.float32)
            layer -= step * d_layer / np.sqrt(g_layer)
            bias -= step * d_bias / np.sqrt(g_bias)
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), buckets, sizes)


def sample_labels(labels: DataFrame, label: str, rows_per_class: int, ok: F.Column, doc_id: str = "doc_id") -> DataFrame:
    """At most ``rows_per_class`` ids of each class 0 and 1, by hash order:
    (doc_id, label).  Only two classes, so its size is bounded."""
    one = (labels.where(ok & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
           .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    return (one.where("label = 0").orderBy(*order).limit(rows_per_class)
            .unionByName(one.where("label = 1").orderBy(*order).limit(rows_per_class)))


def fit(docs: DataFrame, labels: DataFrame, label: str, ok: F.Column, rows_per_class: int = 1500,
        buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Model:
    """Fit on labelled rows of ``docs`` (doc_id, text) that ``ok`` admits.
    The sample is drawn evenly from both classes, so a score is the
    probability at equal shares of both."""
    sample = F.broadcast(sample_labels(labels, label, rows_per_class, ok))     # at most 2 x rows_per_class ids
    chosen = docs.select("doc_id", "text").join(sample, "doc_id")

    def count(cols):
        for doc_id, (bucket, times), mark in zip(cols[0], bucket_counts(cols[1], buckets, sizes), cols[2]):
            yield doc_id, bucket.tolist(), times.tolist(), mark

    got = map_rows(chosen, count, "doc_id long, bucket array<int>, times array<int>, label int").collect()
    got.sort(key=lambda r: (r[0], r[3], r[1], r[2]))
    return train([(np.array(r[1], np.int32), np.array(r[2], np.int32), r[3]) for r in got], buckets, sizes=sizes)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # buckets x 8 bytes, whatever the data

    def run(cols):
        return zip(cols[0], shared.value.scores(cols[1]).tolist())

    return map_rows(docs.select("doc_id", text), run, "doc_id long, score double")
