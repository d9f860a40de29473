"""Linear models from mergeable centred moments.

``moments_by`` reduces any number of rows to one accumulator a key: the row count,
the column means and the centred co-products.  Accumulators of disjoint rows add up
exactly (the pairwise update of means and co-products), so one scan by
hash bucket, fold, season or segment serves every training set that is a union of
those keys.  Ridge, least squares and whole lasso paths are then solved on the small
matrices, and all models of an experiment score in one pass over the rows.

Rows with a NULL or NaN in any column are left out.  A column without spread gets
coefficient 0.  Models of a few keys (folds, buckets, sweeps) are solved on the driver from
matrices of fixed size; models a segment are solved in tasks, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import ship_package

c = F.col

SALTS = 16              # shares of a key's accumulators that are added up first
HELD = 1024             # accumulators that a task keeps before it hands them on


@dataclass(frozen=True)
class Moments:
    """n rows, column means and the sums of centred products."""
    n: float
    mean: np.ndarray
    co: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        d = x - mean
        return Moments(float(len(x)), mean, d.T @ d)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.co + other.co + np.outer(gap, gap) * (self.n * other.n / n))

    def take(self, at: Sequence[int]) -> Moments:
        at = np.asarray(at, int)
        return Moments(self.n, self.mean[at], self.co[np.ix_(at, at)])

    def scale(self) -> np.ndarray:
        """Sample standard deviations; 0 for columns whose spread is rounding error."""
        var = np.diag(self.co) / max(self.n - 1, 1)
        return np.where(var > 1e-24 * np.maximum(1, self.mean ** 2), np.sqrt(np.maximum(var, 0)), 0.0)


def _state(keys: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*keys, T.StructField("n", T.DoubleType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
                         T.StructField("co", T.ArrayType(T.DoubleType()))])


def _batch(rows: list[tuple[tuple, Moments]], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*[k for k, _ in rows]), [m.n for _, m in rows], [m.mean for _, m in rows], [m.co.ravel() for _, m in rows]]
    return pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(columns, schema)], schema=schema)


def moments_by(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., n, mean, co): one accumulator a key over the complete rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    ship_package(spark)
    kind = _state([df.schema[k] for k in by])
    arrow, width = to_arrow_schema(kind), len(by)
    salted = T.StructType([*kind.fields, T.StructField("salt", T.IntegerType())])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            x = batch.column(width).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            whole = np.flatnonzero(~np.isnan(x).any(axis=1))
            keys: dict[tuple, list[int]] = {}
            own = list(zip(*[col.to_pylist() for col in batch.columns[:width]])) if width else [()] * len(x)
            for i in whole.tolist():
                keys.setdefault(own[i], []).append(i)
            for key, at in keys.items():
                m = Moments.of(x[at])
                held[key] = held[key] + m if key in held else m
            if len(held) > HELD:
                yield _batch(list(held.items()), arrow)
                held = {}
        if held:
            yield _batch(list(held.items()), arrow)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, total = None, None
        for batch in batches:
            for row in zip(*[col.to_pylist() for col in batch.columns]):
                key, (n, mean, co) = row[:width], row[width:width + 3]
                m = Moments(n, np.array(mean), np.array(co).reshape(len(mean), -1))
                if key != open_key and total is not None:
                    yield _batch([(open_key, total)], arrow)
                    total = None
                open_key, total = key, m if total is None else total + m
        if total is not None:
            yield _batch([(open_key, total)], arrow)

    # one array instead of many renamed columns: the optimiser's constraints grow with every renaming
    values = df.select(*by, F.array(*[c(f"`{x}`").cast("double") for x in columns]).alias("_x"))
    parts = values.mapInArrow(reduce_rows, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = parts.select(*salted.fieldNames()).repartition(shares, *by, "salt").sortWithinPartitions(*by, "salt").mapInArrow(merge, kind)
    if not width:
        return some.coalesce(1).mapInArrow(merge, kind)     # at most SALTS rows of fixed size
    return some.repartition(shares, *by).sortWithinPartitions(*by).mapInArrow(merge, kind)


def collect(moments: DataFrame) -> dict[tuple, Moments]:
    """Accumulators on the driver: for keys of bounded number (folds, buckets, splits)."""
    return {tuple(r)[:-3]: Moments(r["n"], np.array(r["mean"]), np.array(r["co"]).reshape(len(r["mean"]), -1)) for r in moments.collect()}


def total(held: Mapping[tuple, Moments], keep=lambda key: True) -> Moments | None:
    """The accumulator of all keys that ``keep`` admits; None without any."""
    parts = [held[k] for k in sorted(held, key=repr) if keep(k)]
    return reduce(add, parts) if parts else None


@dataclass(frozen=True)
class Linear:
    intercept: float
    coef: np.ndarray        # in the units of the columns

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + x @ self.coef

    def column(self, features: Sequence[str]) -> Column:
        terms = [c(f) * F.lit(float(w)) for f, w in zip(features, self.coef) if w]
        return reduce(add, terms, F.lit(float(self.intercept)))

    def mse(self, m: Moments) -> float:
        """Mean squared error over the rows of an accumulator (features, then label)."""
        w = np.append(-self.coef, 1.0)
        bias = m.mean @ w - self.intercept
        return float(w @ m.co @ w / m.n + bias * bias)


def _standard(m: Moments, scale: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled co-products of the features, of features and label, and the scale with 1 for 0."""
    scale = m.scale()[:-1] if scale is None else scale
    safe = np.where(scale > 0, scale, 1.0)
    alive = scale > 0
    zz = m.co[:-1, :-1] / np.outer(safe, safe) * np.outer(alive, alive)
    return zz, m.co[:-1, -1] / safe * alive, safe


def _back(m: Moments, w: np.ndarray, safe: np.ndarray) -> Linear:
    coef = w / safe
    return Linear(float(m.mean[-1] - m.mean[:-1] @ coef), coef)


def ridge(m: Moments, alpha: float) -> Linear:
    """M4: least ||y - Zw||^2 + alpha ||w||^2 over standardised features; the label is the last column."""
    zz, zy, safe = _standard(m, None)
    return _back(m, np.linalg.solve(zz + alpha * np.eye(len(zy)), zy) if alpha else np.linalg.lstsq(zz, zy, rcond=None)[0], safe)


def lasso_path(m: Moments, alphas: Sequence[float], scale: np.ndarray | None = None, tol: float = 1e-10, rounds: int = 40) -> list[Linear]:
    """M5: least (1/2n) ||y - Zw||^2 + alpha ||w||_1 for each alpha, by coordinate
    descent on the co-products, from the largest alpha down, each started at the last
    solution.  After every few sweeps the signs found are tried in closed form, which
    is the solution if they hold; else descent goes on until the duality gap is below
    ``tol`` of the label's variance, or ``rounds`` are over (collinear columns)."""
    zz, zy, safe = _standard(m, scale)
    zz, zy, yy = zz / m.n, zy / m.n, max(m.co[-1, -1] / m.n, 1e-300)
    size, w = np.diag(zz).copy(), np.zeros(len(zy))
    fit, out = np.zeros(len(zy)), {}       # fit = zz @ w
    usable = np.flatnonzero(size > 0)

    def sweep(at: np.ndarray, alpha: float) -> None:
        for j in at.tolist():
            pull = zy[j] - fit[j] + size[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / size[j]
            if (gap := new - w[j]):
                fit[:] += zz[j] * gap
                w[j] = new

    def closed_form(alpha: float) -> bool:
        at = np.flatnonzero(w)
        signs, trial = np.sign(w[at]), np.zeros(len(w))
        if len(at):
            trial[at] = np.linalg.lstsq(zz[np.ix_(at, at)], zy[at] - alpha * signs, rcond=None)[0]
        pull = zy - zz @ trial
        slack = 1e-10 * np.sqrt(yy)
        good = (np.sign(trial[at]) == signs).all() and (np.abs(pull) <= alpha + slack).all() and (np.abs(pull[at] - alpha * signs) <= slack).all()
        if good:
            w[:] = trial
        return bool(good)

    def duality_gap(alpha: float) -> float:
        rest, along = yy - 2 * zy @ w + w @ fit, yy - zy @ w
        shrink = min(1.0, alpha / max(np.abs(zy - fit).max(initial=0.0), 1e-300))
        return rest / 2 + alpha * np.abs(w).sum() - (shrink * along - shrink * shrink * rest / 2)

    for k in sorted(range(len(alphas)), key=lambda k: -alphas[k]):
        for _ in range(rounds):
            sweep(usable, alphas[k])
            for _ in range(4):
                sweep(np.flatnonzero(w), alphas[k])
            fit[:] = zz @ w
            if closed_form(alphas[k]) or duality_gap(alphas[k]) <= tol * yy:
                break
        fit[:] = zz @ w
        out[k] = _back(m, w.copy(), safe)
    return [out[k] for k in range(len(alphas))]


def lasso_cv(folds: Mapping[tuple, Moments], alphas: Sequence[float]) -> tuple[list[float], Linear, int]:
    """M6: mean squared error of each alpha over the folds, the model of the best alpha
    over all rows and its place.  Features are scaled once, over all rows, and a fold's
    error comes from its own accumulator, so no row is read again."""
    whole = total(folds)
    scale = whole.scale()[:-1]
    errors = np.zeros(len(alphas))
    for key, held in sorted(folds.items(), key=repr):
        rest = total(folds, lambda k: k != key)
        errors += [model.mse(held) for model in lasso_path(rest, alphas, scale)]
    errors /= len(folds)
    best = int(np.argmin(errors))
    return errors.tolist(), lasso_path(whole, alphas)[best], best


def standardised(model: Linear, m: Moments) -> np.ndarray:
    """The coefficients that the model has on standardised features."""
    return model.coef * m.scale()[:-1]


def score_all(df: DataFrame, models: Mapping[str, tuple[Linear, Sequence[str]]], label: str, keep: Sequence[str] = (),
              name: str = "model") -> DataFrame:
    """(name, keep..., actual, predicted) of every row under every model: one pass."""
    each = F.array(*[F.struct(F.lit(k).alias(name), m.column(f).alias("predicted")) for k, (m, f) in models.items()])
    return df.select(*keep, c(label).cast("double").alias("actual"), F.explode(each).alias("_m")).select(f"_m.{name}", *keep, "actual", "_m.predicted")


def ridge_by(moments: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """(by..., intercept, coef): one ridge model a key, solved in tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([*[moments.schema[k] for k in by], T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))])
    arrow, width = to_arrow_schema(kind), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*[col.to_pylist() for col in batch.columns]):
                m = Moments(row[width], np.array(row[width + 1]), np.array(row[width + 2]).reshape(len(row[width + 1]), -1))
                model = ridge(m, alpha)
                out.append((*row[:width], model.intercept, model.coef))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return moments.select(*by, "n", "mean", "co").mapInArrow(run, kind)


def score_by(df: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(by..., keep..., predicted) by the key's model of ``ridge_by``; rows of keys without one are left out."""
    rows = df.select(*by, *keep, F.array(*[c(f).cast("double") for f in features]).alias("_x"))
    dot = F.aggregate(F.zip_with("_x", "coef", lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
    return rows.join(models, list(by)).select(*by, *keep, (c("intercept") + dot).alias("predicted"))
