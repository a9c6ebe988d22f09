"""Beta distributions by numeric integration, as Column expressions (all but the batch form stay in the JVM).

A distribution is a table over a grid that is even in the log-odds of the rate, where its density is smooth
and falls off exponentially whatever the parameters. Quantiles are read off the running integral; the
probability of being the best of several is the integral of the others' distribution functions over
its own, taken over the points of all their grids, so distributions of very different width meet.
Symmetric inputs give symmetric answers: equal distributions are equally likely to be the best.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = 128
# Rows of a batch that are integrated at a time: some 0.8 MB for each array over all points.
CHUNK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reach(z: Column) -> Column:
    """How far the log of a Gamma(z) variable lies below that of its mean, tails of some 1e-5 left out."""
    return 4.5 / F.sqrt(z) + 8 / z


def _log_odds_density(y: Column, a: Column, b: Column, peak: Column) -> Column:
    """Density in log-odds ``y``, as a share of the highest one."""
    small = F.log1p(F.exp(-F.abs(y)))
    return F.exp(-a * (F.greatest(-y, F.lit(0.0)) + small) - b * (F.greatest(y, F.lit(0.0)) + small) - peak)


def beta_table(a: Column, b: Column, low: float, high: float) -> Column:
    """Beta(a, b), both positive, as (lo, step, below, lower, upper).

    ``below`` is the distribution function at each point of the grid, ``lower`` and ``upper`` the ``low`` and
    ``high`` quantiles.
    """
    grid = F.struct(
        a.alias("a"), b.alias("b"),
        (F.log(a / b) - _reach(a) - F.log1p(_reach(b))).alias("lo"),
        ((_reach(a) + F.log1p(_reach(b)) + _reach(b) + F.log1p(_reach(a))) / POINTS).alias("step"),
        (a * F.log(a / (a + b)) + b * F.log(b / (a + b))).alias("peak"),
    )
    points = F.sequence(F.lit(0), F.lit(POINTS))

    def density(g: Column) -> Column:
        return F.transform(points, lambda k: _log_odds_density(g["lo"] + g["step"] * k, g["a"], g["b"], g["peak"]))

    def running(d: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.lit(POINTS)), lambda k: (F.get(d, k) + F.get(d, k - 1)) / 2)
        return F.aggregate(steps, F.array(F.lit(0.0)), lambda total, x: F.concat(total, F.array(F.element_at(total, -1) + x)))

    def quantile(g: Column, below: Column, q: float) -> Column:
        def between(k: Column) -> Column:
            first = F.get(below, k - 1)
            return 1 / (1 + F.exp(-(g["lo"] + g["step"] * (k - 1 + (q - first) / (F.get(below, k) - first)))))

        return let(F.size(F.filter(below, lambda c: c < q)), between)

    def finish(g: Column, below: Column) -> Column:
        return F.struct(g["lo"].alias("lo"), g["step"].alias("step"), below.alias("below"),
                        quantile(g, below, low).alias("lower"), quantile(g, below, high).alias("upper"))

    def shares(total: Column) -> Column:
        return F.transform(total, lambda c: c / F.element_at(total, -1))

    return let(grid, lambda g: let(density(g), lambda d: let(running(d), lambda total: let(shares(total), lambda below: finish(g, below)))))


def _below(table: Column, y: Column) -> Column:
    """The distribution function at log-odds ``y``, linear between the points of its grid."""
    def at(place: Column) -> Column:
        k = F.floor(place).cast("int")
        first = F.get(table["below"], k)
        return F.when(place <= 0, 0.0).when(place >= POINTS, 1.0).otherwise(first + (place - k) * (F.get(table["below"], k + 1) - first))

    return let((y - table["lo"]) / table["step"], at)


def best_probabilities(tables: Column) -> Column:
    """For an array of tables, each one's probability of holding the highest rate; they add up to 1.

    The integral runs over the points of all grids, so that a narrow distribution is resolved beside a wide one.
    """
    def others(values: Column) -> Column:
        return F.transform(values, lambda own, i: F.aggregate(
            F.transform(values, lambda x, j: F.when(i == j, 1.0).otherwise(x)), F.lit(1.0), lambda product, x: product * x))

    def integral(values: Column, beaten: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(values) - 1)
        return F.transform(F.get(values, F.lit(0)), lambda own, i: F.aggregate(steps, F.lit(0.0), lambda total, m: total + (
            F.get(F.get(values, m), i) - F.get(F.get(values, m - 1), i)) * (F.get(F.get(beaten, m), i) + F.get(F.get(beaten, m - 1), i))))

    def shares(raw: Column) -> Column:
        total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
        return F.transform(raw, lambda x: x / total)

    grid = F.sequence(F.lit(0), F.lit(POINTS))
    points = F.sort_array(F.flatten(F.transform(tables, lambda t: F.transform(grid, lambda k: t["lo"] + t["step"] * k))))
    at = let(points, lambda ys: F.transform(ys, lambda y: F.transform(tables, lambda t: _below(t, y))))
    return let(at, lambda values: let(F.transform(values, others), lambda beaten: let(integral(values, beaten), shares)))


def _tables(a: np.ndarray, b: np.ndarray, low: float, high: float) -> tuple[np.ndarray, ...]:
    """``beta_table`` of arrays of parameters: (lo, step, below, lower, upper), ``below`` with an axis of points more."""
    def reach(z: np.ndarray) -> np.ndarray:
        return 4.5 / np.sqrt(z) + 8 / z

    lo = np.log(a / b) - reach(a) - np.log1p(reach(b))
    step = (reach(a) + np.log1p(reach(b)) + reach(b) + np.log1p(reach(a))) / POINTS
    peak = a * np.log(a / (a + b)) + b * np.log(b / (a + b))
    y = lo[..., None] + step[..., None] * np.arange(POINTS + 1)
    small = np.log1p(np.exp(-np.abs(y)))
    d = np.exp(-a[..., None] * (np.maximum(-y, 0) + small) - b[..., None] * (np.maximum(y, 0) + small) - peak[..., None])
    below = np.zeros_like(d)
    np.cumsum((d[..., 1:] + d[..., :-1]) / 2, axis=-1, out=below[..., 1:])
    below /= below[..., -1:]

    def quantile(q: float) -> np.ndarray:
        k = (below < q).sum(axis=-1, keepdims=True)
        first, second = (np.take_along_axis(below, at, -1)[..., 0] for at in (k - 1, k))
        return 1 / (1 + np.exp(-(lo + step * (k[..., 0] - 1 + (q - first) / (second - first)))))

    return lo, step, below, quantile(low), quantile(high)


def _integrals(lo: np.ndarray, step: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The integrals of ``best_probabilities`` for n rows of k tables: lo and step (n, k), below (n, k, POINTS + 1)."""
    n, k = lo.shape
    y = np.sort((lo[:, :, None] + step[:, :, None] * np.arange(POINTS + 1)).reshape(n, -1), axis=1)
    at = np.clip((y[:, None, :] - lo[:, :, None]) / step[:, :, None], 0, POINTS)
    left = np.minimum(at.astype(np.int32), POINTS - 1)
    at -= left
    # Places in the table of all rows: one lookup each instead of one along an axis.
    left += (np.arange(n * k, dtype=np.int32) * (POINTS + 1)).reshape(n, k, 1)
    first = below.reshape(-1)[left]
    own = first + at * (below.reshape(-1)[left + 1] - first)
    raw = np.empty((n, k))
    for i in range(k):
        others = np.ones_like(y)
        for j in range(k):
            if j != i:
                others *= own[:, j]
        raw[:, i] = (np.diff(own[:, i], axis=1) * (others[:, 1:] + others[:, :-1])).sum(axis=1)
    return raw / raw.sum(axis=1, keepdims=True)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _integrated(lo: pd.Series, step: pd.Series, below: pd.Series) -> pd.Series:
    out = []
    for at in range(0, len(lo), CHUNK):
        a, b, c = (np.stack(x.iloc[at:at + CHUNK].to_numpy()) for x in (lo, step, below))
        out.extend(_integrals(a, b, c.reshape(*a.shape, POINTS + 1)))
    return pd.Series(out, dtype=object)


def best_probabilities_in_batches(tables: Column) -> Column:
    """``best_probabilities`` where very many rows have equally many tables: the same integral over Arrow batches.

    Functions over arrays are interpreted node by node: a stage took some 12 ms a row of five tables, and 2 ms so.
    """
    return _integrated(tables["lo"], tables["step"], F.flatten(tables["below"]))


def summaries_in_batches(a: Column, b: Column, low: float, high: float) -> Column:
    """Interval and probability of being best for arrays of parameters, equally many in each row, as a struct of arrays.

    Tables are made and integrated within one Arrow batch, so that none (1 KB each) is shuffled or handed to Python.
    """
    @F.pandas_udf("lower array<double>, upper array<double>, prob_best array<double>")
    def summed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(a), CHUNK):
            lo, step, below, lower, upper = _tables(*(np.stack(x.iloc[at:at + CHUNK].to_numpy()) for x in (a, b)), low, high)
            out.extend(zip(lower, upper, _integrals(lo, step, below)))
        return pd.DataFrame(out, columns=["lower", "upper", "prob_best"], dtype=object)

    return summed(a, b)
