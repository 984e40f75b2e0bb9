"""Tail probabilities for test statistics; applied to one row per test, never to data rows.

Densities are written with Stirling remainders and deviances, so no large logarithms of gamma functions cancel, and
the tail is integrated by double-exponential quadrature, halving the step until two results agree. All terms
are positive: small probabilities keep their digits, and so do degrees of freedom up to 1e12 and beyond.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def stirling_remainder(n: float) -> float:
    """log n! less Stirling's (n + 1/2) log n - n + log(2 pi) / 2."""
    if n < 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI if n > 0 else 0.0
    square = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / square) / square) / square) / square) / n


def deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, also where the terms nearly cancel."""
    if x == 0:
        return mean
    v = (x - mean) / (x + mean)
    if abs(v) >= 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, n = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        n += 2
        following = total + term / n
        if following == total:
            return total
        total = following


def _binomial(x: float, n: float, p: float, q: float) -> float:
    """The binomial probability of x of n, extended to real x and n; q is 1 - p to full precision."""
    if x == 0:
        return math.exp(-deviance(n, n * q) - n * p if p < 0.1 else n * math.log(q)) if q > 0 else float(n == 0)
    if x == n:
        return math.exp(-deviance(n, n * p) - n * q if q < 0.1 else n * math.log(p)) if p > 0 else 0.0
    if p == 0 or q == 0:
        return 0.0
    logarithm = (stirling_remainder(n) - stirling_remainder(x) - stirling_remainder(n - x)
                 - deviance(x, n * p) - deviance(n - x, n * q))
    return math.exp(logarithm - _HALF_LOG_2PI - 0.5 * (math.log(x) + math.log1p(-x / n)))


def t_density(t: float, df: float) -> float:
    constant = -deviance(df / 2, (df + 1) / 2) + stirling_remainder((df + 1) / 2) - stirling_remainder(df / 2)
    if t * t > 1e300 * df:
        return 0.0
    ratio = math.log1p(t * t / df) / 2
    return math.exp(constant - df * ratio - ratio - _HALF_LOG_2PI)


def f_density(f: float, d1: float, d2: float) -> float:
    scale = d2 + f * d1
    q, p = d2 / scale, f * d1 / scale
    if d1 >= 2:
        return d1 * q / 2 * _binomial((d1 - 2) / 2, (d1 + d2 - 2) / 2, p, q)
    if p == 0:
        return 0.0
    return d1 * d1 * q / (2 * p * (d1 + d2)) * _binomial(d1 / 2, (d1 + d2) / 2, p, q)


def upper_tail(density: Callable[[float], float], start: float) -> float:
    """The integral of a density from ``start`` to infinity, to about 12 digits; an error if it does not settle."""
    def at(k: float) -> float:
        step = math.exp(math.pi / 2 * math.sinh(k))
        return density(start + step) * step * math.pi / 2 * math.cosh(k)

    reach, h = 5.0, 0.25
    total = sum(at(i * h) for i in range(-int(reach / h), int(reach / h) + 1))
    result = total * h
    for _ in range(8):
        h /= 2
        count = int(reach / h)
        total += sum(at(i * h) for i in range(-count | 1, count + 1, 2))  # the new points lie between the old ones
        before, result = result, total * h
        if abs(result - before) <= 1e-12 * result:
            return result
    raise ArithmeticError(f"the tail from {start} does not settle: {before}, {result}")


def t_two_sided(t: float, df: float) -> float:
    return min(1.0, 2 * upper_tail(lambda u: t_density(u, df), abs(t))) if t else 1.0


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else min(1.0, upper_tail(lambda u: f_density(u, d1, d2), f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _apply(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([
        None if any(pd.isna(v) for v in row) else fn(*map(float, row)) for row in zip(*columns)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _apply(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return _apply(normal_two_sided, z)
