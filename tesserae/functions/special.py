"""Tails of distributions that SQL has no function for, in numpy and as pandas UDFs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Terms of the continued fraction, and what stands for zero in it.
TERMS, TINY = 300, 1e-300


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.tolist()), np.float64, len(x))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method over all elements at once."""

    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < TINY, TINY, v)

    c, d = np.ones_like(x), 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    value = d.copy()
    for m in range(1, TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / safe(1.0 + term * d)
            c = safe(1.0 + term / c)
            step = c * d
            value = value * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return value


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularized incomplete beta function; each element by whichever side of it converges fast."""
    a, b, x = (np.array(v, dtype=np.float64) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    if inside.any():
        a, b, x = a[inside], b[inside], x[inside]
        turn = x > (a + 1.0) / (a + b + 2.0)
        p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1.0 - x, x)
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        part = front * _fraction(p, q, y)
        out[inside] = np.where(turn, 1.0 - part, part)
    return out


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The probability of a Student variable at least as far from 0; 0 for an infinite t, NaN where t or df is."""
    t, df = np.asarray(t, dtype=np.float64), np.asarray(df, dtype=np.float64)
    known = ~(np.isnan(t) | np.isnan(df))
    out = np.full(t.shape, np.nan)
    square = np.square(t[known])
    out[known] = np.where(np.isinf(square), 0.0, incomplete_beta(df[known] / 2.0, np.full(int(known.sum()), 0.5), df[known] / (df[known] + np.where(np.isinf(square), 0.0, square))))
    return out


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.fromiter((math.erfc(abs(v) / math.sqrt(2.0)) for v in np.asarray(z, dtype=np.float64).tolist()), np.float64, len(z))


@lru_cache(maxsize=4096)
def rank_sum_ways(n: int, blocks: tuple[int, ...]) -> np.ndarray:
    """How many choices of n observations have a doubled rank sum of 0, 1, ...: blocks are the numbers of tied ones, in order.

    Blocks are added one after another: of t tied observations j can be chosen in t over j ways, each with the block's mean rank,
    which doubled is whole. Numbers are whole up to 2**53, which choices of up to 20 of 40 or 5 of 85 are far below."""
    most = n * (2 * sum(blocks) + 1 - n)
    ways = np.zeros((n + 1, most + 1))
    ways[0, 0] = 1.0
    before = 0
    for t in blocks:
        rank = 2 * before + t + 1
        added = ways.copy()
        for j in range(1, min(t, n) + 1):
            if j * rank <= most:
                added[j:, j * rank :] += math.comb(t, j) * ways[: n + 1 - j, : most + 1 - j * rank]
        ways, before = added, before + t
    return ways[n]


def exact_two_sided(n: int, m: int, u: float, blocks: tuple[int, ...]) -> float:
    """Twice the smaller tail of u for n against m observations, at most 1, over all choices of n of the tied ranks. The smaller side is counted."""
    if n > m:
        n, m, u = m, n, n * m - u
    ways = rank_sum_ways(n, blocks)
    at = round(2 * u) + n * (n + 1)
    return min(1.0, 2.0 * min(ways[: at + 1].sum(), ways[at:].sum()) / math.comb(n + m, n))


@pandas_udf(DoubleType())
def exact_rank_p(n: pd.Series, m: pd.Series, u: pd.Series, blocks: pd.Series) -> pd.Series:
    """exact_two_sided by row; null where blocks is."""
    found = [None if b is None else exact_two_sided(int(i), int(j), float(x), tuple(map(int, b))) for i, j, x, b in zip(n, m, u, blocks, strict=True)]
    return pd.Series(found, dtype="float64")


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t.to_numpy(dtype=np.float64, na_value=np.nan), df.to_numpy(dtype=np.float64, na_value=np.nan)))


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(dtype=np.float64, na_value=np.nan)))
