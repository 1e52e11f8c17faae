"""Tail probabilities for already aggregated test statistics.

Spark has no error function or incomplete beta, so these are vectorised
pandas functions.  They run on one row per test, never on raw data.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return pd.Series(_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2.0)))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x):
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        xs, aa, bb = np.where(low, x, 1.0 - x), np.where(low, a, b), np.where(low, b, a)
        part = front * _beta_fraction(aa, bb, xs) / aa
    out = np.where(low, part, 1.0 - part)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, out))


@pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for a Student variable with ``dof`` degrees of freedom."""
    tv, nu = t.to_numpy(float), dof.to_numpy(float)
    ok = np.isfinite(nu) & (nu > 0) & ~np.isnan(tv)
    safe_nu, safe_t = np.where(ok, nu, 1.0), np.where(ok, tv, 0.0)
    x = np.where(np.isinf(safe_t), 0.0, safe_nu / (safe_nu + np.where(np.isinf(safe_t), 0.0, safe_t) ** 2))
    return pd.Series(np.where(ok, incomplete_beta(safe_nu / 2.0, 0.5, x), np.nan))


def kendall_exact_p(n: int, discordant: int) -> float:
    """Two-sided p of a tie-free Kendall test from the distribution of inversions.

    Up to one inversion (either way) there are n permutations or one, at any
    length; otherwise the counts of inversions are built up, 33 values at most.
    """
    c = min(discordant, n * (n - 1) // 2 - discordant)
    if c <= 1:
        ways = 1 if c == 0 else n
        return float(min(1.0, 2 * ways * math.exp(-math.lgamma(n + 1)))) if n > 1 else 1.0
    if n > 33:
        raise ValueError("the exact test is for 33 values at most, or up to one discordant or concordant pair")
    counts = [1]
    for width in range(2, n + 1):
        longer = [0] * (len(counts) + width - 1)
        for shift in range(width):
            for i, v in enumerate(counts):
                longer[i + shift] += v
        counts = longer
    return min(1.0, 2 * sum(counts[: c + 1]) / math.factorial(n))


@lru_cache(maxsize=None)
def _bounded_sums(parts: int) -> tuple[int, list[int]]:
    """Numbers of multisets of 1 .. parts with a sum of at most x, for the first x = 0, 1, ...

    Along any residue of the period the number is a polynomial of degree
    ``parts`` in x, so parts + 1 periods determine all of them.
    """
    period = math.lcm(*range(1, parts + 1))
    ways = [1] * (period * (parts + 1))
    for size in range(1, parts + 1):
        for x in range(size, len(ways)):
            ways[x] += ways[x - size]
    return period, ways


def _multisets_up_to(parts: int, x: int) -> int:
    """Value at any x, by interpolation along its residue; exact in whole numbers."""
    if x < 0:
        return 0
    period, ways = _bounded_sums(parts)
    if x < len(ways):
        return ways[x]
    at, residue = divmod(x, period)
    total = Fraction(0)
    for j in range(parts + 1):
        weight = Fraction(1)
        for k in range(parts + 1):
            if k != j:
                weight *= Fraction(at - k, j - k)
        total += weight * ways[residue + j * period]
    return int(total)


def rank_sum_exact_p(n1: int, n2: int, u: float) -> float:
    """Two-sided p of a tie-free rank-sum test whose smaller sample has at most eight values.

    The ways to reach a rank sum are the coefficients of a product of quotients
    (1 - q^(n+i)) / (1 - q^i), i = 1 .. m: the sums of multisets of 1 .. m, less
    those with too many parts, over the subsets of the numerator.  The work
    depends on m alone, and the count is a whole number for samples of any size.
    """
    m, n = min(n1, n2), max(n1, n2)
    if m > 8:
        raise ValueError("the exact test is for a sample of eight values at most")
    k = int(math.floor(min(u, n1 * n2 - u) + 1e-9))
    # a sum over k of coefficients is the coefficient of one more factor 1 / (1 - q),
    # which is what counting sums "of at most" does
    tail = 0
    for chosen in range(1 << m):
        less = sum(n + i + 1 for i in range(m) if chosen >> i & 1)
        tail += (-1) ** bin(chosen).count("1") * _multisets_up_to(m, k - less)
    return float(min(Fraction(1), Fraction(2 * tail, math.comb(n + m, m))))


@pandas_udf(DoubleType())
def kendall_exact(n: pd.Series, discordant: pd.Series) -> pd.Series:
    return pd.Series([kendall_exact_p(int(a), int(b)) if pd.notna(a) and pd.notna(b) else np.nan
                      for a, b in zip(n, discordant)], dtype=float)


@pandas_udf(DoubleType())
def rank_sum_exact(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_exact_p(int(a), int(b), float(c)) if pd.notna(a) else np.nan
                      for a, b, c in zip(n1, n2, u)], dtype=float)
