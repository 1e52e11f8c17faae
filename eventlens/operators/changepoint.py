"""Penalised kernel segmentation of many series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from eventlens import config
from eventlens.session import spread_groups


def _pair_value(s: np.ndarray, k: int) -> float:
    """The k-th smallest difference (from 1) between two of the sorted values, without forming the pairs.

    Halves the range of doubles between 0 and the largest difference until one
    is left; differences up to a bound are counted by binary search.
    """
    at = np.arange(len(s))

    def count(v: float) -> int:
        upto = np.searchsorted(s, s + v, side="right")
        # the sum may be rounded past or short of a value: go by the differences themselves
        while (more := (upto < len(s)) & (s[np.minimum(upto, len(s) - 1)] - s <= v)).any():
            upto[more] += 1
        while (less := (upto - 1 > at) & (s[upto - 1] - s > v)).any():
            upto[less] -= 1
        return int((upto - 1 - at).sum())

    low, high = -1, int(np.float64(s[-1] - s[0]).view(np.int64))
    while high - low > 1:
        middle = (low + high) // 2
        if count(float(np.int64(middle).view(np.float64))) >= k:
            high = middle
        else:
            low = middle
    return float(np.int64(high).view(np.float64))


def median_square(y: np.ndarray) -> float:
    """Median of the squared differences of all pairs, in linear memory."""
    s, pairs = np.sort(y), len(y) * (len(y) - 1) // 2
    return (_pair_value(s, (pairs + 1) // 2) ** 2 + _pair_value(s, pairs // 2 + 1) ** 2) / 2


def kernel_search(y: np.ndarray, penalty: float, min_size: int, prune: bool = True) -> tuple[list[int], int]:
    """First index of every new segment under an RBF kernel cost, and how many segment starts were weighed.

    cost(a, b) = (b - a) - (sum of the kernel block)/(b - a).  The block sums of all starts that are left are updated
    one column at a time, from the earliest of them on, so memory stays linear and a start that is gone costs nothing.

    Cutting a segment never raises its cost.  So a start a for which best(a) + cost(a, b) exceeds best(b) can be beaten
    by starting at b instead, from b + min_size on, and is dropped then: the breaks are those of the full search.
    """
    n = len(y)
    if n < 2 * min_size:
        return [], 0
    med = median_square(y)
    gamma = 1.0 / med if med > 0 else 1.0
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    prev = np.zeros(n + 1, dtype=int)
    starts, block, until = np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    weighed = 0
    for b in range(1, n + 1):
        starts, block, until = np.append(starts, b - 1), np.append(block, 0.0), np.append(until, n + 1)
        col = np.exp(-np.clip(gamma * (y[starts[0]: b - 1] - y[b - 1]) ** 2, 1e-2, 1e2))
        after = np.append(np.cumsum(col[::-1])[::-1], 0.0)  # sums from each position to the column's own, which it leaves out
        block += 2.0 * after[starts - starts[0]] + 1.0
        if b < min_size:
            continue
        able = int(np.searchsorted(starts, b - min_size, side="right"))
        size = b - starts[:able]
        total = best[starts[:able]] + (size - block[:able] / size)
        weighed += able
        chosen = int(np.argmin(total + penalty))
        prev[b] = starts[chosen]
        best[b] = total[chosen] + penalty
        if prune:
            # rounding must not drop a start that the full search might still choose
            beaten = (total > best[b] + 1e-9 * (1.0 + abs(best[b]))) & (until[:able] > n)
            until[:able][beaten] = b + min_size
            kept = until > b + 1
            starts, block, until = starts[kept], block[kept], until[kept]
    cuts, b = [], n
    while b > 0:
        b = prev[b]
        if b > 0:
            cuts.append(int(b))
    return cuts[::-1], weighed


def kernel_breaks(y: np.ndarray, penalty: float, min_size: int) -> list[int]:
    return kernel_search(y, penalty, min_size)[0]


def changepoints(series: DataFrame, keys: list[str], value: str = "y", penalty: float = config.BREAK_PENALTY,
                 min_size: int = config.BREAK_MIN_SIZE) -> DataFrame:
    """keys, break_t: every break of every series.

    One task handles one whole series, which is one row per calendar period;
    the work scales with the number of series.
    """
    schema = series.select(*keys).schema.add("break_t", LongType())

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        cuts = kernel_breaks(pdf[value].to_numpy(float), penalty, min_size)
        out = pdf[keys].iloc[[0] * max(len(cuts), 1)].reset_index(drop=True)
        # a series without breaks sends one empty row, dropped below
        out["break_t"] = pd.array(pdf["t"].to_numpy()[cuts] if cuts else [None], dtype="Int64")
        return out

    rows = series.select(*keys, F.col("t").cast("bigint").alias("t"), F.col(value).cast("double").alias(value))
    return spread_groups(rows, keys).groupBy(*keys).applyInPandas(solve, schema).where("break_t IS NOT NULL")
