"""Stored sketches: distinct counts and quantiles that merge over months, batches and labels without the rows.

Distinct counts use HyperLogLog of 2^lg_k registers, quantiles KLL of parameter k.  A sketch is a few kilobytes
whatever it has seen; a union of sketches equals the sketch of all rows, so months roll up to quarters and years and
batches of a stream add up.  Exact forms stay the default everywhere; these are for answers without a second scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch, as a power of two: 0.8 % standard error.
LG_K = 14
#: Parameter of a quantile sketch: about 0.65 % of the rows, in rank, with 99 % confidence.
KLL_K = 400
#: Rank error of KLL at k = 200, and how it falls with k (published figures of the sketch).
_RANK_ERROR_200 = 0.0133


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(1 << lg_k)


def rank_error(k: int = KLL_K) -> float:
    """Error in rank, as a share of the rows, that a single quantile exceeds in at most 1 % of all cases."""
    return _RANK_ERROR_200 * (200 / k) ** 0.9433


def sketch_distinct(rows: DataFrame, keys: list[Column | str], columns: dict[str, str], count: str = "n", lg_k: int = LG_K) -> DataFrame:
    """One row per key: rows counted, and a distinct-count sketch of each column (``columns``: column to name)."""
    return rows.groupBy(*keys).agg(F.count("*").alias(count), *[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(n) for c, n in columns.items()])


def sketch_quantiles(rows: DataFrame, keys: list[Column | str], value: str, count: str = "n", name: str = "sketch", k: int = KLL_K) -> DataFrame:
    """One row per key: rows counted, and a quantile sketch of a whole-number column; nulls aren't in the sketch."""
    return rows.groupBy(*keys).agg(F.count("*").alias(count), F.kll_sketch_agg_bigint(value, F.lit(k)).alias(name))


def merge_sketches(parts: DataFrame, keys: list[Column | str], distinct: list[str] = (), quantiles: list[str] = (), sums: list[str] = ("n",)) -> DataFrame:
    """Roll stored sketches up to coarser keys: counts add, sketches unite."""
    return parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.hll_union_agg(c).alias(c) for c in distinct],
        *[F.kll_merge_agg_bigint(c).alias(c) for c in quantiles])


def distinct_estimates(parts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Sketches (column to name of its estimate) read as numbers."""
    return parts.withColumns({n: F.hll_sketch_estimate(c) for c, n in columns.items()}).drop(*columns)


def quantile_estimates(parts: DataFrame, probabilities: dict[str, float], name: str = "sketch") -> DataFrame:
    """Quantiles of a stored sketch; null where no value went in."""
    some = F.kll_sketch_get_n_bigint(name) > 0
    return parts.withColumns({c: F.when(some, F.kll_sketch_get_quantile_bigint(name, F.lit(float(p)))) for c, p in probabilities.items()}).drop(name)
