"""Order statistics without a global sort: histograms, prefix sums, pair counts.

Everything here starts by collapsing rows to one row per (key, distinct value)
with map-side counts, so repeated values, however hot, cost one row.  What is
left is ordered by a window per key.  Unless the values are few by their
meaning, they are dealt into ranges first (``range_buckets``) and the window
runs per (key, range), with the offsets of the ranges added from a table of one
row per key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.session import materialise

def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys, so a group without a name is not lost."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def histogram(df: DataFrame, keys: list[str], value: str, **counts: Column) -> DataFrame:
    """keys, value, n and one conditional count per extra argument."""
    aggs = [F.count("*").alias("n")] + [F.count_if(c).alias(name) for name, c in counts.items()]
    return df.groupBy(*keys, value).agg(*aggs)


def range_buckets(hist: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """Adds ``bucket``, a range number that grows with the value.

    One plan at every size: Spark samples the values, deals the rows into ranges of
    about equal size, by default as many as the session's shuffle partitions, and
    merges small ones.  Equal values share a range.  The rows are written with their
    range, because they are read twice and must not be dealt anew in between.
    Ranges only balance the work; results are exact for any of them.
    """
    dealt = hist.repartitionByRange(ranges, value) if ranges else hist.repartitionByRange(value)
    return materialise(dealt.withColumn("bucket", F.spark_partition_id()))


def _by_value(keys: list[str], value: str):
    return Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def quantile_from_cumulative(value: str, cum: str, total: str, p: float) -> Column:
    """Smallest value whose cumulative count reaches ceil(p*N); an aggregate over one key."""
    need = F.greatest(F.ceil(F.col(total) * F.lit(p)), F.lit(1))
    return F.min(F.when(F.col(cum) >= need, F.col(value)))


def small_domain_quantiles(hist: DataFrame, keys: list[str], value: str, probs: dict[str, float], *extra: Column) -> DataFrame:
    """Exact discrete quantiles from a histogram whose value domain is bounded
    by its meaning (sizes, lengths), plus further aggregates of the histogram."""
    known = F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0)
    ranked = hist.withColumn("_cum", F.sum(known).over(_by_value(keys, value))).withColumn(
        "_total", F.sum(known).over(Window.partitionBy(*keys)))
    present = F.when(F.col(value).isNotNull(), F.col("_cum"))
    ranked = ranked.withColumn("_cum", present)
    return ranked.groupBy(*keys).agg(
        *[quantile_from_cumulative(value, "_cum", "_total", p).alias(name) for name, p in probs.items()], *extra)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    interpolate: bool = False, ranges: int | None = None) -> DataFrame:
    """Exact quantiles of any numeric column, nulls ignored, no size limit.

    ``interpolate`` gives the linear form (the usual median of an even count).
    """
    hist = range_buckets(histogram(df.where(F.col(value).isNotNull()), keys, value), value, ranges)
    offsets = (
        hist.groupBy(*keys, "bucket").agg(F.sum("n").alias("_bn"))
        .withColumn("_off", F.coalesce(F.sum("_bn").over(_before(keys, "bucket")), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys)))
    )
    wanted = []  # zero-based ranks to fetch
    for name, p in probs.items():
        if interpolate:
            pos = (F.col("_total") - 1) * F.lit(p)
            wanted += [(f"{name}__lo", F.floor(pos)), (f"{name}__hi", F.ceil(pos))]
        else:
            wanted.append((name, F.greatest(F.ceil(F.col("_total") * F.lit(p)), F.lit(1)) - 1))
    # only ranges that hold a wanted rank are read row by row
    holds = None
    for _, rank in wanted:
        c = (rank >= F.col("_off")) & (rank < F.col("_off") + F.col("_bn"))
        holds = c if holds is None else holds | c
    rows = join_on(hist, offsets.where(holds).drop("_bn"), [*keys, "bucket"])
    rows = rows.withColumn("_cum", F.col("_off") + F.sum("n").over(_by_value([*keys, "bucket"], value)))
    at = lambda rank: F.min(F.when((F.col("_cum") > rank) & (F.col("_cum") - F.col("n") <= rank), F.col(value)))
    out = rows.groupBy(*keys).agg(F.max("_total").alias("_total"), *[at(rank).alias(name) for name, rank in wanted])
    if interpolate:
        for name, p in probs.items():
            pos = (F.col("_total") - 1) * F.lit(p)
            lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
            out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return out.select(*keys, *probs)


def pair_counts(df: DataFrame, keys: list[str], value: str, in_first: Column,
                ranges: int | None = None) -> DataFrame:
    """Per key: how often a value of the first group exceeds one of the second.

    Columns: ``n1``, ``n2``, ``wins`` (pairs first > second), ``draws`` (equal
    pairs) and ``tie_term`` = sum of t^3 - t over tied values of the pooled sample.
    No pair is ever formed: the count is a running sum over the histogram,
    completed per range by the number of second-group rows in lower ranges.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_first", in_first)
    hist = histogram(rows, keys, value, c1=F.col("_first"))
    hist = range_buckets(hist, value, ranges).withColumn("c2", F.col("n") - F.col("c1"))
    below = F.coalesce(F.sum("c2").over(_before([*keys, "bucket"], value)), F.lit(0))
    t = F.col("n").cast("double")
    ranges = (
        hist.withColumn("_below", below)
        .groupBy(*keys, "bucket")
        .agg(
            F.sum("c1").alias("c1"),
            F.sum("c2").alias("c2"),
            F.sum(F.col("c1").cast("double") * F.col("_below")).alias("inner"),
            F.sum(F.col("c1").cast("double") * F.col("c2")).alias("draws"),
            F.sum(t * t * t - t).alias("tie_term"),
        )
        .withColumn("_lower", F.coalesce(F.sum("c2").over(_before(keys, "bucket")), F.lit(0)))
    )
    return ranges.groupBy(*keys).agg(
        F.sum("c1").alias("n1"),
        F.sum("c2").alias("n2"),
        F.sum(F.col("inner") + F.col("c1").cast("double") * F.col("_lower")).alias("wins"),
        F.sum("draws").alias("draws"),
        F.sum("tie_term").alias("tie_term"),
    )
