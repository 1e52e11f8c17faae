"""Two-sample, trend and break statistics over long tables keyed by series or feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions import pvalues as P
from eventlens.operators.ranks import exact_quantiles, histogram, join_on, pair_counts

SIGNIFICANT = 0.05


def mann_whitney(df: DataFrame, keys: list[str], value: str, in_first: Column, ranges: int | None = None) -> DataFrame:
    """Two-sided rank-sum test per key; U is that of the first (pre) sample.

    Normal approximation with tie and continuity correction; the exact
    distribution when a sample has at most eight values and nothing is tied.
    """
    c = pair_counts(df, keys, value, in_first, ranges).where((F.col("n1") > 0) & (F.col("n2") > 0))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("wins") + F.col("draws") / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    big_u = F.greatest(u, n1 * n2 - u)
    z = F.try_divide(big_u - n1 * n2 / 2 - 0.5, spread)
    out = c.select(
        *keys, "n1", "n2", u.alias("u"),
        (1 - 2 * u / (n1 * n2)).alias("rank_biserial"),
        z.alias("z"),
        ((F.least("n1", "n2") <= 8) & (F.col("tie_term") == 0)).alias("_exact"),
    )
    asymptotic = F.when(F.col("z").isNull(), 1.0).otherwise(
        F.least(F.lit(1.0), F.when(F.col("z") > 0, P.normal_two_sided("z")).otherwise(2 - P.normal_two_sided("z"))))
    # rows that take the other branch pass a one-value sample, which costs nothing
    small = lambda c: F.when(F.col("_exact"), F.col(c)).otherwise(1)
    exact = P.rank_sum_exact(small("n1"), small("n2"), F.when(F.col("_exact"), F.col("u")).otherwise(0.0))
    out = out.select("*", asymptotic.alias("_pa"), exact.alias("_pe"))
    return out.withColumn("p_value", F.when(F.col("_exact"), F.col("_pe")).otherwise(F.col("_pa"))).withColumn(
        "significant", F.col("p_value") < SIGNIFICANT).drop("_exact", "_pa", "_pe")


def percent_change(pre: Column, post: Column, floor: float | None = None) -> Column:
    base = F.greatest(pre, F.lit(floor)) if floor is not None else pre
    return F.try_divide(post - pre, base) * 100


def era_summary(df: DataFrame, keys: list[str], value: str, in_first: Column, medians: bool = True,
                floor: float | None = None) -> DataFrame:
    """Mean (and exact median) before and after, with the relative change of the mean."""
    rows = df.withColumn("_first", in_first)
    v = F.col(value)
    means = rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("_first"), v)).alias("pre_mean"), F.avg(F.when(~F.col("_first"), v)).alias("post_mean"))
    means = means.withColumn("percent_change", percent_change(F.col("pre_mean"), F.col("post_mean"), floor))
    if not medians:
        return means
    med = exact_quantiles(rows, [*keys, "_first"], value, {"median": 0.5}, interpolate=True)
    med = med.groupBy(*keys).agg(
        F.max(F.when(F.col("_first"), F.col("median"))).alias("pre_median"),
        F.max(F.when(~F.col("_first"), F.col("median"))).alias("post_median"))
    return join_on(means, med, keys)


def dispersion_shift(df: DataFrame, keys: list[str], low: str, high: str, in_first: Column) -> DataFrame:
    """Mean interquartile range before and after; null ranges are left out and counted."""
    iqr = F.col(high) - F.col(low)
    return df.groupBy(*keys).agg(
        F.avg(F.when(in_first, iqr)).alias("iqr_pre_mean"),
        F.avg(F.when(~in_first, iqr)).alias("iqr_post_mean"),
        F.count_if(iqr.isNull()).alias("n_null"),
    ).withColumn("iqr_change_percent", percent_change(F.col("iqr_pre_mean"), F.col("iqr_post_mean"), 1e-10))


def kendall_trend(df: DataFrame, keys: list[str], t: str, value: str, ranges: int | None = None) -> DataFrame:
    """Kendall tau-b of a series against its position ``t`` = 0, 1, 2, ... (no ties in t).

    Discordant pairs are inversions.  Split positions at every power of two:
    each pair falls on opposite sides of exactly one such split, so the
    inversions are the "earlier half exceeds later half" pairs summed over
    splits.  That is ``pair_counts`` on log2(n) copies of each row, instead
    of n^2/2 pairs.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(t).cast("bigint").alias("_t"), F.col(value).alias("_y"))
    span = rows.groupBy(*keys).agg(F.max("_t").alias("_last"))
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("_last"), F.lit(1)).cast("double"))).cast("int"))
    split = join_on(rows, span, keys).select(*keys, "_t", "_y", F.explode(levels).alias("_level"))
    split = split.select(
        *keys, "_level", "_y",
        F.expr("shiftright(_t, _level + 1)").alias("_block"),
        (F.expr("shiftright(_t, _level) & 1") == 0).alias("_early"),
    )
    inversions = pair_counts(split, [*keys, "_level", "_block"], "_y", F.col("_early"), ranges).groupBy(*keys).agg(
        F.sum("wins").alias("discordant"))
    ties = histogram(rows, keys, "_y")
    k = F.col("n").cast("double")
    ties = ties.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(k * (k - 1) / 2).alias("tied_pairs"),
        F.sum(k * (k - 1) * (2 * k + 5)).alias("_var_ties"),
    )
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    conc_minus = pairs - F.col("tied_pairs") - 2 * F.col("discordant")
    var = (n * (n - 1) * (2 * n + 5) - F.col("_var_ties")) / 18
    out = join_on(ties, inversions, keys).select(
        *keys, "n", "discordant",
        F.try_divide(conc_minus, F.sqrt(pairs * (pairs - F.col("tied_pairs")))).alias("tau"),
        F.try_divide(conc_minus, F.sqrt(var)).alias("z"),
        ((F.col("tied_pairs") == 0) & ((n <= 33) | (F.least(F.col("discordant"), pairs - F.col("discordant")) <= 1))).alias("_exact"),
    )
    exact = P.kendall_exact(F.when(F.col("_exact"), F.col("n")).otherwise(2),
                            F.when(F.col("_exact"), F.col("discordant")).otherwise(0.0))
    out = out.select("*", exact.alias("_pe"), P.normal_two_sided("z").alias("_pa"))
    return (
        out.withColumn("p_value", F.when(F.col("_exact"), F.col("_pe")).otherwise(F.col("_pa")))
        .withColumn("direction", F.when(F.col("tau") > 0, "increasing").otherwise("decreasing"))
        .withColumn("significant", F.col("p_value") < SIGNIFICANT)
        .drop("_exact", "_pe", "_pa")
    )


def _sides(series: DataFrame, breaks: DataFrame, keys: list[str]) -> DataFrame:
    """Every series point once per break of that series, tagged with its side."""
    return series.join(breaks.select(*keys, "break_t"), keys).withColumn("_pre", F.col("t") < F.col("break_t"))


def segmented_regression(series: DataFrame, breaks: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Straight-line fits before and from each break (``break_t`` = first t of the new segment)."""
    x, y = F.col("t").cast("double"), F.col(value).cast("double")
    g = _sides(series, breaks, keys).where(F.col(value).isNotNull()).groupBy(*keys, "break_t", "_pre").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), (F.min(y) == F.max(y)).alias("_flat"), F.count("*").alias("n"))
    dof = F.col("n") - 2
    # a constant segment has slope 0 and explains nothing
    g = g.withColumn("r2", F.when(F.col("_flat"), 0.0).otherwise(F.col("r2")))
    g = g.withColumn("_t", F.when(F.col("r2") >= 1.0, F.lit(float("inf"))).otherwise(
        F.sqrt(F.col("r2") * dof / (1 - F.col("r2"))))).withColumn("_dof", dof.cast("double"))
    g = g.select("*", P.student_two_sided("_t", "_dof").alias("_ps"))
    g = g.withColumn("p", F.when(F.col("n") == 2, F.when(F.col("slope") == 0, 1.0).otherwise(0.0)).otherwise(F.col("_ps")))
    side = lambda c, pre: F.max(F.when(F.col("_pre") == pre, F.col(c)))
    out = g.groupBy(*keys, "break_t").agg(
        *[side(c, pre).alias(f"{name}_{c}") for pre, name in ((True, "pre"), (False, "post"))
          for c in ("slope", "intercept", "r2", "p", "n")])
    return out.withColumn("slope_change_ratio", F.when(F.col("pre_slope") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("post_slope", "pre_slope")))


def welch_t(series: DataFrame, breaks: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Unequal-variance t-test of the levels before and from each break."""
    y = F.col(value).cast("double")
    pre = F.col("_pre")
    g = _sides(series, breaks, keys).groupBy(*keys, "break_t").agg(
        F.avg(F.when(pre, y)).alias("pre_mean"), F.avg(F.when(~pre, y)).alias("post_mean"),
        (F.var_samp(F.when(pre, y)) / F.count(F.when(pre, y))).alias("_v1"),
        (F.var_samp(F.when(~pre, y)) / F.count(F.when(~pre, y))).alias("_v2"),
        F.count(F.when(pre, y)).alias("n_pre"), F.count(F.when(~pre, y)).alias("n_post"))
    se2 = F.col("_v1") + F.col("_v2")
    dof = F.try_divide(se2 * se2, F.try_divide(F.col("_v1") * F.col("_v1"), F.col("n_pre") - 1)
                       + F.try_divide(F.col("_v2") * F.col("_v2"), F.col("n_post") - 1))
    g = g.withColumns({
        "percent_change": percent_change(F.col("pre_mean"), F.col("post_mean")),
        "t_statistic": F.try_divide(F.col("pre_mean") - F.col("post_mean"), F.sqrt(se2)),
        "dof": dof,
    })
    g = g.select("*", P.student_two_sided("t_statistic", "dof").alias("p_value"))
    return g.withColumn("significant_at_005", F.col("p_value") < SIGNIFICANT).drop("_v1", "_v2")


def best_split(series: DataFrame, keys: list[str], value: str = "y", min_size: int = config.BREAK_MIN_SIZE) -> DataFrame:
    """The single break with the least squared error around two levels, from running sums.

    Series hold one row per calendar period, so a window per series is small.
    """
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    c = series.select(*keys, "t", F.col(value).cast("double").alias("_y"))
    c = c.withColumn("_y", F.col("_y") - F.avg("_y").over(whole))
    c = c.select(
        *keys, "t",
        F.count("*").over(upto).alias("_n1"), F.sum("_y").over(upto).alias("_s1"),
        F.count("*").over(whole).alias("_n"), F.sum("_y").over(whole).alias("_s"),
        F.sum(F.col("_y") * F.col("_y")).over(whole).alias("_q"),
    )
    n2 = F.col("_n") - F.col("_n1")
    s2 = F.col("_s") - F.col("_s1")
    c = c.where((F.col("_n1") >= min_size) & (n2 >= min_size)).withColumn(
        "cost", F.col("_q") - F.col("_s1") * F.col("_s1") / F.col("_n1") - s2 * s2 / n2)
    return c.groupBy(*keys).agg(F.min_by("t", F.struct("cost", "t")).alias("break_t"), F.min("cost").alias("cost"))


def annotate_breaks(breaks: DataFrame, series: DataFrame, keys: list[str], reference: str,
                    near_days: int = config.NEAR_DAYS) -> DataFrame:
    """Date and label of each break, whether it lies near a reference date, and the first such label per series."""
    dates = series.select(*keys, F.col("t").alias("break_t"), "date")
    ref = F.lit(reference).cast("date")
    out = breaks.select(*keys, "break_t").join(dates, [*keys, "break_t"]).withColumns({
        "month": F.date_format("date", "yyyy-MM"),
        "near_reference": F.abs(F.datediff("date", ref)) <= near_days,
    })
    first_near = F.min(F.when(F.col("near_reference"), F.col("month"))).over(Window.partitionBy(*keys))
    return out.withColumn("nearest", first_near)
