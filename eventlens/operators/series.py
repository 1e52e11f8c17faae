"""Monthly series: stitching, densifying, growth, shares and totals.

A series table holds one row per calendar month and series; windows over a
series are therefore bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import config
from eventlens.operators.ranking import latest_per_key


def with_t(df: DataFrame, keys: list[str], order: str = "month", calendar: bool = False) -> DataFrame:
    """Adds the time axis t = 0, 1, 2, ...: row position, or months since the first row if ``calendar``."""
    w = Window.partitionBy(*keys).orderBy(order)
    if not calendar:
        return df.withColumn("t", (F.row_number().over(w) - 1).cast("bigint"))
    first = F.min(order).over(Window.partitionBy(*keys))
    as_date = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    return df.withColumn("t", F.round(F.months_between(as_date(F.col(order)), as_date(first))).cast("bigint"))


def growth_pct(df: DataFrame, keys: list[str], value: str, order: str = "month", out: str = "growth_pct") -> DataFrame:
    """Change against the previous row of the series, in percent."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, (F.try_divide(F.col(value), prev) - 1) * 100)


def last_full(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Month, position and value of the last complete period."""
    full = df.where(~F.col("partial"))
    return full.groupBy(*keys).agg(
        F.max("month").alias("last_full_month"), F.max("t").alias("last_full_t"),
        F.max_by(value, "month").alias("last_value"))


def left_lookup(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on a table with one row per key; a missing key gives null."""
    return df.join(lookup, keys, "left")


def stitch_series(exact: DataFrame, other: DataFrame, keys: list[str], by_month: bool = False) -> DataFrame:
    """Exact rows, and other rows for months after the last month that the exact source has for any series.

    ``by_month`` decides month by month instead: the other source fills every
    month of a series that the exact one lacks, also in between.  Both tables have
    a row per series and month, so the windows are small.
    """
    both = exact.withColumn("_exact", F.lit(True)).unionByName(
        other.withColumn("_exact", F.lit(False)), allowMissingColumns=True)
    if by_month:
        known = F.bool_or("_exact").over(Window.partitionBy(*keys, "month"))
        return both.withColumn("_known", known).where(F.col("_exact") | ~F.col("_known")).drop("_exact", "_known")
    last = exact.agg(F.max("month")).scalar()
    return both.where(F.col("_exact") | last.isNull() | (F.col("month") > last)).drop("_exact")


def pivot_series(df: DataFrame, index: str, column: str, names: list[str], values: list[str]) -> DataFrame:
    """Long to wide; a repeated (index, column) pair is an error, as in any one-to-one reshape."""
    aggs = []
    for v in values:
        aggs.append(F.first(v, ignorenulls=True).alias(v))
    once = F.assert_true(F.max("_n") <= 1, F.lit("duplicate entries, cannot reshape"))
    keyed = df.where(F.col(column).isin(names)).groupBy(index, column).agg(F.count("*").alias("_n"), *aggs)
    checked = []
    for n in names:
        for v in values:
            name = n if len(values) == 1 else f"{n}_{v}"
            checked.append(F.max(F.when(F.col(column) == n, F.col(v))).alias(name))
    out = keyed.groupBy(index).agg(*checked, once.alias("_ok"))
    return out.where(F.col("_ok").isNull()).drop("_ok")


def complete_total(df: DataFrame, tools: list[str], keys: tuple = ("month",), extra: list[Column] = ()) -> DataFrame:
    """Sum of estimate, lo and hi over a fixed tool set, only where every tool is present.

    A period that is partial for any tool is partial.  A repeated (period, tool) row is an error.
    """
    known = df.where(F.col("tool").isin(tools) & F.col("estimate").isNotNull())
    return (
        known.groupBy(*keys)
        .agg(F.sum("estimate").alias("estimate"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"),
             F.bool_or("partial").alias("partial"), F.countDistinct("tool").alias("_tools"), _repeats(), *extra)
        .where(_one_row_each()).where(F.col("_tools") == len(tools)).drop("_tools", "_repeats")
    )


def _repeats() -> Column:
    return (F.count("*") - F.countDistinct("tool")).alias("_repeats")


def _one_row_each() -> Column:
    """True, or an error where a group has more rows than tools."""
    return F.assert_true(F.col("_repeats") == 0, F.lit("more than one row for a tool and period")).isNull()


def sigma_log(estimate: Column, lo: Column, hi: Column) -> Column:
    """Relative uncertainty of an estimate, from the spread of its draws."""
    return F.greatest(F.lit(config.SIGMA_FLOOR), F.try_divide(hi - lo, 2 * estimate))


def build_series(exact: DataFrame, estimates: DataFrame, tools: list[str], focus: str) -> DataFrame:
    """The stitched monthly series of one tool and of all tools together, in long form.

    exact: tool, month, value.  estimates: tool, month, estimate, lo, hi, partial.
    A later month is kept only when every tool was estimated.
    """
    is_focus = F.col("tool") == focus
    ex = exact.where(F.col("tool").isin(tools)).groupBy("month").agg(
        F.sum(F.when(is_focus, F.col("value"))).alias("focus"), F.sum("value").alias("total"),
        _repeats()).where(_one_row_each())
    point = lambda name, y: F.struct(F.lit(name).alias("series_id"), y.cast("bigint").alias("y"))
    ex = ex.select("month", F.explode(F.array(point(focus, F.col("focus")), point("total", F.col("total")))).alias("p")).select(
        "p.series_id", "month", "p.y", F.col("p.y").alias("lo"), F.col("p.y").alias("hi"),
        F.lit(config.SIGMA_EXACT).alias("sigma"), F.lit("exact").alias("source"), F.lit(False).alias("partial")
    ).where(F.col("y").isNotNull())

    parts = ("estimate", "lo", "hi")
    est = complete_total(estimates, tools, extra=[F.max(F.when(is_focus, F.col(c))).alias(f"focus_{c}") for c in parts])
    band = lambda name, pre: F.struct(F.lit(name).alias("series_id"), *[
        F.col(pre + c).cast("bigint").alias(o) for c, o in zip(parts, ("y", "lo", "hi"))])
    est = est.select("month", "partial", F.explode(F.array(band(focus, "focus_"), band("total", ""))).alias("p")).select(
        "p.series_id", "month", "p.y", "p.lo", "p.hi",
        sigma_log(F.col("p.y"), F.col("p.lo"), F.col("p.hi")).alias("sigma"), F.lit("estimate").alias("source"), "partial")
    return with_t(stitch_series(ex, est, ["series_id"]), ["series_id"])


def tool_matrix(df: DataFrame, keys: list[str], value: str, first: str, last: str, listed: list | None = None) -> DataFrame:
    """Every month of a label range for every series; gaps are null.

    ``listed`` fixes the values of the (single) key: those without any row get
    nulls for all months, others are left out.  Rows without a month are left
    out.  The months of a series travel as one map, at most one entry per
    calendar month.
    """
    day = lambda label: F.to_date(F.lit(f"{label}-01"))
    months = F.transform(F.sequence(day(first), day(last), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    known = df.where(F.col("month").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("month", value))).alias("_known"))
    if listed is not None:
        (key,) = keys
        wanted = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in listed])).alias(key))
        known = wanted.join(known, key, "left")
    return known.select(*keys, "_known", F.explode(months).alias("month")).select(
        *keys, "month", F.col("_known")[F.col("month")].alias(value))


def fit_window(df: DataFrame, start: str, last: str | None = None) -> DataFrame:
    out = df.where((F.col("month") >= start) & ~F.col("partial"))
    return out.where(F.col("month") <= last) if last else out


def share_pct(df: DataFrame, totals: DataFrame, value: str, total: str) -> DataFrame:
    """Share of a monthly total, complete months with a known total only."""
    j = left_lookup(df.where(~F.col("partial")), totals, ["month"]).where(F.col(total).isNotNull() & (F.col(total) != 0))
    return j.withColumn("share_pct", F.try_divide(F.col(value), F.col(total)) * 100)


def headline_counts(series: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Last complete value, its change on the month before, growth multiple since the first month, and the sum."""
    grown = growth_pct(series, keys, value, out="mom_pct")
    full = ~F.col("partial")
    return grown.groupBy(*keys).agg(
        F.max_by(F.when(full, F.col("month")), F.when(full, F.col("month"))).alias("last_full_month"),
        F.max_by(F.when(full, F.col("t")), F.when(full, F.col("t"))).alias("last_full_t"),
        F.max_by(value, F.when(full, F.col("month"))).alias("last_value"),
        F.bround(F.max_by("mom_pct", F.when(full, F.col("month")))).cast("bigint").alias("mom_pct"),
        F.bround(F.try_divide(F.max_by(value, F.when(full, F.col("month"))), F.min_by(value, "month"))).cast("bigint").alias("growth_multiple"),
        F.sum(value).alias("cumulative"),
    )


def upsert_latest(old: DataFrame | None, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Old and new rows merged on the key; the greatest version wins."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return latest_per_key(both, keys, [version])


def stack(*dfs: DataFrame, labels: list | None = None, label: str = "label") -> DataFrame:
    """Union by name, optionally tagging each input."""
    out = None
    for i, df in enumerate(dfs):
        part = df.withColumn(label, F.lit(labels[i])) if labels else df
        out = part if out is None else out.unionByName(part)
    return out
