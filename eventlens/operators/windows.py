"""Calendar windows: month bounds, even splits, bisection, and estimates from repeated draws.

A month never has more than 31 days, so everything below a month is handled
inside one row with array functions; only the daily counts and the draws of a
window are aggregated across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config

# Halving 31 days five times leaves single days.
BISECTION_ROUNDS = 5


def month_start(label: Column) -> Column:
    return F.to_date(F.concat(label, F.lit("-01")))


def expand_months(df: DataFrame, token: str, out: str = "month") -> DataFrame:
    """One row per month of tokens like '2025-11..2026-02' or '2026-04'."""
    ends = F.split(token, r"\.\.")
    days = F.sequence(month_start(F.element_at(ends, 1)), month_start(F.element_at(ends, -1)), F.expr("interval 1 month"))
    # a range written backwards is empty
    days = F.when(F.element_at(ends, 1) <= F.element_at(ends, -1), days).otherwise(F.expr("array()"))
    return df.withColumn(out, F.explode(days)).withColumn(out, F.date_format(out, "yyyy-MM"))


def month_bounds(df: DataFrame, month: str, today) -> DataFrame:
    """Adds start, end, partial, days.  A month that has not ended stops yesterday."""
    today = F.lit(today).cast("date") if not isinstance(today, Column) else today
    first, last = month_start(F.col(month)), F.last_day(month_start(F.col(month)))
    partial = last >= today
    end = F.when(partial, F.least(last, F.date_sub(today, 1))).otherwise(last)
    return df.withColumns({
        "start": first, "end": end, "partial": partial,
        "days": F.greatest(F.datediff(end, first) + 1, F.lit(0)),
    })


def _window(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def split_range(start: Column, end: Column, n: Column) -> Column:
    """Array of n contiguous windows whose sizes differ by at most a day, longer ones first."""
    days = F.datediff(end, start) + 1
    n = F.greatest(F.lit(1), F.least(n.cast("int"), days))
    size, longer = F.floor(days / n).cast("int"), (days % n).cast("int")
    offset = lambda i: i * size + F.least(i, longer)
    return F.when(days >= 1, F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: _window(F.date_add(start, offset(i)), F.date_add(start, offset(i + 1) - 1)),
    )).otherwise(F.array().cast("array<struct<start:date,end:date>>"))


def planned_count(probe: Column, cap: int, inflate: float = config.WINDOW_INFLATE) -> Column:
    return F.greatest(F.lit(1), F.ceil(probe * F.lit(inflate) / F.lit(cap)))


def plan_windows(df: DataFrame, probe: str, cap: int = config.WINDOW_CAP, inflate: float = config.WINDOW_INFLATE) -> DataFrame:
    """Adds the array ``windows`` sized from a whole-range probe."""
    return df.withColumn("windows", split_range(F.col("start"), F.col("end"), planned_count(F.col(probe), cap, inflate)))


def _halves(w: str) -> str:
    """SQL for the two halves of window ``w``; the first takes the odd day."""
    mid = f"date_add({w}.start, CAST(floor(datediff({w}.`end`, {w}.start) / 2) AS INT))"
    return (f"array(named_struct('start', {w}.start, 'end', {mid}), "
            f"named_struct('start', date_add({mid}, 1), 'end', {w}.`end`))")


def bisect(df: DataFrame, windows: str, measure: str, too_big: str) -> DataFrame:
    """Halve every multi-day window of the array whose measure is too big, until none is left.

    ``measure`` is SQL over a window ``w``; ``too_big`` is SQL over its result ``{m}``.
    """
    step = F.expr(
        f"flatten(transform(transform({windows}, w -> struct(w AS w, {measure} AS m)), x -> "
        f"CASE WHEN x.w.start < x.w.`end` AND {too_big.format(m='x.m')} THEN {_halves('x.w')} ELSE array(x.w) END))")
    for _ in range(BISECTION_ROUNDS):
        df = df.withColumn(windows, step)
    return df


def bisection_tree(df: DataFrame, windows: str) -> DataFrame:
    """Extends the array by every window that bisection could ever visit."""
    levels = [windows]
    for k in range(BISECTION_ROUNDS):
        last = levels[-1]
        levels.append(f"_level{k}")
        df = df.withColumn(levels[-1], F.expr(
            f"flatten(transform(filter({last}, w -> w.start < w.`end`), w -> {_halves('w')}))"))
    return df.withColumn(windows, F.array_distinct(F.concat(*levels))).drop(*levels[1:])


def daily_counts(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """keys, month, days (map of day to count), total.  At most 31 entries per row.

    Rows without a timestamp belong to no day and are left out (``check_inputs`` counts them).
    """
    daily = df.where(F.col(ts).isNotNull()).groupBy(*keys, F.to_date(ts).alias("_day")).agg(F.count("*").alias("_n"))
    return daily.groupBy(*keys, F.date_format("_day", "yyyy-MM").alias("month")).agg(
        F.map_from_entries(F.collect_list(F.struct("_day", "_n"))).alias("day_counts"), F.sum("_n").alias("total"))


def window_total(day_counts: str, w: str) -> str:
    """SQL for the rows of window ``w``, from a map of daily counts."""
    return (f"aggregate(sequence({w}.start, {w}.`end`), CAST(0 AS BIGINT), "
            f"(acc, day) -> acc + coalesce({day_counts}[day], 0))")


def adaptive_windows(df: DataFrame, keys: list[str], ts: str, cap: int, today="9999-12-31",
                     inflate: float = config.WINDOW_INFLATE) -> DataFrame:
    """Date windows that hold at most ``cap`` rows each (or are a single day), with their counts."""
    m = plan_windows(month_bounds(daily_counts(df, keys, ts), "month", today), "total", cap, inflate)
    n = window_total("day_counts", "w")
    m = bisect(m, "windows", n, f"{{m}} > {cap}")
    counted = F.expr(f"transform(windows, w -> named_struct('start', w.start, 'end', w.`end`, 'n', {n}))")
    return m.select(*keys, "month", F.explode(counted).alias("w")).select(*keys, "month", "w.start", "w.end", "w.n")


def draw_stats(obs: DataFrame, keys: list[str], draws: int = config.WINDOW_DRAWS) -> DataFrame:
    """Per window: the draws that count, their median (truncated), least and greatest.

    ``keys`` must hold whatever identifies a request besides its dates, the query
    text ``q`` included: draws of different queries are never mixed.

    A window whose first draw is exact needs only that draw; any other needs
    all ``draws``.  ``complete`` says whether the log holds what is needed.
    """
    draw_value = lambda i: F.max(F.when(F.col("draw") == i, F.col("total_count")))
    w = obs.where(F.col("draw") < draws).groupBy(*keys, "start", "end").agg(
        F.bool_or((F.col("draw") == 0) & ~F.col("incomplete_results")).alias("exact"),
        draw_value(0).alias("first"),
        *[draw_value(i).alias(f"_d{i}") for i in range(draws)],
    )
    drawn = F.array_sort(F.array_compact(F.array(*[f"_d{i}" for i in range(draws)])))
    w = w.withColumn("_v", F.when(F.col("exact"), F.array("first")).otherwise(drawn))
    n = F.size("_v")
    mid = lambda i: F.element_at("_v", i.cast("int"))
    return w.select(
        *keys, "start", "end", "exact", "first", n.cast("bigint").alias("n_draws"),
        ((mid(F.floor((n + 1) / 2)) + mid(F.floor(n / 2) + 1)) / 2).cast("bigint").alias("median"),
        F.array_min("_v").alias("lo"), F.array_max("_v").alias("hi"),
        (F.col("first").isNotNull() & (F.col("exact") | (n == draws))).alias("complete"),
    )


def month_estimate(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of medians, minima and maxima over the windows of a month."""
    return windows.groupBy(*keys, F.date_format("start", "yyyy-MM").alias("month")).agg(
        F.sum("median").alias("estimate"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"),
        F.count("*").alias("n_windows"))


def estimate_months(obs: DataFrame, keys: list[str], today, cap: int = config.WINDOW_CAP,
                    draws: int = config.WINDOW_DRAWS, inflate: float = config.WINDOW_INFLATE,
                    current_query: Column | None = None) -> DataFrame:
    """Monthly estimates replayed from a deduplicated observation log.

    ``current_query`` is the query text of today, as a column of the log; calls
    with another text don't count.  Without it there is one row per query text
    (column ``q``, if the log has it).

    For each month the whole-month probe sizes the windows, any window whose
    first draw or median exceeds the cap is halved, and the windows left are
    summed.  ``complete`` is false, and the estimate null, when a draw that
    the replay needs is not in the log.  Two shuffles: one row per window, then
    the windows of a month (at most 496) into one row.
    """
    if current_query is None:
        keys = [*keys, "q"] if "q" in obs.columns else keys
    else:
        obs = obs.where(F.col("q") == current_query)
    stats = draw_stats(obs.where(F.col("start").isNotNull() & F.col("end").isNotNull()), keys, draws)
    packed = F.struct("first", "median", "lo", "hi", "n_draws", "complete")
    m = stats.groupBy(*keys, F.date_format("start", "yyyy-MM").alias("month")).agg(
        F.map_from_entries(F.collect_list(F.struct(_window(F.col("start"), F.col("end")).alias("k"), packed.alias("v")))).alias("seen"))
    m = month_bounds(m, "month", today)
    seen = F.col("seen")
    m = m.withColumn("probe_whole_month", seen[_window(F.col("start"), F.col("end"))]["first"])
    m = plan_windows(m, "probe_whole_month", cap, inflate)
    m = bisect(m, "windows", "seen[w]",
               f"coalesce({{m}}.first > {cap} OR ({{m}}.complete AND {{m}}.median > {cap}), false)")
    leaves = F.expr("transform(windows, w -> seen[w])")
    known = ["probe_whole_month", "partial", F.col("days").alias("days_covered")]
    # still partitioned by (keys, month): this aggregation needs no further shuffle
    rows = m.select(*keys, "month", *known, F.explode_outer(leaves).alias("s"))
    complete = F.max("probe_whole_month").isNotNull() & F.bool_and(F.coalesce("s.complete", F.lit(False)))
    total = lambda f: F.when(F.col("complete"), F.col(f"_{f}"))
    return rows.groupBy(*keys, "month").agg(
        complete.alias("complete"), F.count("s").alias("n_windows"),
        F.max("probe_whole_month").alias("probe_whole_month"), F.bool_or("partial").alias("partial"),
        F.max("days_covered").alias("days_covered"),
        *[F.sum(f"s.{f}").alias(f"_{f}") for f in ("median", "lo", "hi", "n_draws")],
    ).select(
        *keys, "month", total("median").alias("estimate"), total("lo").alias("lo"), total("hi").alias("hi"),
        "n_windows", F.lit(draws).alias("n_draws"), total("n_draws").alias("draws_used"), "probe_whole_month", "partial",
        "days_covered", F.lit(config.ESTIMATE_METHOD).alias("method"), "complete",
    )
