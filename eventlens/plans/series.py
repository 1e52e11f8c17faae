"""Sampling windows, observation-log estimates and stitched monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import config
from eventlens.operators import series as S
from eventlens.operators import windows as W
from eventlens.plans.distribution import r6, rounded
from eventlens.plans.registry import query
from eventlens.plans.sqlbase import ORDER_PUSHES, SIZED_PUSHES, YM
from eventlens.plans.stats import SERIES, monthly_orders
from eventlens.sources import adapters
from eventlens.sources.adapters import observation_log, order_archive, table
from eventlens.sources.tables import check_inputs, dedupe_observations, month_date, quarter_date
from eventlens.operators.distribution import size_distribution, velocity

TODAY, CAP = adapters.LOG_TODAY, adapters.LOG_CAP
EXACT_LAST = "1999-06"
TOOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FOCUS = "1-URGENT"


# ---- calendar --------------------------------------------------------------
@query("expanded_months", "PF15", "SC16", sql="""
WITH span AS (SELECT o_orderpriority AS series, date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b,
                     min(o_orderdate) AS first FROM orders GROUP BY 1)
SELECT series, 'range' AS kind, strftime(unnest(generate_series(a, b, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM span
UNION ALL SELECT series, 'single', strftime(first, '%Y-%m') FROM span""")
def expanded_months(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("b"))
    tokens = o.select("series", F.explode(F.array(
        F.struct(F.lit("range").alias("kind"), F.concat("a", F.lit(".."), "b").alias("token")),
        F.struct(F.lit("single").alias("kind"), F.col("a").alias("token")))).alias("x")).select("series", "x.*")
    return W.expand_months(tokens, "token").drop("token")


_MONTHS = f"""
days AS (SELECT o_orderpriority AS tool, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders
         WHERE o_orderdate < TIMESTAMP '{TODAY}' GROUP BY 1, 2),
months AS (
  SELECT tool, strftime(d, '%Y-%m') AS month, CAST(date_trunc('month', min(d)) AS DATE) AS start,
         least(last_day(min(d)), DATE '{TODAY}' - 1) AS "end", last_day(min(d)) >= DATE '{TODAY}' AS partial, sum(n)::BIGINT AS total
  FROM days GROUP BY 1, 2
)"""


_ALL_MONTHS = _MONTHS.replace(f"WHERE o_orderdate < TIMESTAMP '{TODAY}' ", "").replace(f"least(last_day(min(d)), DATE '{TODAY}' - 1)", "last_day(min(d))").replace(
    f"last_day(min(d)) >= DATE '{TODAY}'", "false")
FUTURE = "9999-12-31"


def _split_sql(src: str, n: str, extra: str) -> str:
    """Rows of the even split of [start, end] of ``src`` into n windows."""
    q = f"((\"end\" - start + 1) // {n})"
    r = f"((\"end\" - start + 1) % {n})"
    return f"""SELECT {extra}, start + CAST(i * {q} + least(i, {r}) AS INTEGER) AS start,
         start + CAST((i + 1) * {q} + least(i + 1, {r}) - 1 AS INTEGER) AS "end"
  FROM (SELECT *, unnest(range(0, {n})) AS i FROM {src})"""


_N = "greatest(1, least(CAST(ceil({p} * 1.6 / {cap}) AS INTEGER), \"end\" - start + 1))"


@query("month_bounds", "SE1", sql=f"""WITH {_MONTHS}
SELECT tool, month, start, "end", partial, CAST("end" - start + 1 AS INTEGER) AS days FROM months""")
def month_bounds(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit(TODAY).cast("timestamp_ntz"))
    m = o.select(F.col("o_orderpriority").alias("tool"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return W.month_bounds(m, "month", TODAY)


@query("split_windows", "SE2", sql=f"""WITH {_ALL_MONTHS},
m AS (SELECT *, least(CAST(total % 9 + 1 AS BIGINT), "end" - start + 1) AS n FROM months)
{_split_sql('m', 'n', 'tool, month')}""")
def split_windows(spark, d):
    m = _months(spark, d).withColumn("w", F.explode(W.split_range(F.col("start"), F.col("end"), F.col("total") % 9 + 1)))
    return m.select("tool", "month", "w.start", "w.end")


def _months(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tool"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("total"))
    return W.month_bounds(m, "month", FUTURE)


@query("planned_windows", "SE3", "SE2", sql=f"""WITH {_ALL_MONTHS},
m AS (SELECT *, {_N.format(p='total', cap=20)} AS n FROM months)
{_split_sql('m', 'n', 'tool, month, n AS n_windows')}""")
def planned_windows(spark, d):
    m = W.plan_windows(_months(spark, d), "total", 20)
    return m.select("tool", "month", F.size("windows").alias("n_windows"), F.explode("windows").alias("w")).select(
        "tool", "month", F.col("n_windows").cast("bigint").alias("n_windows"), "w.start", "w.end")


def _halves_sql(src: str) -> str:
    return f"""SELECT tool, month, start + CAST(h.i * (floor(("end" - start) / 2) + 1) AS INTEGER) AS start,
         CASE WHEN h.i = 0 THEN start + CAST(floor(("end" - start) / 2) AS INTEGER) ELSE "end" END AS "end"
  FROM {src}, (VALUES (0), (1)) h(i)"""


@query("adaptive_windows", "SE4", sql=f"""WITH RECURSIVE {_ALL_MONTHS},
m AS (SELECT *, {_N.format(p='total', cap=9)} AS n FROM months),
cnt AS (SELECT tool, d, sum(n) OVER (PARTITION BY tool, strftime(d, '%Y-%m') ORDER BY d) AS c, strftime(d, '%Y-%m') AS month FROM days),
w(tool, month, start, "end", n) AS (
  SELECT p.*, (SELECT coalesce(sum(x.n), 0) FROM days x WHERE x.tool = p.tool AND x.d BETWEEN p.start AND p."end")::BIGINT
  FROM ({_split_sql('m', 'n', 'tool, month')}) p
  UNION ALL
  SELECT p.*, (SELECT coalesce(sum(x.n), 0) FROM days x WHERE x.tool = p.tool AND x.d BETWEEN p.start AND p."end")::BIGINT
  FROM ({_halves_sql('w')} WHERE n > 9 AND start < "end") p
)
SELECT * FROM w WHERE n <= 9 OR start = "end" """)
def adaptive_windows(spark, d):
    o = table(spark, d, "orders")
    return W.adaptive_windows(o.withColumnRenamed("o_orderpriority", "tool"), ["tool"], "o_orderdate", 9)


# ---- observation log -------------------------------------------------------
def _reported(x: str) -> str:
    return f"(CASE WHEN {x} > {adapters.LOG_TRUNCATE_ABOVE} THEN CAST(floor({x} * 65 / 100.0) AS BIGINT) ELSE {x} END)"


_TREE = f"""{_MONTHS},
probed AS (SELECT *, {_reported('total')} AS probe FROM months),
m AS (SELECT *, {_N.format(p='probe', cap=CAP)} AS n FROM probed),
planned AS ({_split_sql('m', 'n', 'tool, month')}),
tree(tool, month, start, "end") AS (
  SELECT * FROM planned
  UNION
  {_halves_sql('tree')} WHERE start < "end"
),
win AS (
  SELECT t.tool, t.month, t.start, t."end", {_reported('coalesce(sum(x.n), 0)::BIGINT')} AS base
  FROM (SELECT * FROM tree UNION SELECT tool, month, start, "end" FROM months) t
  LEFT JOIN days x ON x.tool = t.tool AND x.d BETWEEN t.start AND t."end" GROUP BY 1, 2, 3, 4
),
log AS (
  SELECT tool, month, start, "end", CAST(draw AS INTEGER) AS draw, base + [0, 5, 2][draw + 1] AS total_count,
         tool <> '{adapters.LOG_EXACT_TOOL}' AS incomplete_results
  FROM (SELECT *, unnest(CASE WHEN tool = '{adapters.LOG_EXACT_TOOL}' THEN [0] ELSE [0, 1, 2] END) AS draw FROM win)
),
stat AS (
  SELECT tool, month, start, "end", bool_or(NOT incomplete_results) AS exact, max(total_count) FILTER (draw = 0) AS first,
         count(*) AS n_draws, CAST(floor(median(total_count)) AS BIGINT) AS median, min(total_count) AS lo, max(total_count) AS hi
  FROM log GROUP BY 1, 2, 3, 4
)"""

_ESTIMATES = f"""{_TREE},
visit(tool, month, start, "end") AS (
  SELECT * FROM planned
  UNION ALL
  {_halves_sql(f'(SELECT v.* FROM visit v JOIN stat s USING (tool, month, start, "end") WHERE (s.first > {CAP} OR s.median > {CAP}) AND v.start < v."end")')}
),
leaf AS (SELECT s.* FROM visit JOIN stat s USING (tool, month, start, "end")
         WHERE NOT ((first > {CAP} OR median > {CAP}) AND start < "end")),
estimates AS (
  SELECT l.tool, l.month, sum(l.median)::BIGINT AS estimate, sum(l.lo)::BIGINT AS lo, sum(l.hi)::BIGINT AS hi,
         count(*) AS n_windows, sum(l.n_draws)::BIGINT AS draws_used, max(p.first) AS probe_whole_month,
         any_value(m.partial) AS partial, any_value(CAST(m."end" - m.start + 1 AS INTEGER)) AS days_covered
  FROM leaf l JOIN m USING (tool, month) JOIN stat p ON p.tool = m.tool AND p.start = m.start AND p."end" = m."end"
  GROUP BY 1, 2
)"""


@query("latest_observations", "SRC5", "W6", "SO2", sql=f"""WITH RECURSIVE {_TREE}
SELECT tool, 'priority:' || tool AS q, start, "end", draw, total_count, incomplete_results FROM log""")
def latest_observations(spark, d):
    return dedupe_observations(observation_log(spark, d)).select(
        "tool", "q", "start", "end", "draw", "total_count", "incomplete_results")


@query("window_draws", "SE5", "AG16", sql=f"""WITH RECURSIVE {_TREE}
SELECT tool, 'priority:' || tool AS q, start, "end", exact, first, n_draws, median, lo, hi, true AS complete FROM stat""")
def window_draws(spark, d):
    return W.draw_stats(dedupe_observations(observation_log(spark, d)), ["tool", "q"])


def current_query():
    """Query text of each tool today."""
    return F.concat(F.lit("priority:"), F.col("tool"))


def _estimates(spark, d):
    return W.estimate_months(dedupe_observations(observation_log(spark, d)), ["tool"], TODAY, CAP, current_query=current_query())


@query("month_estimates", "SE6", "AG16", "AG17", "SE5", sql=f"""WITH RECURSIVE {_ESTIMATES}
SELECT *, 3 AS n_draws, '{config.ESTIMATE_METHOD}' AS method, true AS complete FROM estimates""")
def month_estimates(spark, d):
    return _estimates(spark, d)


@query("planned_month_estimates", "AG17", "AG16", sql=f"""WITH RECURSIVE {_TREE}
SELECT p.tool, p.month, sum(s.median)::BIGINT AS estimate, sum(s.lo)::BIGINT AS lo, sum(s.hi)::BIGINT AS hi, count(*) AS n_windows
FROM planned p JOIN stat s USING (tool, start, "end") GROUP BY 1, 2""")
def planned_month_estimates(spark, d):
    """Estimates from the windows that the whole-month probe plans, without bisection."""
    stats = W.draw_stats(dedupe_observations(observation_log(spark, d)), ["tool", "q"]).where(F.col("q") == current_query())
    months = stats.select("tool", F.date_format("start", "yyyy-MM").alias("month")).distinct()
    bounds = W.month_bounds(months, "month", TODAY).join(stats.select("tool", "start", "end", F.col("first").alias("probe")), ["tool", "start", "end"])
    plan = W.plan_windows(bounds, "probe", CAP).select("tool", F.explode("windows").alias("w")).select("tool", "w.start", "w.end")
    return W.month_estimate(plan.join(stats, ["tool", "start", "end"]), ["tool"])


@query("upserted_months", "SNK1", "SO2", "W6", sql="""
WITH old AS (SELECT o_orderpriority AS tool, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS estimate FROM orders
             WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2),
new AS (SELECT o_orderpriority AS tool, strftime(o_orderdate, '%Y-%m') AS month, max(o_custkey) AS estimate FROM orders
        WHERE o_orderdate >= TIMESTAMP '1998-06-01' GROUP BY 1, 2)
SELECT tool, month, estimate, CAST(2 AS INTEGER) AS version FROM new
UNION ALL SELECT tool, month, estimate, CAST(1 AS INTEGER) FROM old ANTI JOIN new USING (tool, month)""")
def upserted_months(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("tool"), "o_custkey", "o_orderdate",
                                         F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    old = o.where(F.col("o_orderdate") < ts("1999-01-01")).groupBy("tool", "month").agg(F.count("*").alias("estimate"))
    new = o.where(F.col("o_orderdate") >= ts("1998-06-01")).groupBy("tool", "month").agg(F.max("o_custkey").alias("estimate"))
    return S.upsert_latest(old.withColumn("version", F.lit(1)), new.withColumn("version", F.lit(2)), ["tool", "month"])


# ---- stitched series -------------------------------------------------------
def exact_counts(spark, d):
    """Exact monthly counts per priority up to the month the source ends."""
    o = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1999-07-01").cast("timestamp_ntz"))
    return o.groupBy(F.col("o_orderpriority").alias("tool"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("value"))


def stitched(spark, d):
    return S.build_series(exact_counts(spark, d), _estimates(spark, d), TOOLS, FOCUS)


_STITCH = f"""{_ESTIMATES},
exact AS (SELECT o_orderpriority AS tool, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS value FROM orders
          WHERE o_orderdate < TIMESTAMP '1999-07-01' GROUP BY 1, 2),
whole AS (SELECT month, sum(estimate) AS estimate, sum(lo) AS lo, sum(hi) AS hi, bool_or(partial) AS partial
          FROM estimates WHERE month > '{EXACT_LAST}' GROUP BY 1 HAVING count(DISTINCT tool) = 5),
st AS (
  SELECT '{FOCUS}' AS series_id, month, value AS y, value AS lo, value AS hi, 0.05 AS sigma, 'exact' AS source, false AS partial
  FROM exact WHERE tool = '{FOCUS}'
  UNION ALL SELECT '{FOCUS}', month, e.estimate, e.lo, e.hi, greatest(0.10, (e.hi - e.lo) / (2.0 * e.estimate)), 'estimate', w.partial
  FROM estimates e JOIN whole w USING (month) WHERE tool = '{FOCUS}'
  UNION ALL SELECT 'total', month, sum(value), sum(value), sum(value), 0.05, 'exact', false FROM exact GROUP BY 2
  UNION ALL SELECT 'total', month, estimate, lo, hi, greatest(0.10, (hi - lo) / (2.0 * estimate)), 'estimate', partial FROM whole
),
stitched AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) - 1 AS t FROM st)"""


@query("stitched_series", "SE8", "J4", "AG14", "AG15", "SE7", "W4", sql=f"""WITH RECURSIVE {_STITCH}
SELECT series_id, month, t, CAST(y AS BIGINT) AS y, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi,
       {r6('CAST(sigma AS DOUBLE)', 'sigma')}, source, partial FROM stitched""")
def stitched_series(spark, d):
    return rounded(stitched(spark, d).withColumnRenamed("series_id", "s").withColumn(
        "series_id", F.when(F.col("s") == FOCUS, FOCUS).otherwise("total")).drop("s"), "sigma")


@query("complete_totals", "AG15", "AG14", "SE7", sql=f"""WITH RECURSIVE {_ESTIMATES}
SELECT month, sum(estimate)::BIGINT AS estimate, sum(lo)::BIGINT AS lo, sum(hi)::BIGINT AS hi, bool_or(partial) AS partial,
       {r6('greatest(0.10, (sum(hi) - sum(lo)) / (2.0 * sum(estimate)))::DOUBLE', 'sigma')}
FROM estimates GROUP BY 1 HAVING count(DISTINCT tool) = 5""")
def complete_totals(spark, d):
    out = S.complete_total(_estimates(spark, d), TOOLS)
    return rounded(out.withColumn("sigma", S.sigma_log(F.col("estimate"), F.col("lo"), F.col("hi"))), "sigma")


@query("headline", "AG18", "W3", "W5", "SC17", sql=f"""WITH RECURSIVE {_STITCH},
g AS (SELECT *, (y / lag(y) OVER (PARTITION BY series_id ORDER BY month)::DOUBLE - 1) * 100 AS mom FROM stitched)
SELECT series_id, max(month) FILTER (NOT partial) AS last_full_month, max(t) FILTER (NOT partial) AS last_full_t,
       arg_max(y, month) FILTER (NOT partial)::BIGINT AS last_value,
       CAST(round_even(arg_max(mom, month) FILTER (NOT partial), 0) AS BIGINT) AS mom_pct,
       CAST(round_even(arg_max(y, month) FILTER (NOT partial) / arg_min(y, month)::DOUBLE, 0) AS BIGINT) AS growth_multiple,
       sum(y)::BIGINT AS cumulative
FROM g GROUP BY 1""")
def headline(spark, d):
    return S.headline_counts(stitched(spark, d), ["series_id"])


@query("share_of_total", "ST12", "J3", sql=f"""WITH RECURSIVE {_STITCH},
lines AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT month, CAST(y AS BIGINT) AS y, n_lines, {r6('y / n_lines::DOUBLE * 100', 'share_pct')}
FROM stitched JOIN lines USING (month) WHERE series_id = 'total' AND NOT partial""")
def share_of_total(spark, d):
    # lines collapse to one count per order before they meet the order dates
    per_order = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    lines = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).join(
        per_order, "o_orderkey").groupBy("month").agg(F.sum("c").alias("n_lines"))
    total = stitched(spark, d).where(F.col("series_id") == "total").select("month", "y", "partial")
    return rounded(S.share_pct(total, lines, "y", "n_lines").drop("partial"), "share_pct")


@query("tool_matrix", "SE9", "J3", sql=f"""
WITH c AS (SELECT c_nationkey || ':' || o_orderpriority AS tool, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS y
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
g AS (SELECT DISTINCT tool, strftime(unnest(generate_series((SELECT CAST(min(month) || '-01' AS TIMESTAMP) FROM c),
      (SELECT CAST(max(month) || '-01' AS TIMESTAMP) FROM c), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM c)
SELECT tool, month, y FROM g LEFT JOIN c USING (tool, month)""")
def tool_matrix(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    # (customer, priority, month) counts first, so a hot customer joins as a few rows
    per_cust = o.groupBy("o_custkey", "o_orderpriority", "month").agg(F.count("*").alias("c"))
    c = per_cust.join(cust, "o_custkey").groupBy(
        F.concat("c_nationkey", F.lit(":"), "o_orderpriority").alias("tool"), "month").agg(F.sum("c").alias("y"))
    span = table(spark, d, "orders").agg(*[F.date_format(f("o_orderdate"), "yyyy-MM").alias(n) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    return S.tool_matrix(c, ["tool"], "y", span.a, span.b)


_LISTED = [*TOOLS, "6-NONE"]


@query("listed_tool_matrix", "SE9", "J3", sql=f"""
WITH c AS (SELECT o_orderpriority AS tool, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS y FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1, 2),
t AS (SELECT unnest([{', '.join(repr(t) for t in _LISTED)}]) AS tool),
g AS (SELECT tool, strftime(unnest(generate_series(TIMESTAMP '1995-11-01', TIMESTAMP '2001-02-01', INTERVAL 1 MONTH)), '%Y-%m') AS month FROM t)
SELECT tool, month, y FROM g LEFT JOIN c USING (tool, month)""")
def listed_tool_matrix(spark, d):
    """All listed tools, two of them without a row."""
    c = table(spark, d, "orders").where("o_orderpriority <> '3-MEDIUM'").groupBy(
        F.col("o_orderpriority").alias("tool"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("y"))
    return S.tool_matrix(c, ["tool"], "y", "1995-11", "2001-02", listed=_LISTED)


@query("filled_months", "J4", "SE8", sql=f"""WITH RECURSIVE {_ESTIMATES},
exact AS (SELECT o_orderpriority AS tool, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS y FROM orders
          WHERE o_orderdate < TIMESTAMP '1999-07-01' AND month(o_orderdate) <> 3 GROUP BY 1, 2)
SELECT tool, month, y, 'exact' AS source FROM exact
UNION ALL SELECT tool, month, estimate, 'estimate' FROM estimates ANTI JOIN exact USING (tool, month)""")
def filled_months(spark, d):
    """Month by month: estimates fill what the exact counts lack, gaps in between included."""
    exact = exact_counts(spark, d).where(~F.col("month").endswith("-03")).select("tool", "month", F.col("value").alias("y"), F.lit("exact").alias("source"))
    other = _estimates(spark, d).select("tool", "month", F.col("estimate").alias("y"), F.lit("estimate").alias("source"))
    return S.stitch_series(exact, other, ["tool"], by_month=True)


@query("pivoted_series", "AG13", sql=f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month,
  {', '.join(f"count(*) FILTER (o_orderpriority = '{t}') AS n_{t[0]}, max(o_totalprice) FILTER (o_orderpriority = '{t}') AS top_{t[0]}" for t in TOOLS)}
FROM orders GROUP BY 1""")
def pivoted_series(spark, d):
    long = table(spark, d, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("tool")).agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    wide = S.pivot_series(long, "month", "tool", TOOLS, ["n", "top"])
    return wide.select("month", *[F.coalesce(F.col(f"`{t}_n`"), F.lit(0)).alias(f"n_{t[0]}") for t in TOOLS],
                       *[F.col(f"`{t}_top`").alias(f"top_{t[0]}") for t in TOOLS])


@query("monthly_growth", "W3", "W4", sql=f"""WITH {SERIES}
SELECT series_id, month, t, y, {r6('(y / lag(y) OVER (PARTITION BY series_id ORDER BY month)::DOUBLE - 1) * 100', 'growth_pct')} FROM series""")
def monthly_growth(spark, d):
    s = S.with_t(monthly_orders(spark, d).select("series_id", "month", "y"), ["series_id"])
    return rounded(S.growth_pct(s, ["series_id"], "y"), "growth_pct")


_YEARLY = {"total_pushes": "sum(p)::BIGINT", "avg_unique_pushers": "avg(u)", "avg_pushes_per_dev": "avg(p / u::DOUBLE)"}


@query("yearly_growth", "W3", "AG12", sql=f"""WITH {ORDER_PUSHES},
m AS (SELECT {YM}, count(*) AS p, count(DISTINCT login) AS u FROM order_pushes GROUP BY 1, 2),
a AS (SELECT year, {', '.join(f"{e} AS {n}" for n, e in _YEARLY.items())} FROM m GROUP BY 1)
SELECT year, {', '.join(r6(f"({n} / lag({n}) OVER (ORDER BY year)::DOUBLE - 1) * 100", f"{n}_growth_pct") for n in _YEARLY)} FROM a""")
def yearly_growth(spark, d):
    """Year-on-year change of all three yearly measures."""
    from eventlens.operators.distribution import annual_rollup

    a = annual_rollup(velocity(order_archive(spark, d))).withColumn("_all", F.lit(1))
    for n in _YEARLY:
        a = S.growth_pct(a, ["_all"], n, "year", out=f"{n}_growth_pct")
    names = [f"{n}_growth_pct" for n in _YEARLY]
    return rounded(a.select("year", *names), *names)


@query("last_full_period", "W5", sql=f"""WITH RECURSIVE {_STITCH}
SELECT series_id, max(month) FILTER (NOT partial) AS last_full_month, max(t) FILTER (NOT partial) AS last_full_t,
       arg_max(y, month) FILTER (NOT partial)::BIGINT AS last_value FROM stitched GROUP BY 1""")
def last_full_period(spark, d):
    return S.last_full(stitched(spark, d), ["series_id"], "y")


@query("calendar_axis", "W4", "SEM-9", sql="""
WITH m AS (SELECT DISTINCT o_custkey AS series_id, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT series_id, month, date_diff('month', min(CAST(month || '-01' AS DATE)) OVER (PARTITION BY series_id), CAST(month || '-01' AS DATE)) AS t FROM m""")
def calendar_axis(spark, d):
    """Months since the first order of each customer; customers skip months."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("series_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return S.with_t(o.distinct(), ["series_id"], calendar=True)


@query("fit_window", "SE10", sql=f"""WITH RECURSIVE {_STITCH}
SELECT series_id, month, t, CAST(y AS BIGINT) AS y FROM stitched WHERE month BETWEEN '1996-02' AND '2001-03' AND NOT partial""")
def fit_window(spark, d):
    return S.fit_window(stitched(spark, d), "1996-02", "2001-03").select("series_id", "month", "t", "y")


# ---- flat inputs -----------------------------------------------------------
@query("monthly_dates", "SRC3", "SC15", sql=f"""WITH {ORDER_PUSHES}
SELECT {YM}, CAST(date_trunc('month', created_at) AS DATE) AS date, count(*) AS total_pushes FROM order_pushes GROUP BY ALL""")
def monthly_dates(spark, d):
    return month_date(velocity(order_archive(spark, d)).select("year", "month", "total_pushes"))


@query("quarterly_dates", "SRC3", "SC15", sql=f"""WITH {SIZED_PUSHES}
SELECT CAST(year(created_at) AS INTEGER) AS year, CAST(quarter(created_at) AS INTEGER) AS quarter,
       CAST(date_trunc('quarter', created_at) AS DATE) AS date, count(*) AS total_push_events FROM sized GROUP BY ALL""")
def quarterly_dates(spark, d):
    return quarter_date(size_distribution(order_archive(spark, d, with_size=True)).select("year", "quarter", "total_push_events"))


# input: its time column and all its columns
_CHECKED = {
    "region": (None, "r_regionkey r_name"),
    "nation": (None, "n_nationkey n_name n_regionkey"),
    "customer": (None, "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
    "supplier": (None, "s_suppkey s_name s_nationkey s_acctbal"),
    "part": (None, "p_partkey p_name p_brand p_type p_size p_retailprice"),
    "orders": ("o_orderdate", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
    "lineitem": ("l_shipdate", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"),
    "events": ("ts", "event_id ts user_id event_type value props"),
    "documents": (None, "doc_id text lang source n_chars"),
    "embeddings": (None, "vec_id embedding label"),
    "pages": (None, "page_id url html"),
    "benchmark": (None, "item_id text"),
    "labels": (None, "doc_id quality toxic"),
    "conversations": (None, "conv_id turn role text"),
}


def _check_sql(name: str, ts: str | None, columns: str) -> str:
    edge = lambda f: f"CAST({f}({ts}) AS VARCHAR)" if ts else "NULL"
    return f"""SELECT '{name}' AS input, count(*) AS n_rows, count(*) > 0 AS present, {edge('min')} AS first, {edge('max')} AS last,
       count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in columns.split())}) AS n_null_rows FROM {name}"""


@query("input_check", "SRC7", sql="\nUNION ALL ".join(_check_sql(n, *x) for n, x in _CHECKED.items()))
def input_check(spark, d):
    """All tables with all their columns."""
    return check_inputs({n: (table(spark, d, n), ts) for n, (ts, _) in _CHECKED.items()})
