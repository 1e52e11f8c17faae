"""Two-sample, trend and break queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.functions import text as X
from eventlens.operators import changepoint, stats
from eventlens.plans.distribution import r6, rounded
from eventlens.plans.registry import query
from eventlens.plans.text import DOC_FEATURES
from eventlens.session import materialise
from eventlens.sources.adapters import table

# ---- shared inputs ---------------------------------------------------------


def monthly_orders(spark, d):
    """series_id (market segment), month, date, t, y = orders of the month, users, ratio."""
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("series_id"))
    o = table(spark, d, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("date"))
    # (customer, month) counts first: the join and both distincts then see far fewer rows
    per_cust = o.groupBy("o_custkey", "date").agg(F.count("*").alias("c"))
    m = per_cust.join(cust, "o_custkey").groupBy("series_id", "date").agg(
        F.sum("c").alias("y"), F.count("*").alias("users"))
    w = Window.partitionBy("series_id").orderBy("date")
    return m.select("series_id", F.date_format("date", "yyyy-MM").alias("month"), "date",
                    (F.row_number().over(w) - 1).alias("t"), "y", "users")


SERIES = """
series AS (
  SELECT series_id, strftime(date, '%Y-%m') AS month, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS t, y, users
  FROM (SELECT c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               count(*) AS y, count(DISTINCT o_custkey) AS users
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
)"""

# Two breaks per series, a third and two thirds into it.
BREAKS = """
breaks AS (SELECT series_id, unnest([max(t) // 3, 2 * max(t) // 3]) AS break_t FROM series GROUP BY 1)"""


def third_breaks(series):
    last = series.groupBy("series_id").agg(F.max("t").alias("m"))
    return last.select("series_id", F.explode(F.array(F.floor(F.col("m") / 3), F.floor(2 * F.col("m") / 3))).alias("break_t"))


# ---- tail probabilities by Simpson's rule ----------------------------------
_W = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def normal_p_sql(z: str) -> str:
    b = f"least(abs({z}), 12.0)"
    return (f"greatest(0.0, 1 - 2 * ({b}) / 2000 / 3 / sqrt(2 * pi()) * "
            f"list_sum(list_transform(range(0, 2001), lambda i: {_W} * exp(-0.5 * pow(({b}) * i / 2000, 2)))))")


def student_p_sql(t: str, nu: str) -> str:
    b = f"atan(abs({t}) / sqrt({nu}))"
    return (f"greatest(0.0, 1 - 2 * exp(lgamma((({nu}) + 1) / 2) - lgamma(({nu}) / 2)) / sqrt(pi()) * ({b}) / 2000 / 3 * "
            f"list_sum(list_transform(range(0, 2001), lambda i: {_W} * pow(cos(({b}) * i / 2000), ({nu}) - 1))))")


def labelled_features(spark, d):
    """Features of labelled documents; joining first leaves the rest of the texts unparsed."""
    docs = table(spark, d, "documents").select("doc_id", "text").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return X.text_features(docs, "text").drop("text")


# ---- rank-sum tests --------------------------------------------------------
def _rank_sum_sql(rows: str, key: str, p_digits: int = 6) -> str:
    """rows: relation with key, value, first (boolean)."""
    return f"""
ranked AS (
  SELECT {key}, value, first, rank() OVER (PARTITION BY {key} ORDER BY value) + (count(*) OVER (PARTITION BY {key}, value) - 1) / 2.0 AS rk,
         count(*) OVER (PARTITION BY {key}, value) AS ties
  FROM {rows} WHERE value IS NOT NULL
),
sums AS (
  SELECT {key}, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2,
         sum(rk) FILTER (first) AS r1, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie_term
  FROM ranked GROUP BY 1
),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u,
             sqrt(n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - tie_term / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS s FROM sums),
zed AS (SELECT *, (greatest(u, n1::DOUBLE * n2 - u) - n1::DOUBLE * n2 / 2 - 0.5) / nullif(s, 0) AS z FROM u),
pv AS (SELECT *, CASE WHEN coalesce(z, 0) <= 0 THEN 1.0::DOUBLE ELSE {normal_p_sql('z')} END AS p FROM zed)
SELECT {key}, n1, n2, CAST(u AS DOUBLE) AS u, {r6('1 - 2 * u / (n1::DOUBLE * n2)', 'rank_biserial')},
       {r6('z', 'z')}, round(p, {p_digits}) + 0.0 AS p_value,
       p < 0.05 AS significant FROM pv"""


@query("text_feature_rank_tests", "ST1", "ST2", "ST11", "SO3", sql=f"""WITH {DOC_FEATURES},
long AS (
  SELECT feature, value, quality = 0 AS first
  FROM (UNPIVOT (SELECT doc_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in X.FEATURES)} FROM feat)
        ON {', '.join(X.FEATURES)} INTO NAME feature VALUE value) JOIN labels USING (doc_id)
),
{_rank_sum_sql('long', 'feature').lstrip()}""")
def text_feature_rank_tests(spark, d):
    feats = labelled_features(spark, d)
    long = X.unpivot_features(feats, ["quality"])
    out = stats.mann_whitney(long, ["feature"], "value", F.col("quality") == 0)
    return rounded(out, "rank_biserial", "z", "p_value")


@query("order_value_rank_test", "ST1", "ST2", "ST11", sql=f"""
WITH vals AS (SELECT o_orderpriority AS series, o_totalprice AS value, o_orderdate < TIMESTAMP '1998-05-01' AS first FROM orders),
{_rank_sum_sql('vals', 'series').lstrip()}""")
def order_value_rank_test(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_totalprice").alias("value"),
        (F.col("o_orderdate") < F.lit("1998-05-01").cast("timestamp_ntz")).alias("first"))
    out = stats.mann_whitney(o, ["series"], "value", F.col("first"))
    return rounded(out, "rank_biserial", "z", "p_value")


# Three orders of each priority against all others, by a key without ties: the exact distribution of the rank sum,
# counted as the ways to write a sum of three ordered numbers of at most n2.
_UNTIED = "(o_orderkey * 7919) % 1000003"


@query("small_sample_rank_test", "ST1", "ST11", sql=f"""
WITH vals AS (SELECT o_orderpriority AS series, {_UNTIED} AS value,
                     row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 3 AS first FROM orders),
ranked AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY value) AS rk FROM vals),
u AS (SELECT series, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(rk) FILTER (first) - 6 AS u FROM ranked GROUP BY 1),
k AS (SELECT *, CAST(least(u, n1 * n2 - u) AS BIGINT) AS k FROM u),
a AS (SELECT *, unnest(generate_series(0, least(n2, k // 3))) AS a FROM k),
b AS (SELECT *, unnest(generate_series(a, least(n2, (k - a) // 2))) AS b FROM a),
ways AS (SELECT series, any_value(n1) AS n1, any_value(n2) AS n2, any_value(u) AS u, sum(least(n2, k - a - b) - b + 1) AS tail FROM b GROUP BY 1)
SELECT series, n1, n2, CAST(u AS DOUBLE) AS u,
       {r6('least(1.0, 2 * tail / ((n2 + 1)::DOUBLE * (n2 + 2) * (n2 + 3) / 6))::DOUBLE', 'p_value')} FROM ways""")
def small_sample_rank_test(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), "o_orderkey", F.expr(_UNTIED).alias("value"))
    # the three smallest keys of a priority: an aggregate, so that no priority is one task
    least = F.slice(F.array_sort(F.collect_set("o_orderkey")), 1, 3)
    some = o.groupBy("series", F.pmod(F.xxhash64("o_orderkey"), F.lit(64)).alias("part")).agg(least.alias("keys"))
    some = some.groupBy("series").agg(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, 3).alias("keys"))
    rows = o.join(some, "series").withColumn("first", F.array_contains("keys", F.col("o_orderkey")))
    out = stats.mann_whitney(rows, ["series"], "value", F.col("first"))
    return rounded(out.select("series", "n1", "n2", "u", "p_value"), "p_value")


@query("era_summary", "ST3", sql=f"""
SELECT o_orderpriority AS series, {r6("round(avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-05-01'), 4)", 'pre_mean')},
       {r6("round(avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-05-01'), 4)", 'post_mean')},
       {r6("round(median(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-05-01'), 4)", 'pre_median')},
       {r6("round(median(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-05-01'), 4)", 'post_median')},
       {r6('''100 * (avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-05-01') - avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-05-01'))
              / avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-05-01')''', 'percent_change')}
FROM orders GROUP BY 1""")
def era_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), "o_totalprice",
                                         (F.col("o_orderdate") < F.lit("1998-05-01").cast("timestamp_ntz")).alias("first"))
    out = rounded(stats.era_summary(o, ["series"], "o_totalprice", F.col("first")),
                  "pre_mean", "post_mean", "pre_median", "post_median", digits=4)
    return rounded(out, "percent_change")


@query("text_feature_era_means", "ST3", "TX1", sql=f"""WITH {DOC_FEATURES},
long AS (
  SELECT feature, value, quality = 0 AS first
  FROM (UNPIVOT (SELECT doc_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in X.FEATURES)} FROM feat)
        ON {', '.join(X.FEATURES)} INTO NAME feature VALUE value) JOIN labels USING (doc_id)
),
m AS (SELECT feature, avg(value) FILTER (first) AS a, avg(value) FILTER (NOT first) AS b FROM long GROUP BY 1)
SELECT feature, {r6('a', 'pre_mean')}, {r6('b', 'post_mean')}, {r6('(b - a) / greatest(a, 1e-10) * 100', 'percent_change')} FROM m""")
def text_feature_era_means(spark, d):
    feats = labelled_features(spark, d)
    long = X.unpivot_features(feats, ["quality"])
    out = stats.era_summary(long, ["feature"], "value", F.col("quality") == 0, medians=False, floor=1e-10)
    return rounded(out, "pre_mean", "post_mean", "percent_change")


# ---- trends ----------------------------------------------------------------
@query("kendall_trend", "ST4", "J5", "ST11", sql=f"""WITH {SERIES},
pairs AS (SELECT a.series_id, count(*) FILTER (a.y > b.y) AS discordant, count(*) FILTER (a.y < b.y) AS concordant,
                 count(*) FILTER (a.y = b.y) AS tied, count(*) AS n0
          FROM series a JOIN series b ON a.series_id = b.series_id AND a.t < b.t GROUP BY 1),
ties AS (SELECT series_id, sum(k)::BIGINT AS n, sum(k * (k - 1.0) * (2 * k + 5)) AS vt
         FROM (SELECT series_id, y, count(*) AS k FROM series GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT *, (concordant - discordant) / sqrt((n * (n - 1.0) * (2 * n + 5) - vt) / 18) AS z FROM pairs JOIN ties USING (series_id))
SELECT series_id, n, CAST(discordant AS DOUBLE) AS discordant, {r6('(concordant - discordant) / sqrt(n0::DOUBLE * (n0 - tied))', 'tau')},
       {r6('z', 'z')}, {r6(normal_p_sql('z'), 'p_value')},
       CASE WHEN concordant > discordant THEN 'increasing' ELSE 'decreasing' END AS direction, {normal_p_sql('z')} < 0.05 AS significant
FROM z""")
def kendall_trend(spark, d):
    out = stats.kendall_trend(monthly_orders(spark, d), ["series_id"], "t", "y")
    return rounded(out, "tau", "z", "p_value")


_HOURLY = """
h AS (SELECT event_type, date_trunc('hour', ts) AS hour, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS y FROM events GROUP BY 1, 2),
e AS (SELECT event_type, y, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS t FROM h)"""


@query("hourly_value_trend", "ST4", "J5", sql=f"""WITH {_HOURLY}
SELECT a.event_type, count(*) FILTER (a.y > b.y)::DOUBLE AS discordant, max(n.n) AS n,
       {r6('(count(*) FILTER (a.y < b.y) - count(*) FILTER (a.y > b.y)) / sqrt(count(*)::DOUBLE * count(*) FILTER (a.y <> b.y))', 'tau')}
FROM e a JOIN e b ON a.event_type = b.event_type AND a.t < b.t
JOIN (SELECT event_type, count(*) AS n FROM e GROUP BY 1) n ON n.event_type = a.event_type GROUP BY 1""")
def hourly_value_trend(spark, d):
    """Trend of the hourly event value: hundreds of points per series, one per calendar hour."""
    h = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("y"))
    w = Window.partitionBy("event_type").orderBy("hour")
    h = h.select("event_type", "y", (F.row_number().over(w) - 1).alias("t"))
    return rounded(stats.kendall_trend(h, ["event_type"], "t", "y").select("event_type", "discordant", "n", "tau"), "tau")


@query("dispersion_shift", "ST5", sql=f"""
WITH q AS (SELECT o_orderpriority AS series, year(o_orderdate) * 4 + quarter(o_orderdate) AS yq,
                  quantile_disc(o_totalprice, 0.75) - quantile_disc(o_totalprice, 0.25) AS iqr FROM orders GROUP BY 1, 2),
m AS (SELECT series, avg(iqr) FILTER (yq < 1998 * 4 + 2) AS a, avg(iqr) FILTER (yq >= 1998 * 4 + 2) AS b FROM q GROUP BY 1)
SELECT series, round(a, 4) + 0.0 AS iqr_pre_mean, round(b, 4) + 0.0 AS iqr_post_mean, 0::BIGINT AS n_null,
       {r6('(b - a) / greatest(a, 1e-10) * 100', 'iqr_change_percent')} FROM m""")
def dispersion_shift(spark, d):
    from eventlens.operators.ranks import exact_quantiles

    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), "o_totalprice",
                                         (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("yq"))
    q = exact_quantiles(o, ["series", "yq"], "o_totalprice", {"p25": 0.25, "p75": 0.75})
    out = stats.dispersion_shift(q, ["series"], "p25", "p75", F.col("yq") < 1998 * 4 + 2)
    return rounded(rounded(out, "iqr_pre_mean", "iqr_post_mean", digits=4), "iqr_change_percent")


# ---- breaks ----------------------------------------------------------------
_REG = """
g AS (
  SELECT s.series_id, break_t, t < break_t AS pre, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
         regr_r2(y, t) AS r2, count(*) AS n, sqrt(regr_r2(y, t) * (count(*) - 2) / (1 - regr_r2(y, t))) AS tt
  FROM series s JOIN breaks b USING (series_id) GROUP BY 1, 2, 3
)"""


def _side(c: str, pre: bool, name: str, digits: bool = True) -> str:
    expr = f"max(CASE WHEN {'' if pre else 'NOT '}pre THEN {c} END)"
    return r6(expr, name) if digits else f"{expr} AS {name}"


@query("segmented_regression", "ST6", "ST11", sql=f"""WITH {SERIES}, {BREAKS}, {_REG},
p AS (SELECT *, {student_p_sql('tt', '(n - 2)')} AS p FROM g)
SELECT series_id, break_t,
  {', '.join(_side(c, pre, f'{nm}_{c}', c != 'n') for pre, nm in ((True, 'pre'), (False, 'post')) for c in ('slope', 'intercept', 'r2', 'p', 'n'))},
  {r6("max(CASE WHEN NOT pre THEN slope END) / max(CASE WHEN pre THEN slope END)", 'slope_change_ratio')}
FROM p GROUP BY 1, 2""")
def segmented_regression(spark, d):
    s = monthly_orders(spark, d)
    out = stats.segmented_regression(s, third_breaks(s), ["series_id"])
    cols = [f"{a}_{b}" for a in ("pre", "post") for b in ("slope", "intercept", "r2", "p")] + ["slope_change_ratio"]
    return rounded(out, *cols)


@query("welch_t_test", "ST7", "ST11", sql=f"""WITH {SERIES}, {BREAKS},
g AS (SELECT s.series_id, break_t, avg(y) FILTER (t < break_t) AS a, avg(y) FILTER (t >= break_t) AS b,
             count(*) FILTER (t < break_t) AS n_pre, count(*) FILTER (t >= break_t) AS n_post,
             var_samp(y) FILTER (t < break_t) / count(*) FILTER (t < break_t) AS v1,
             var_samp(y) FILTER (t >= break_t) / count(*) FILTER (t >= break_t) AS v2
      FROM series s JOIN breaks USING (series_id) GROUP BY 1, 2),
w AS (SELECT *, (a - b) / sqrt(v1 + v2) AS tt, pow(v1 + v2, 2) / (v1 * v1 / (n_pre - 1) + v2 * v2 / (n_post - 1)) AS nu FROM g)
SELECT series_id, break_t, {r6('a', 'pre_mean')}, {r6('b', 'post_mean')}, n_pre, n_post, {r6('(b - a) / a * 100', 'percent_change')},
       {r6('tt', 't_statistic')}, {r6('nu', 'dof')}, {r6(student_p_sql('tt', 'nu'), 'p_value')},
       {student_p_sql('tt', 'nu')} < 0.05 AS significant_at_005 FROM w""")
def welch_t_test(spark, d):
    s = monthly_orders(spark, d)
    out = stats.welch_t(s, third_breaks(s), ["series_id"])
    return rounded(out, "pre_mean", "post_mean", "percent_change", "t_statistic", "dof", "p_value")


@query("best_single_split", "ST9", sql=f"""WITH {SERIES},
c AS (SELECT a.series_id, a.t,
             var_pop(b.y) FILTER (b.t < a.t) * count(*) FILTER (b.t < a.t) + var_pop(b.y) FILTER (b.t >= a.t) * count(*) FILTER (b.t >= a.t) AS cost,
             count(*) FILTER (b.t < a.t) AS n1, count(*) FILTER (b.t >= a.t) AS n2
      FROM series a JOIN series b USING (series_id) GROUP BY 1, 2)
SELECT series_id, arg_min(t, cost) AS break_t, {r6('min(cost)', 'cost')} FROM c WHERE n1 >= 3 AND n2 >= 3 GROUP BY 1""")
def best_single_split(spark, d):
    s = monthly_orders(spark, d)
    out = stats.best_split(s, ["series_id"])
    return rounded(out.select("series_id", F.col("break_t").cast("bigint").alias("break_t"), "cost"), "cost")


@query("annotated_breaks", "ST10", "SC18", "SC16", sql=f"""WITH {SERIES}, {BREAKS},
a AS (SELECT series_id, break_t, date, month, abs(date_diff('day', DATE '1997-03-01', date)) <= 90 AS near_reference
      FROM breaks JOIN series USING (series_id) WHERE t = break_t)
SELECT series_id, break_t, date, month, near_reference,
       min(CASE WHEN near_reference THEN month END) OVER (PARTITION BY series_id) AS nearest FROM a""")
def annotated_breaks(spark, d):
    s = monthly_orders(spark, d)
    return stats.annotate_breaks(third_breaks(s), s, ["series_id"], "1997-03-01")


# Exact segmentation in SQL: all block sums by window sums, then the recursion
# over end points with the best costs so far carried as a list.
_SEGMENT_SQL = f"""WITH RECURSIVE {SERIES},
d2 AS (SELECT x.series_id, x.t AS i, z.t AS j, pow(x.y - z.y, 2) AS d FROM series x JOIN series z ON x.series_id = z.series_id AND x.t < z.t),
g AS (SELECT series_id, CASE WHEN median(d) = 0 THEN 1.0 ELSE 1.0 / median(d) END AS gamma FROM d2 GROUP BY 1),
w AS (
  SELECT series_id, i AS a, j, 2 * sum(exp(-least(greatest(d * gamma, 1e-2), 1e2))) OVER (PARTITION BY series_id, j ORDER BY i DESC) + 1 AS w
  FROM d2 JOIN g USING (series_id)
  UNION ALL SELECT series_id, t, t, 1.0 FROM series
),
blocks AS (SELECT series_id, a, j + 1 AS b, sum(w) OVER (PARTITION BY series_id, a ORDER BY j) AS s FROM w),
c AS (SELECT series_id, b, list((b - a) - s / (b - a) ORDER BY a) AS cost FROM blocks WHERE b - a >= 3 GROUP BY 1, 2),
n AS (SELECT series_id, count(*) AS n FROM series GROUP BY 1),
f(series_id, b, n, best, prev) AS (
  SELECT series_id, 0::BIGINT, n, [0.0::DOUBLE], [0::BIGINT] FROM n
  UNION ALL
  SELECT series_id, b + 1, n,
         list_append(best, CASE WHEN b + 1 < 3 THEN 'infinity'::DOUBLE ELSE list_min(cand) END),
         list_append(prev, CASE WHEN b + 1 < 3 THEN 0 ELSE list_position(cand, list_min(cand)) - 1 END)
  FROM (SELECT f.*, list_transform(range(0, f.b - 1), lambda a: best[a + 1] + cost[a + 1] + 1.0) AS cand
        FROM f LEFT JOIN c ON c.series_id = f.series_id AND c.b = f.b + 1 WHERE f.b < f.n)
),
back(series_id, pos, prev) AS (
  SELECT series_id, prev[n + 1], prev FROM f WHERE b = n
  UNION ALL SELECT series_id, prev[pos + 1], prev FROM back WHERE pos > 0
)"""


@query("kernel_changepoints", "ST8", sql=f"""{_SEGMENT_SQL}
SELECT series_id, pos AS break_t FROM back WHERE pos > 0""")
def kernel_changepoints(spark, d):
    return changepoint.changepoints(monthly_orders(spark, d), ["series_id"], penalty=1.0)


@query("kernel_break_labels", "ST8", "ST10", "SC18", sql=f"""{_SEGMENT_SQL},
a AS (SELECT s.series_id, pos AS break_t, date, month, abs(date_diff('day', DATE '1997-03-01', date)) <= 90 AS near_reference
      FROM back JOIN series s ON s.series_id = back.series_id AND s.t = pos WHERE pos > 0)
SELECT *, min(CASE WHEN near_reference THEN month END) OVER (PARTITION BY series_id) AS nearest FROM a""")
def kernel_break_labels(spark, d):
    s = materialise(monthly_orders(spark, d))
    b = changepoint.changepoints(s, ["series_id"], penalty=1.0)
    return stats.annotate_breaks(b, s, ["series_id"], "1997-03-01")


_BREAK_SQL = f"""{_SEGMENT_SQL},
breaks AS (SELECT series_id, pos AS break_t FROM back WHERE pos > 0),
label AS (SELECT series_id, break_t, date, month, abs(date_diff('day', DATE '1997-03-01', date)) <= 90 AS near_reference
          FROM breaks JOIN series USING (series_id) WHERE t = break_t),
nearest AS (SELECT *, min(CASE WHEN near_reference THEN month END) OVER (PARTITION BY series_id) AS nearest FROM label),
{_REG.replace("g AS (", "sides AS (").strip()},
sided AS (SELECT *, CASE WHEN n = 2 THEN CASE WHEN slope = 0 THEN 1.0 ELSE 0.0 END ELSE {student_p_sql('tt', '(n - 2)')} END AS p FROM sides),
lines AS (SELECT series_id, break_t,
  {', '.join(_side(c, pre, f'{nm}_{c}', c != 'n') for pre, nm in ((True, 'pre'), (False, 'post')) for c in ('slope', 'intercept', 'r2', 'p', 'n'))},
  {r6("max(CASE WHEN NOT pre THEN slope END) / max(CASE WHEN pre THEN slope END)", 'slope_change_ratio')} FROM sided GROUP BY 1, 2),
level AS (SELECT s.series_id, break_t, avg(y) FILTER (t < break_t) AS a, avg(y) FILTER (t >= break_t) AS b,
             count(*) FILTER (t < break_t) AS n_pre, count(*) FILTER (t >= break_t) AS n_post,
             var_samp(y) FILTER (t < break_t) / count(*) FILTER (t < break_t) AS v1,
             var_samp(y) FILTER (t >= break_t) / count(*) FILTER (t >= break_t) AS v2
      FROM series s JOIN breaks USING (series_id) GROUP BY 1, 2),
tested AS (SELECT *, (a - b) / sqrt(v1 + v2) AS tt, pow(v1 + v2, 2) / (v1 * v1 / (n_pre - 1) + v2 * v2 / (n_post - 1)) AS nu FROM level),
levels AS (SELECT series_id, break_t, {r6('a', 'pre_mean')}, {r6('b', 'post_mean')}, n_pre AS n_before, n_post AS n_after, {r6('(b - a) / a * 100', 'percent_change')},
       {r6('tt', 't_statistic')}, {r6('nu', 'dof')}, {r6(student_p_sql('tt', 'nu'), 'p_value')},
       {student_p_sql('tt', 'nu')} < 0.05 AS significant_at_005 FROM tested)"""


@query("break_report", "ST10", "ST6", "ST7", "ST8", sql=f"""{_BREAK_SQL}
SELECT * FROM nearest JOIN lines USING (series_id, break_t) JOIN levels USING (series_id, break_t)""")
def break_report(spark, d):
    """Every detected break of every series with its regression and level test."""
    # the series and its breaks feed three operators: compute each once
    s = materialise(monthly_orders(spark, d))
    b = materialise(changepoint.changepoints(s, ["series_id"], penalty=1.0))
    keys = ["series_id", "break_t"]
    out = stats.annotate_breaks(b, s, ["series_id"], "1997-03-01")
    level = stats.welch_t(s, b, ["series_id"]).withColumnsRenamed({"n_pre": "n_before", "n_post": "n_after"})
    out = out.join(stats.segmented_regression(s, b, ["series_id"]), keys).join(level, keys)
    line = [f"{a}_{c}" for a in ("pre", "post") for c in ("slope", "intercept", "r2", "p")]
    return rounded(out, *line, "slope_change_ratio", "pre_mean", "post_mean", "percent_change", "t_statistic", "dof", "p_value")
