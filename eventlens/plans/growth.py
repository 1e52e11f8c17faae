"""Growth-model queries: fits, quality, projections, hindcast, sensitivity and headline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.operators import growth as G
from eventlens.operators import series as S
from eventlens.operators.windows import month_bounds
from eventlens.plans.distribution import r6, rounded
from eventlens.plans.registry import query
from eventlens.plans.stats import SERIES, monthly_orders
from eventlens.session import materialise

START, PAST, TODAY = "1995-02", "1998-06", "2001-08-02"


def cumulative_orders(spark, d):
    """Orders so far per market segment: a growing monthly series with an unfinished last month."""
    upto = Window.partitionBy("series_id").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = monthly_orders(spark, d).select("series_id", "month", F.col("t").cast("bigint").alias("t"), F.sum("y").over(upto).alias("y"))
    # fits, quality and projections all read the series: aggregate the orders once
    return materialise(month_bounds(s, "month", TODAY).select(
        "series_id", "month", "t", "y", "partial",
        F.when(F.col("month") < "1999-01", 0.05).otherwise(0.1).alias("sigma")))


CUMULATIVE = f"""{SERIES},
cum AS (SELECT series_id, month, t, sum(y) OVER (PARTITION BY series_id ORDER BY month)::BIGINT AS y,
               month >= '2001-08' AS partial, CASE WHEN month < '1999-01' THEN 0.05 ELSE 0.1 END AS sigma FROM series)"""

CONFIGS = [("lin", START, None), ("log", START, None), ("log", "1997-01", "2000-12")]


# ---- the search in SQL -----------------------------------------------------
_FIT_KEYS = "series_id, space, start_month, last_month"
_VALUE = """CASE model WHEN 'exponential' THEN exp(la + rate * {t}) WHEN 'logistic' THEN exp(la) / (1 + exp(-rate * ({t} - shift)))
            ELSE exp(la - exp(-rate * ({t} - shift))) END"""


def fitted_sql(configs) -> str:
    """CTEs ending in ``found``: a search of its own over curve shapes, with the amplitude that suits each best.

    One zoom step per level of the recursion, for all series, configurations and models at once.
    """
    vals = ", ".join(f"('{s}', '{a}', {repr(b) if b else 'NULL'})" for s, a, b in configs)
    seq = lambda lst, e: f"list_transform({lst}, lambda i: {e})"
    idx = "range(1, n + 1)"
    return f"""{CUMULATIVE},
cfg(space, start_month, last_month) AS (VALUES {vals}),
pts AS (SELECT series_id, space, start_month, coalesce(last_month, '') AS last_month, count(*) AS n, list(t::DOUBLE ORDER BY t) AS t, list(y::DOUBLE ORDER BY t) AS y,
          list(1.0 / (sigma * sigma)::DOUBLE ORDER BY t) AS w, max(t)::DOUBLE AS last_t, max(y)::DOUBLE AS top
        FROM cum, cfg WHERE NOT partial AND month >= start_month AND (last_month IS NULL OR month <= last_month) GROUP BY ALL),
zoom(series_id, space, start_month, last_month, model, step, c1, c2, w1, w2, n1, n2, rss, la, rate, shift) AS (
  SELECT {_FIT_KEYS}, model, 0, CASE model WHEN 'exponential' THEN 2.5::DOUBLE ELSE (ln(0.01) + ln(5)) / 2 END, -2.0::DOUBLE,
         CASE model WHEN 'exponential' THEN 2.5::DOUBLE ELSE (ln(5) - ln(0.01)) / 2 END, 10.0::DOUBLE,
         CASE model WHEN 'exponential' THEN 2001 ELSE 61 END, CASE model WHEN 'exponential' THEN 1 ELSE 121 END,
         'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  FROM pts, (VALUES ('exponential'), ('logistic'), ('gompertz')) m(model)
  UNION ALL
  SELECT {_FIT_KEYS}, model, step + 1,
         CASE WHEN model = 'exponential' THEN g.rate WHEN g.rss <= rss THEN g.lk ELSE c1 END,
         CASE WHEN g.rss <= rss THEN g.rate * (last_t - g.shift) ELSE c2 END,
         w1 * CASE WHEN model = 'exponential' THEN CASE WHEN n1 > 100 THEN 0.01 ELSE 0.5 END WHEN n1 > 21 THEN 0.1 ELSE 0.6 END,
         w2 * CASE WHEN n1 > 21 THEN 0.1 ELSE 0.6 END, CASE model WHEN 'exponential' THEN 41 ELSE 21 END, CASE model WHEN 'exponential' THEN 1 ELSE 21 END,
         CASE WHEN model = 'exponential' OR g.rss <= rss THEN g.rss ELSE rss END, CASE WHEN model = 'exponential' OR g.rss <= rss THEN g.la ELSE la END,
         CASE WHEN model = 'exponential' OR g.rss <= rss THEN g.rate ELSE rate END, CASE WHEN model = 'exponential' OR g.rss <= rss THEN g.shift ELSE shift END
  FROM (
    SELECT {_FIT_KEYS}, model, step, c1, c2, w1, w2, n1, n2, rss, la, rate, shift, last_t,
           arg_min(struct_pack(lk := lk, rate := r, shift := s, la := a, rss := e), e) AS g
    FROM (SELECT *, CASE space WHEN 'log' THEN list_sum({seq(idx, "w[i] * pow(ln(y[i]) - greatest(a + lg[i], ln(1e-9)), 2)")})
                    ELSE list_sum({seq(idx, "pow(y[i] - exp(a + lg[i]), 2)")}) END AS e
          FROM (SELECT *, least(greatest(CASE space WHEN 'log' THEN list_sum({seq(idx, "w[i] * (ln(y[i]) - lg[i])")}) / list_sum(w)
                          ELSE ln(greatest(list_sum({seq(idx, "exp(lg[i] - tl) * y[i]")}) / list_sum({seq(idx, "exp(2 * (lg[i] - tl))")}), 1e-300)) - tl END, lo), hi) AS a
                FROM (SELECT *, list_max(lg) AS tl,
                             ln(CASE model WHEN 'exponential' THEN 1e-3 ELSE 0.5 * top END) AS lo, ln(CASE model WHEN 'exponential' THEN 1e9 ELSE 1e10 END) AS hi
                      FROM (SELECT *, CASE model WHEN 'exponential' THEN {seq("t", "r * i")}
                                   WHEN 'logistic' THEN {seq("t", "-ln(1 + exp(least(greatest(-r * (i - s), -700), 700)))")}
                                   ELSE {seq("t", "-exp(least(greatest(-r * (i - s), -700), 700))")} END AS lg
                            FROM (SELECT *, CASE model WHEN 'exponential' THEN 0.0 ELSE least(greatest(last_t - an / r, 0), 60) END AS s
                                  FROM (SELECT *, CASE model WHEN 'exponential' THEN least(greatest(lk, 0), 5) ELSE exp(lk) END AS r
                                        FROM (SELECT *, CASE model WHEN 'exponential' THEN c1 + w1 * (2.0 * gi / (n1 - 1) - 1)
                                                       ELSE least(greatest(c1 + w1 * (2.0 * gi / (n1 - 1) - 1), ln(0.01)), ln(5)) END AS lk,
                                                     CASE WHEN n2 = 1 THEN 0 ELSE c2 + w2 * (2.0 * gj / (n2 - 1) - 1) END AS an
                                              FROM (SELECT *, unnest(range(n2)) AS gj FROM (SELECT z.*, p.n, p.t, p.y, p.w, p.last_t, p.top, unnest(range(n1)) AS gi
                                                    FROM zoom z JOIN pts p USING ({_FIT_KEYS}) WHERE step < CASE model WHEN 'exponential' THEN 40 ELSE 32 END)))))))))
    GROUP BY ALL)
),
found AS (SELECT * FROM zoom QUALIFY step = max(step) OVER (PARTITION BY {_FIT_KEYS}, model))"""


# quality of the curves found
_JUDGED = f"""judged AS (
  SELECT {_FIT_KEYS}, model, la, rate, shift, p.n, p.n * ln(rss / p.n) + CASE model WHEN 'exponential' THEN 4 ELSE 6 END AS aic,
         1 - rss / list_sum(list_transform(range(1, n + 1), lambda i: CASE space WHEN 'log' THEN w[i] * pow(ln(y[i]) - list_avg(list_transform(y, lambda v: ln(v))), 2)
                                            ELSE pow(y[i] - list_avg(y), 2) END)) AS r2,
         CASE WHEN model = 'exponential' THEN ln(2) / rate END AS doubling, CASE WHEN model <> 'exponential' THEN exp(la) END AS ceiling,
         CASE WHEN model <> 'exponential' THEN shift END AS inflection, model <> 'exponential' AND exp(la) >= 1e9 AS runaway
  FROM found JOIN pts p USING ({_FIT_KEYS}))"""


@query("growth_fits", "FIT1", "FIT2", "FIT3", "FIT4", "FIT5", "FIT6", sql=f"""WITH RECURSIVE {fitted_sql(CONFIGS)}, {_JUDGED}
SELECT series_id, space, start_month, nullif(last_month, '') AS last_month, model, n, round(aic, 3) + 0.0 AS aic, {r6('r2', 'r2')},
       round(doubling, 3) + 0.0 AS doubling_months, round(ceiling, 1) + 0.0 AS ceiling, round(inflection, 3) + 0.0 AS inflection_t, runaway FROM judged""")
def growth_fits(spark, d):
    out = G.fit_growth(cumulative_orders(spark, d), CONFIGS).select(
        "series_id", "space", "start_month", "last_month", "model", "n", "aic", "r2", "doubling_months", "ceiling", "inflection_t", "runaway")
    out = rounded(rounded(out, "aic", "doubling_months", "inflection_t", digits=3), "ceiling", digits=1)
    return rounded(out, "r2")


@query("log_exponential_fit", "FIT1", "FIT4", "FIT5", "FIT6", sql=f"""WITH {CUMULATIVE},
p AS (SELECT cum.*, last_month, start_month, 1.0 / (sigma * sigma)::DOUBLE AS w, ln(y) AS ly
      FROM cum, (VALUES ('{START}', NULL), ('1997-01', '2000-12')) c(start_month, last_month)
      WHERE NOT partial AND month >= start_month AND (last_month IS NULL OR month <= last_month)),
m AS (SELECT series_id, start_month, sum(w * t) / sum(w) AS tm, sum(w * ly) / sum(w) AS lm, avg(ly) AS am FROM p GROUP BY 1, 2),
b AS (SELECT series_id, start_month, any_value(tm) AS tm, any_value(lm) AS lm, any_value(am) AS am,
             least(5, greatest(0, sum(w * (t - tm) * (ly - lm)) / sum(w * (t - tm) * (t - tm)))) AS rate
      FROM p JOIN m USING (series_id, start_month) GROUP BY 1, 2),
q AS (SELECT series_id, start_month, any_value(last_month) AS last_month, any_value(rate) AS rate, any_value(lm - rate * tm) AS la, count(*) AS n,
             sum(w * pow(ly - (lm - rate * tm) - rate * t, 2)) AS rss, sum(w * pow(ly - am, 2)) AS tss
      FROM p JOIN b USING (series_id, start_month) GROUP BY 1, 2)
SELECT series_id, start_month, CAST(last_month AS VARCHAR) AS last_month, {r6('exp(la)', 'amp')}, {r6('rate', 'rate')}, n,
       {r6('n * ln(rss / n) + 4', 'aic')}, {r6('1 - rss / tss', 'r2')}, {r6('ln(2) / rate', 'doubling_months')} FROM q""")
def log_exponential_fit(spark, d):
    fits = G.fit_growth(cumulative_orders(spark, d), CONFIGS[1:]).where(F.col("model") == "exponential")
    out = fits.select("series_id", "start_month", "last_month", "amp", "rate", "n", "aic", "r2", "doubling_months")
    return rounded(out, "amp", "rate", "aic", "r2", "doubling_months")


def given_parameters(series):
    """Plausible parameters derived from each series, to evaluate curves without a search."""
    last = series.groupBy("series_id").agg(F.max("y").cast("double").alias("top"))
    option = lambda model, amp, rate, shift: F.struct(
        F.lit(model).alias("model"), amp.alias("amp"), F.lit(rate).alias("rate"), F.lit(shift).alias("shift"))
    opts = F.array(option("exponential", F.col("top") / 8, 0.03, 0.0), option("logistic", F.col("top") * 1.1, 0.07, 40.0),
                   option("gompertz", F.col("top") * 2e6, 0.0125, 293.0))
    spaces = F.array(*[F.struct(F.lit(s).alias("space"), F.lit(START).alias("start_month"),
                                F.lit(None).cast("string").alias("last_month")) for s in ("lin", "log")])
    return last.select("series_id", "top", F.explode(spaces).alias("c"), ).select(
        "series_id", "c.*", F.explode(opts).alias("o")).select("series_id", "space", "start_month", "last_month", "o.*")


_CURVE = """CASE model WHEN 'exponential' THEN amp * exp(rate * t) WHEN 'logistic' THEN amp / (1 + exp(-rate * (t - shift)))
            ELSE amp * exp(-exp(-rate * (t - shift))) END"""
_GIVEN = f"""{CUMULATIVE},
top AS (SELECT series_id, max(y)::DOUBLE AS top, max(t) AS last_t, max(month) AS last_month FROM cum GROUP BY 1),
given AS (
  SELECT series_id, space, model, top * f AS amp, rate, shift, last_t, last_month
  FROM top, (VALUES ('lin'), ('log')) s(space),
       (VALUES ('exponential', 0.125::DOUBLE, 0.03::DOUBLE, 0.0::DOUBLE), ('logistic', 1.1, 0.07, 40.0), ('gompertz', 2e6, 0.0125, 293.0)) m(model, f, rate, shift)
),
ev AS (
  SELECT g.*, t, CASE space WHEN 'log' THEN ln(y) ELSE y END AS yy, CASE space WHEN 'log' THEN 1.0::DOUBLE / (sigma * sigma) ELSE 1 END AS w,
         CASE space WHEN 'log' THEN ln(greatest({_CURVE}, 1e-9)) ELSE {_CURVE} END AS f
  FROM given g JOIN cum c ON c.series_id = g.series_id WHERE NOT c.partial AND c.month >= '{START}'
),
mean AS (SELECT series_id, space, model, avg(yy) AS ym FROM ev GROUP BY 1, 2, 3),
qual AS (
  SELECT series_id, space, model, any_value(amp) AS amp, any_value(rate) AS rate, any_value(shift) AS shift, count(*) AS n,
         sum(w * pow(yy - f, 2)) AS rss, sum(w * pow(yy - ym, 2)) AS tss
  FROM ev JOIN mean USING (series_id, space, model) GROUP BY 1, 2, 3
),
quality AS (SELECT *, n * ln(rss / n) + CASE model WHEN 'exponential' THEN 4 ELSE 6 END AS aic,
                   model <> 'exponential' AND amp >= 1e9 AS runaway FROM qual)"""


@query("growth_curve_quality", "FIT1", "FIT2", "FIT3", "FIT5", "FIT6", sql=f"""WITH {_GIVEN}
SELECT series_id, space, model, n, {r6('aic', 'aic')}, {r6('1 - rss / tss', 'r2')}, runaway,
       {r6("CASE WHEN model = 'exponential' THEN ln(2) / rate END", 'doubling_months')},
       {r6("CASE WHEN model <> 'exponential' THEN amp END", 'ceiling')}, CASE WHEN model <> 'exponential' THEN shift END AS inflection_t
FROM quality""")
def growth_curve_quality(spark, d):
    s = cumulative_orders(spark, d)
    points = G.fit_points(s, [("lin", START, None), ("log", START, None)])
    out = G.fit_quality(points, given_parameters(s)).select("series_id", "space", "model", "n", "aic", "r2", "runaway",
                                               "doubling_months", "ceiling", "inflection_t")
    return rounded(out, "aic", "r2", "doubling_months", "ceiling")


@query("best_growth_model", "FIT7", sql=f"""WITH {_GIVEN}
SELECT series_id, space, arg_min(model, aic) FILTER (NOT runaway) AS best_by_aic, max(n) AS n FROM quality GROUP BY 1, 2""")
def best_growth_model(spark, d):
    s = cumulative_orders(spark, d)
    points = G.fit_points(s, [("lin", START, None), ("log", START, None)])
    return G.best_model(G.fit_quality(points, given_parameters(s))).select("series_id", "space", "best_by_aic", "n")


@query("growth_projection", "FIT8", "SC17", "SC16", "PF15", sql=f"""WITH {_GIVEN},
axis AS (SELECT series_id, space, model, amp, rate, shift, last_t, last_month, unnest(generate_series(0, last_t + 12)) AS t FROM given)
SELECT a.series_id, space, model, a.t, c.y, a.t > last_t AS projected,
       coalesce(c.month, strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(a.t - last_t AS INTEGER)), '%Y-%m')) AS month,
       CAST(round_even({_CURVE.replace('* t)', '* a.t)').replace('(t -', '(a.t -')}, 0) AS BIGINT) AS fitted
FROM axis a LEFT JOIN cum c ON c.series_id = a.series_id AND c.t = a.t""")
def growth_projection(spark, d):
    s = cumulative_orders(spark, d)
    out = G.project(given_parameters(s), s)
    return out.drop("start_month", "last_month")


@query("growth_hindcast", "FIT9", sql=f"""WITH RECURSIVE {fitted_sql([("lin", START, PAST)])}, {_JUDGED}
SELECT j.series_id, model, runaway, c.month, c.t, c.y AS observed, CAST(round_even({_VALUE.format(t='c.t')}, 0) AS BIGINT) AS predicted
FROM judged j JOIN cum c ON c.series_id = j.series_id WHERE c.month > '{PAST}' AND NOT c.partial""")
def growth_hindcast(spark, d):
    return G.hindcast(cumulative_orders(spark, d), PAST, START)


_STARTS = [START, "1996-06", "1998-11"]


_OF = lambda model, c: f"max(CASE WHEN model = '{model}' THEN {c} END)"
_SENSITIVITY = f"""{fitted_sql(G.sensitivity_configs(_STARTS))}, {_JUDGED},
tried AS (
  SELECT series_id, space, start_month AS start, max(n) AS n, arg_min(model, aic) FILTER (NOT runaway) AS best,
         {', '.join(f"round_even({_OF(m, 'aic')}, 1) + 0.0 AS {m}_aic" for m in G.MODELS)}, round_even({_OF('exponential', 'doubling')}, 2) + 0.0 AS exp_doubling,
         {', '.join(f"CAST(round_even({_OF(m, 'CASE WHEN NOT runaway THEN ceiling END')}, 0) AS BIGINT) AS {m}_ceiling" for m in G.MODELS[1:])},
         {', '.join(f"round_even({_OF(m, 'inflection')}, 1) + 0.0 AS {m}_t0" for m in G.MODELS[1:])}
  FROM judged GROUP BY 1, 2, 3)"""


def _plus_zero(df):
    """Negative zeros of rounding become zero, as in the SQL."""
    return df.withColumns({c: F.col(c) + 0.0 for c, kind in df.dtypes if kind == "double"})


@query("growth_sensitivity", "FIT10", sql=f"WITH RECURSIVE {_SENSITIVITY} SELECT * FROM tried")
def growth_sensitivity(spark, d):
    return _plus_zero(G.sensitivity(cumulative_orders(spark, d), _STARTS)[0])


@query("growth_sensitivity_summary", "FIT10", sql=f"""WITH RECURSIVE {_SENSITIVITY}
SELECT series_id, count(*) FILTER (best IN ('logistic', 'gompertz')) AS sigmoid_wins, count(*) AS configs,
       min(least(logistic_ceiling, gompertz_ceiling)) AS ceiling_min, max(greatest(logistic_ceiling, gompertz_ceiling)) AS ceiling_max FROM tried GROUP BY 1""")
def growth_sensitivity_summary(spark, d):
    return G.sensitivity(cumulative_orders(spark, d), _STARTS)[1]


_COUNTS = """g AS (SELECT *, (y / lag(y) OVER (PARTITION BY series_id ORDER BY month)::DOUBLE - 1) * 100 AS mom FROM cum),
h AS (SELECT series_id, max(month) FILTER (NOT partial) AS last_full_month, max(t) FILTER (NOT partial) AS last_full_t,
             arg_max(y, month) FILTER (NOT partial) AS last_value,
             CAST(round_even(arg_max(mom, month) FILTER (NOT partial), 0) AS BIGINT) AS mom_pct,
             CAST(round_even(arg_max(y, month) FILTER (NOT partial) / arg_min(y, month)::DOUBLE, 0) AS BIGINT) AS growth_multiple,
             sum(y)::BIGINT AS cumulative FROM g GROUP BY 1)"""


@query("growth_headline", "FIT11", "FIT12", "AG18", sql=f"""WITH RECURSIVE {fitted_sql([("lin", START, None), ("lin", START, PAST)])}, {_JUDGED}, {_COUNTS},
f AS (SELECT series_id, round_even({_OF('exponential', "CASE WHEN last_month = '' THEN doubling END")}, 2) + 0.0 AS doubling_now,
             round_even({_OF('exponential', "CASE WHEN last_month <> '' THEN doubling END")}, 2) + 0.0 AS doubling_then,
             {', '.join(f"CAST(round_even({_OF(m, "CASE WHEN last_month = '' THEN ceiling END")}, 0) AS BIGINT) AS {m}_ceiling" for m in G.MODELS[1:])},
             CAST(round_even({_OF('logistic', "CASE WHEN last_month = '' THEN inflection END")}, 0) AS BIGINT) AS t0,
             {_OF('exponential', "CASE WHEN last_month <> '' THEN la END")} AS la, {_OF('exponential', "CASE WHEN last_month <> '' THEN rate END")} AS rate
      FROM judged GROUP BY 1),
m AS (SELECT series_id, month, t FROM cum UNION ALL SELECT series_id, strftime(CAST(max(month) || '-01' AS DATE) + to_months(i::INTEGER), '%Y-%m'), max(t) + i
      FROM cum, range(1, 13) r(i) GROUP BY series_id, i)
SELECT h.*, doubling_now, doubling_then, logistic_ceiling, gompertz_ceiling, m.month AS inflection_month,
       CAST(round_even(last_value / logistic_ceiling::DOUBLE * 100, 0) AS BIGINT) AS logistic_pct,
       CAST(round_even(last_value / gompertz_ceiling::DOUBLE * 100, 0) AS BIGINT) AS gompertz_pct,
       CAST(round_even(exp(la + rate * last_full_t), 0) AS BIGINT) AS past_prediction,
       round_even(last_value * 100.0::DOUBLE / (SELECT sum(y) FROM cum c WHERE c.month = h.last_full_month), 1) + 0.0 AS share_last_pct
FROM h JOIN f USING (series_id) LEFT JOIN m ON m.series_id = h.series_id AND m.t = t0""")
def growth_headline(spark, d):
    s = cumulative_orders(spark, d)
    now = G.fit_growth(s, [("lin", START, None)])
    then = G.fit_growth(s, [("lin", START, PAST)])
    return _plus_zero(G.headline(S.headline_counts(s, ["series_id"]), now, then, G.project(now, s), G.project(then, s), _totals(s)))


def _totals(s):
    return s.groupBy("month").agg(F.sum("y").alias("total"))


# ---- checks of the uses, with parameters that SQL can derive ---------------
def _log_line(start: str, last: str | None) -> str:
    """CTEs ending in ``q``: weighted least-squares line through log y per series."""
    cond = f"NOT partial AND month >= '{start}'" + (f" AND month <= '{last}'" if last else "")
    return f"""{CUMULATIVE},
p AS (SELECT *, 1.0 / (sigma * sigma)::DOUBLE AS w, ln(y) AS ly FROM cum WHERE {cond}),
m AS (SELECT series_id, sum(w * t) / sum(w) AS tm, sum(w * ly) / sum(w) AS lm FROM p GROUP BY 1),
b AS (SELECT series_id, any_value(tm) AS tm, any_value(lm) AS lm, count(*) AS n,
             sum(w * (t - tm) * (ly - lm)) / sum(w * (t - tm) * (t - tm)) AS rate FROM p JOIN m USING (series_id) GROUP BY 1),
q AS (SELECT b.series_id, any_value(rate) AS rate, any_value(lm - rate * tm) AS la, any_value(n) AS n,
             sum(w * pow(ly - (lm - rate * tm) - rate * t, 2)) AS rss FROM p JOIN b USING (series_id) GROUP BY 1)"""


@query("log_growth_hindcast", "FIT9", sql=f"""WITH {_log_line(START, PAST)}
SELECT series_id, month, t, y AS observed, CAST(round_even(exp(la + rate * t), 0) AS BIGINT) AS predicted
FROM cum JOIN q USING (series_id) WHERE month > '{PAST}' AND NOT partial""")
def log_growth_hindcast(spark, d):
    out = G.hindcast(cumulative_orders(spark, d), PAST, START, space="log").where(F.col("model") == "exponential")
    return out.select("series_id", "month", "t", "observed", "predicted")


@query("log_exponential_sensitivity", "FIT10", sql="\nUNION ALL\n".join(
    f"""SELECT * FROM (WITH {_log_line(a, None)}
SELECT series_id, '{a}' AS start, n, round_even(n * ln(rss / n) + 4, 1) + 0.0 AS exponential_aic,
       round_even(ln(2) / rate, 2) + 0.0 AS exp_doubling FROM q)""" for a in _STARTS))
def log_exponential_sensitivity(spark, d):
    out = G.sensitivity(cumulative_orders(spark, d), _STARTS, spaces=("log",))[0]
    return out.select("series_id", "start", "n", (F.col("exponential_aic") + 0.0).alias("exponential_aic"),
                      (F.col("exp_doubling") + 0.0).alias("exp_doubling"))


@query("headline_of_given_curves", "FIT11", "FIT12", sql=f"""WITH {_GIVEN},
g AS (SELECT *, (y / lag(y) OVER (PARTITION BY series_id ORDER BY month)::DOUBLE - 1) * 100 AS mom FROM cum),
h AS (SELECT series_id, max(month) FILTER (NOT partial) AS last_full_month, max(t) FILTER (NOT partial) AS last_full_t,
             arg_max(y, month) FILTER (NOT partial) AS last_value,
             CAST(round_even(arg_max(mom, month) FILTER (NOT partial), 0) AS BIGINT) AS mom_pct,
             CAST(round_even(arg_max(y, month) FILTER (NOT partial) / arg_min(y, month)::DOUBLE, 0) AS BIGINT) AS growth_multiple,
             sum(y)::BIGINT AS cumulative FROM g GROUP BY 1),
f AS (SELECT series_id, max(CASE WHEN model = 'logistic' THEN CAST(round_even(amp, 0) AS BIGINT) END) AS logistic_ceiling,
             max(CASE WHEN model = 'gompertz' THEN CAST(round_even(amp, 0) AS BIGINT) END) AS gompertz_ceiling FROM given GROUP BY 1)
SELECT h.*, round_even(ln(2) / 0.03, 2) AS doubling_now, round_even(ln(2) / 0.03, 2) AS doubling_then, logistic_ceiling, gompertz_ceiling,
       (SELECT month FROM cum c WHERE c.series_id = h.series_id AND t = 40) AS inflection_month,
       CAST(round_even(last_value / logistic_ceiling::DOUBLE * 100, 0) AS BIGINT) AS logistic_pct,
       CAST(round_even(last_value / gompertz_ceiling::DOUBLE * 100, 0) AS BIGINT) AS gompertz_pct,
       (SELECT CAST(round_even(amp * exp(rate * h.last_full_t), 0) AS BIGINT) FROM given x
        WHERE x.series_id = h.series_id AND space = 'lin' AND model = 'exponential') AS past_prediction,
       round_even(last_value * 100.0::DOUBLE / (SELECT sum(y) FROM cum c WHERE c.month = h.last_full_month), 1) + 0.0 AS share_last_pct
FROM h JOIN f USING (series_id)""")
def headline_of_given_curves(spark, d):
    s = cumulative_orders(spark, d)
    params = given_parameters(s).where("space = 'lin'")
    fits = G.fit_quality(G.fit_points(s, [("lin", START, None)]), params)
    curves = G.project(params, s)
    return G.headline(S.headline_counts(s, ["series_id"]), fits, fits, curves, curves, _totals(s))
