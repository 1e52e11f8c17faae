"""Exponential, logistic and Gompertz growth for many series and fit windows in one job.

Spark spreads (series, configuration) groups over the cluster; a group is at
most one row per calendar month.  Inside a group a small numpy search finds the
shape parameters; amplitudes are closed-form for given shapes.  Everything
downstream of the parameters - errors, AIC, projections, comparisons - is
DataFrame arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from eventlens import config
from eventlens.session import spread_groups

MODELS = ("exponential", "logistic", "gompertz")
CONFIG = ["space", "start_month", "last_month"]
# Six fits per series: two error models by three start months.
SENSITIVITY_SPACES = ("lin", "log")


# ---- curves ----------------------------------------------------------------
def growth_curve(model: Column, t: Column, amp: Column, rate: Column, shift: Column) -> Column:
    """Value of the named model at t."""
    z = -rate * (t - shift)
    return (
        F.when(model == "exponential", amp * F.exp(rate * t))
        .when(model == "logistic", amp / (1 + F.exp(z)))
        .when(model == "gompertz", amp * F.exp(-F.exp(z)))
    )


def _log_curve(model: str, t, rate, shift):
    z = np.clip(-rate * (t - shift), -700.0, 700.0)
    return -np.logaddexp(0.0, z) if model == "logistic" else -np.exp(z)


# ---- parameter search ------------------------------------------------------
def _profile(log_g, y, weight, space, bounds):
    """Best amplitude (as a logarithm) and residual sum for every row of log curve shapes."""
    lo, hi = np.log(bounds[0]), np.log(bounds[1])
    if space == "log":
        ly = np.log(y)
        amp = np.clip(((ly - log_g) * weight).sum(-1) / weight.sum(), lo, hi)
        fitted = np.maximum(amp[:, None] + log_g, np.log(config.LOG_FLOOR))
        return amp, (weight * (ly - fitted) ** 2).sum(-1)
    top = log_g.max(-1, keepdims=True)
    g = np.exp(log_g - top)
    amp = np.clip(np.log(np.maximum((g * y).sum(-1) / (g * g).sum(-1), 1e-300)) - top[:, 0], lo, hi)
    return amp, ((y - np.exp(amp[:, None] + log_g)) ** 2).sum(-1)


def _fit_exponential(t, y, weight, space):
    if space == "log":  # a straight line in log y
        ly, sw = np.log(y), weight.sum()
        tm, lm = (weight * t).sum() / sw, (weight * ly).sum() / sw
        rates = np.clip(np.array([(weight * (t - tm) * (ly - lm)).sum() / (weight * (t - tm) ** 2).sum()]), *config.EXP_RATE)
        amp, _ = _profile(rates[:, None] * t, y, weight, space, config.EXP_AMP)
        return np.exp(amp[0]), rates[0], 0.0
    lo, hi = config.EXP_RATE
    center, width = (lo + hi) / 2, (hi - lo) / 2
    steps = np.linspace(-1.0, 1.0, 2001)
    for _ in range(40):
        rates = np.clip(center + width * steps, lo, hi)
        amp, rss = _profile(rates[:, None] * t, y, weight, space, config.EXP_AMP)
        i = int(np.argmin(rss))
        center, width, steps = rates[i], width * (0.01 if len(steps) > 100 else 0.5), np.linspace(-1.0, 1.0, 41)
    return np.exp(amp[i]), rates[i], 0.0


def _fit_sigmoid(model, t, y, weight, space):
    """Search over (log rate, anchor) with anchor = rate * (t_last - shift).

    Anchoring at the last point decouples the two when the ceiling runs away,
    where a search over (rate, shift) stalls on a ridge.
    """
    bounds = (config.CURVE_AMP_MIN_FACTOR * y.max(), config.CURVE_AMP_MAX)
    k_lo, k_hi = np.log(config.CURVE_RATE[0]), np.log(config.CURVE_RATE[1])
    center = np.array([(k_lo + k_hi) / 2, -2.0])
    width = np.array([(k_hi - k_lo) / 2, 10.0])
    shape, best = (61, 121), None
    for _ in range(32):
        lk = np.clip(center[0] + width[0] * np.linspace(-1, 1, shape[0]), k_lo, k_hi)
        anchor = center[1] + width[1] * np.linspace(-1, 1, shape[1])
        lk, anchor = (a.ravel() for a in np.meshgrid(lk, anchor, indexing="ij"))
        rate = np.exp(lk)
        shift = np.clip(t[-1] - anchor / rate, *config.CURVE_SHIFT)
        amp, rss = _profile(_log_curve(model, t, rate[:, None], shift[:, None]), y, weight, space, bounds)
        i = int(np.argmin(rss))
        if best is None or rss[i] <= best[0]:
            best = (rss[i], np.exp(amp[i]), rate[i], shift[i])
            center = np.array([lk[i], rate[i] * (t[-1] - shift[i])])
        width = width * (0.1 if shape[0] > 21 else 0.6)
        shape = (21, 21)
    return best[1:]


def _fit_group(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("t")
    t, y, sigma = (pdf[c].to_numpy(float) for c in ("t", "y", "sigma"))
    space = pdf["space"].iloc[0]
    weight = 1.0 / sigma**2
    out = []
    for model in MODELS:
        if len(t) < (2 if model == "exponential" else 3) or (space == "log" and not (y > 0).all()) or not (y > 0).any():
            out.append((model, np.nan, np.nan, np.nan, "too few points, or values without a logarithm"))
        elif model == "exponential":
            with np.errstate(over="ignore"):  # curves far from the data may overflow and lose
                out.append((model, *_fit_exponential(t, y, weight, space), None))
        else:
            with np.errstate(over="ignore"):
                out.append((model, *_fit_sigmoid(model, t, y, weight, space), None))
    return out


def fit_points(series: DataFrame, configs: list[tuple[str, str, str | None]]) -> DataFrame:
    """Every series point once per configuration whose window holds it; partial months are left out."""
    options = F.array(*[F.struct(F.lit(s).alias("space"), F.lit(a).alias("start_month"),
                                 F.lit(b).cast("string").alias("last_month")) for s, a, b in configs])
    rows = series.where(~F.col("partial") & F.col("y").isNotNull()).select(
        "series_id", "month", F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"),
        F.col("sigma").cast("double").alias("sigma"), F.explode(options).alias("c")).select("*", "c.*").drop("c")
    return rows.where((F.col("month") >= F.col("start_month"))
                      & (F.col("last_month").isNull() | (F.col("month") <= F.col("last_month"))))


def fit_parameters(points: DataFrame) -> DataFrame:
    """series_id, configuration, model, amp, rate, shift, error."""
    keys = ["series_id", *CONFIG]
    schema = points.select(*keys).schema
    for name, kind in (("model", StringType()), ("amp", DoubleType()), ("rate", DoubleType()),
                       ("shift", DoubleType()), ("error", StringType())):
        schema = StructType([*schema.fields, StructField(name, kind)])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(_fit_group(pdf), columns=["model", "amp", "rate", "shift", "error"])
        for k in reversed(keys):
            rows.insert(0, k, pdf[k].iloc[0])
        return rows

    return spread_groups(points, keys).groupBy(*keys).applyInPandas(solve, schema).withColumns(
        {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in ("amp", "rate", "shift")})


# ---- quality ---------------------------------------------------------------
def _same(a: str, b: str, cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def fit_quality(points: DataFrame, params: DataFrame) -> DataFrame:
    """AIC, R-squared and derived values of each parameter row over its own points."""
    keys = ["series_id", *CONFIG]
    p, q = points.alias("p"), params.alias("q")
    rows = p.join(q, _same("p", "q", keys)).select("q.*", "p.t", "p.y", "p.sigma")
    log = F.col("space") == "log"
    f = growth_curve(F.col("model"), F.col("t"), F.col("amp"), F.col("rate"), F.col("shift"))
    target = F.when(log, F.log("y")).otherwise(F.col("y"))
    fitted = F.when(log, F.log(F.greatest(f, F.lit(config.LOG_FLOOR)))).otherwise(f)
    w = F.when(log, 1 / (F.col("sigma") * F.col("sigma"))).otherwise(1.0)
    rows = rows.withColumns({"_y": target, "_e": target - fitted, "_w": w})
    by = [*keys, "model", "amp", "rate", "shift"] + (["error"] if "error" in params.columns else [])
    mean = F.avg("_y").over(Window.partitionBy(*keys, "model"))
    rows = rows.withColumn("_d", F.col("_y") - mean)
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("_w") * F.col("_e") * F.col("_e")).alias("rss"),
        F.sum(F.col("_w") * F.col("_d") * F.col("_d")).alias("_tss"))
    exp = F.col("model") == "exponential"
    k = F.when(exp, 2).otherwise(3)
    return g.withColumns({
        "aic": F.col("n") * F.log(F.col("rss") / F.col("n")) + 2 * k,
        "r2": 1 - F.try_divide(F.col("rss"), F.col("_tss")),
        "doubling_months": F.when(exp, F.try_divide(F.log(F.lit(2.0)), F.col("rate"))),
        "ceiling": F.when(~exp, F.col("amp")),
        "inflection_t": F.when(~exp, F.col("shift")),
        "runaway": F.when(exp, F.lit(False)).otherwise(F.col("amp") >= config.RUNAWAY_AT),
    }).drop("_tss")


def fit_growth(series: DataFrame, configs: list[tuple[str, str, str | None]]) -> DataFrame:
    """All models for all series and configurations, with parameters and quality."""
    points = fit_points(series, configs)
    return fit_quality(points, fit_parameters(points))


def best_model(fits: DataFrame) -> DataFrame:
    """Model with the least AIC per series and configuration; failed and runaway fits do not count."""
    usable = F.col("aic").isNotNull() & ~F.isnan("aic") & ~F.col("runaway")
    return fits.groupBy("series_id", *CONFIG).agg(
        F.min_by("model", F.when(usable, F.struct("aic", "model"))).alias("best_by_aic"),
        F.max("n").alias("n"))


# ---- uses ------------------------------------------------------------------
def _rounded(v: Column) -> Column:
    """Half-even whole number; null where it does not fit a long."""
    return F.bround(v).try_cast("bigint")


def project(fits: DataFrame, series: DataFrame, n_months: int = config.PROJECT_MONTHS) -> DataFrame:
    """Fitted curve on the whole time axis and ``n_months`` further months."""
    end = series.groupBy("series_id").agg(F.max("t").alias("_last"), F.max("month").alias("_last_month"))
    axis = end.select("series_id", "_last", "_last_month", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last") + n_months)).alias("t"))
    ahead = F.add_months(F.to_date(F.concat("_last_month", F.lit("-01"))), (F.col("t") - F.col("_last")).cast("int"))
    axis = axis.join(series.select("series_id", "t", "month", "y"), ["series_id", "t"], "left").select(
        "series_id", "t", F.coalesce("month", F.date_format(ahead, "yyyy-MM")).alias("month"), "y",
        (F.col("t") > F.col("_last")).alias("projected"))
    f = growth_curve(F.col("model"), F.col("t").cast("double"), F.col("amp"), F.col("rate"), F.col("shift"))
    return fits.select("series_id", *CONFIG, "model", "amp", "rate", "shift").join(axis, "series_id").select(
        "series_id", *CONFIG, "model", "t", "month", "y", "projected", _rounded(f).alias("fitted"))


def hindcast(series: DataFrame, last_month: str, start_month: str, space: str = "lin") -> DataFrame:
    """What a fit through ``last_month`` predicts for the complete months after it."""
    fits = fit_growth(series, [(space, start_month, last_month)])
    later = series.where((F.col("month") > last_month) & ~F.col("partial")).select("series_id", "month", "t", "y")
    f = growth_curve(F.col("model"), F.col("t").cast("double"), F.col("amp"), F.col("rate"), F.col("shift"))
    return fits.join(later, "series_id").select(
        "series_id", "model", "runaway", "month", "t", F.col("y").alias("observed"), _rounded(f).alias("predicted"))


def sensitivity_configs(starts: list[str], spaces=SENSITIVITY_SPACES) -> list[tuple]:
    return [(s, a, None) for s in spaces for a in starts]


def sensitivity(series: DataFrame, starts: list[str], spaces=SENSITIVITY_SPACES) -> tuple[DataFrame, DataFrame]:
    """(one row per series and configuration, one summary row per series)."""
    fits = fit_growth(series, sensitivity_configs(starts, spaces))
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    ceiling = lambda m: F.bround(F.max(F.when((F.col("model") == m) & ~F.col("runaway"), F.col("ceiling")))).cast("bigint")
    usable = F.col("aic").isNotNull() & ~F.col("runaway")
    table = fits.groupBy("series_id", "space", F.col("start_month").alias("start")).agg(
        F.max("n").alias("n"),
        F.min_by("model", F.when(usable, F.struct("aic", "model"))).alias("best"),
        *[F.bround(of(m, "aic"), 1).alias(f"{m}_aic") for m in MODELS],
        F.bround(of("exponential", "doubling_months"), 2).alias("exp_doubling"),
        *[ceiling(m).alias(f"{m}_ceiling") for m in MODELS[1:]],
        *[F.bround(of(m, "inflection_t"), 1).alias(f"{m}_t0") for m in MODELS[1:]],
    )
    lowest = F.least("logistic_ceiling", "gompertz_ceiling")
    highest = F.greatest("logistic_ceiling", "gompertz_ceiling")
    summary = table.groupBy("series_id").agg(
        F.count_if(F.col("best").isin("logistic", "gompertz")).alias("sigmoid_wins"), F.count("*").alias("configs"),
        F.min(lowest).alias("ceiling_min"), F.max(highest).alias("ceiling_max"))
    return table, summary


def headline(counts: DataFrame, fits: DataFrame, past: DataFrame, projection: DataFrame, past_projection: DataFrame,
             totals: DataFrame) -> DataFrame:
    """Counts joined with doubling times then and now, ceilings, the inflection month, what the past exponential
    fit says of the last full month, and the share of the total then, per series.

    counts: ``series.headline_counts``; fits and past: one configuration each;
    projection and past_projection: of ``fits`` and ``past``; totals: month, total.
    An inflection past the axis has no month; a month without a total no share.
    """
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    now = fits.groupBy("series_id").agg(
        F.bround(of("exponential", "doubling_months"), 2).alias("doubling_now"),
        F.bround(of("logistic", "ceiling")).cast("bigint").alias("logistic_ceiling"),
        F.bround(of("gompertz", "ceiling")).cast("bigint").alias("gompertz_ceiling"),
        F.bround(of("logistic", "inflection_t")).cast("bigint").alias("_t0"))
    then = past.groupBy("series_id").agg(F.bround(of("exponential", "doubling_months"), 2).alias("doubling_then"))
    labels = projection.where(F.col("model") == "logistic").select("series_id", F.col("t").alias("_t0"),
                                                                   F.col("month").alias("inflection_month"))
    said = past_projection.where(F.col("model") == "exponential").select(
        "series_id", F.col("t").alias("last_full_t"), F.col("fitted").alias("past_prediction"))
    whole = totals.select(F.col("month").alias("last_full_month"), F.col("total").alias("_total"))
    out = (
        counts.join(now, "series_id", "left").join(then, "series_id", "left").join(labels, ["series_id", "_t0"], "left")
        .join(said, ["series_id", "last_full_t"], "left").join(whole, "last_full_month", "left")
        .withColumn("share_last_pct", F.bround(F.try_divide(F.col("last_value") * 100.0, F.col("_total")), 1)).drop("_total")
    )
    pct = lambda c: F.bround(F.try_divide(F.col("last_value"), F.col(c)) * 100).cast("bigint")
    return out.withColumns({"logistic_pct": pct("logistic_ceiling"), "gompertz_pct": pct("gompertz_ceiling")}).drop("_t0")


def fit_records(fits: DataFrame, projection: DataFrame) -> DataFrame:
    """One nested row per fit: parameters as a struct and the fitted curve as an array (a point per month)."""
    keys = ["series_id", *CONFIG, "model"]
    curve = projection.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("t", "fitted"))), lambda p: p["fitted"]).alias("fitted"))
    cols = ["aic", "r2", "n", "doubling_months", "ceiling", "inflection_t", "runaway"]
    return fits.alias("p").join(curve.alias("q"), _same("p", "q", keys)).select(
        *[f"p.{k}" for k in keys], F.struct("p.amp", "p.rate", "p.shift").alias("params"), *[f"p.{c}" for c in cols], "q.fitted")
