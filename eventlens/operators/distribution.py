"""Velocity, push-size, language and message-length distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions.regex import re2_match
from eventlens.functions.rules import threshold_class
from eventlens.operators.attribution import distinct_count, year_month
from eventlens.operators.ranking import top1_per_key
from eventlens.operators.ranks import histogram, small_domain_quantiles
from eventlens.sources.archive import explode_commits, push_size, pushes


def year_quarter(ts: str = "created_at") -> list[Column]:
    return [F.year(ts).alias("year"), F.quarter(ts).alias("quarter")]


def velocity(archive: DataFrame, approx: bool = False) -> DataFrame:
    """Pushes, pushers and pushes per pusher by month."""
    return (
        pushes(archive).groupBy(*year_month())
        .agg(F.count("*").alias("total_pushes"), distinct_count("login", approx).alias("unique_pushers"))
        .withColumn("pushes_per_dev", F.try_divide("total_pushes", "unique_pushers"))
        .orderBy("year", "month")
    )


def velocity_by_team_size(archive: DataFrame) -> DataFrame:
    """Monthly pushes by team-size class of the repository in that month.

    Three shrinking aggregations: (month, repo, login) counts first, so a hot
    repository reaches any task only as its distinct logins.  A repository is one
    row per month by then, so the outer distinct count is a plain count.
    """
    per_login = pushes(archive).groupBy(*year_month(), "repo_name", "login").agg(F.count("*").alias("c"))
    per_repo = per_login.groupBy("year", "month", "repo_name").agg(
        F.sum("c").alias("repo_pushes"), F.count("*").alias("repo_unique_pushers"))
    classed = per_repo.withColumn(
        "repo_class", threshold_class(F.col("repo_unique_pushers"), config.TEAM_CLASSES, config.TEAM_DEFAULT))
    return (
        classed.groupBy("year", "month", "repo_class")
        .agg(F.sum("repo_pushes").alias("total_pushes"), F.count("*").alias("repo_count"))
        .withColumn("pushes_per_repo", F.try_divide("total_pushes", "repo_count"))
        .orderBy("year", "month", "repo_class")
    )


def _weighted_mean(value: str) -> Column:
    """In doubles: whole numbers are exact up to 2^53, and no size, however large, overflows."""
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    return F.try_divide(F.sum(F.col(value).cast("double") * F.col("n")), F.sum(known))


def _with_deviations(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``_squares``: the squared deviation of each value from the mean of its group, times its count."""
    w = Window.partitionBy(*keys)
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    mean = F.try_divide(F.sum(F.col(value).cast("double") * F.col("n")).over(w), F.sum(known).over(w))
    return hist.withColumn("_squares", F.pow(F.col(value).cast("double") - mean, F.lit(2.0)) * F.col("n"))


def _weighted_stddev(value: str) -> Column:
    """Sample standard deviation of a histogram with deviations."""
    n = F.sum(F.when(F.col(value).isNotNull(), F.col("n")))
    return F.when(n > 1, F.sqrt(F.sum("_squares") / (n - 1)))


def sized_pushes(archive: DataFrame) -> DataFrame:
    return pushes(archive).select(*year_quarter(), "repo_name", push_size().alias("size"))


SIZE_PROBS = {"p25_commits_per_push": 0.25, "median_commits_per_push": 0.5,
              "p75_commits_per_push": 0.75, "p95_commits_per_push": 0.95}


def size_distribution(archive: DataFrame, approx: bool = False) -> DataFrame:
    """Push-size summary per quarter.

    Exact by default: the one wide shuffle carries a histogram of
    (quarter, size).  ``approx`` uses the mergeable quantile sketch instead.
    """
    rows = sized_pushes(archive)
    keys = ["year", "quarter"]
    if approx:
        out = rows.groupBy(*keys).agg(
            F.count("*").alias("total_push_events"), F.avg("size").alias("avg_commits_per_push"),
            F.percentile_approx("size", list(SIZE_PROBS.values()), 100_000).alias("_q"),
            F.stddev_samp("size").alias("stddev_commits_per_push"))
        for i, name in enumerate(SIZE_PROBS):
            out = out.withColumn(name, F.col("_q")[i])
        return out.drop("_q").orderBy(*keys)
    return small_domain_quantiles(
        _with_deviations(histogram(rows, keys, "size"), keys, "size"), keys, "size", SIZE_PROBS,
        F.sum("n").alias("total_push_events"),
        _weighted_mean("size").alias("avg_commits_per_push"),
        _weighted_stddev("size").alias("stddev_commits_per_push"),
    ).orderBy(*keys)


def dominant_category(nested: DataFrame, key: str, array: str, allowed=None) -> DataFrame:
    """Category with the most weight per key, from an array of (name, bytes)."""
    rows = nested.select(key, F.explode(array).alias("e")).select(
        key, F.col("e.name").alias("category"), F.col("e.bytes").alias("bytes"))
    if allowed is not None:
        rows = rows.where(F.col("category").isin(list(allowed)))
    return top1_per_key(rows, [key], [F.desc("bytes"), F.asc("category")])


def size_by_category(archive: DataFrame, languages: DataFrame, allowed=tuple(config.TARGET_LANGUAGES)) -> DataFrame:
    """Push size per quarter and dominant language.

    Pushes collapse to (quarter, repo, size) counts before the join, so a hot
    repository joins as a handful of rows.
    """
    repo_lang = dominant_category(languages, "repo_name", "language", allowed).select(
        "repo_name", F.col("category").alias("language"))
    hist = histogram(sized_pushes(archive), ["year", "quarter", "repo_name"], "size")
    by_lang = hist.join(repo_lang, "repo_name").groupBy("year", "quarter", "language", "size").agg(F.sum("n").alias("n"))
    keys = ["year", "quarter", "language"]
    return small_domain_quantiles(
        by_lang, keys, "size", {"median_commits_per_push": 0.5},
        F.sum("n").alias("total_pushes"), _weighted_mean("size").alias("avg_commits_per_push"),
    ).orderBy(*keys)


def is_conventional(col: str = "message") -> Column:
    """Case-sensitive conventional-commit prefix."""
    return re2_match(F.col(col), config.CONVENTIONAL)


def message_stats(archive: DataFrame) -> DataFrame:
    """Message-length summary and conventional-commit share per quarter."""
    commits = explode_commits(pushes(archive), ("message",), keep=["created_at"]).select(
        *year_quarter(), F.char_length("message").cast("bigint").alias("length"), is_conventional().alias("conv"))
    keys = ["year", "quarter"]
    hist = histogram(commits, keys, "length", n_conv=F.col("conv"))
    return (
        small_domain_quantiles(
            hist, keys, "length", {"median_message_length": 0.5},
            F.sum("n").alias("total_commits"), _weighted_mean("length").alias("avg_message_length"),
            F.sum("n_conv").alias("conventional_commit_count"))
        .withColumn("conventional_commit_ratio", F.try_divide("conventional_commit_count", "total_commits"))
        .orderBy(*keys)
    )


def mentions_any(col: str = "message") -> Column:
    return re2_match(F.lower(F.col(col)), config.MODEL_MENTIONS)


def mention_counts(archive: DataFrame, approx: bool = False) -> DataFrame:
    """Commits that mention a model library, and the repositories they are in, per quarter."""
    return (
        explode_commits(pushes(archive), ("message",), keep=["created_at", "repo_name"])
        .where(mentions_any())
        .groupBy(*year_quarter())
        .agg(distinct_count("repo_name", approx).alias("distinct_repos"), F.count("*").alias("total_mentions"))
        .orderBy("year", "quarter")
    )


def annual_rollup(monthly: DataFrame) -> DataFrame:
    """Calendar-year totals and means of a monthly velocity table."""
    return monthly.groupBy("year").agg(
        F.sum("total_pushes").alias("total_pushes"),
        F.avg("unique_pushers").alias("avg_unique_pushers"),
        F.avg("pushes_per_dev").alias("avg_pushes_per_dev"),
    )


def tag_era(col: Column, cut: str = config.ERA_CUT) -> Column:
    return F.when(col < F.lit(cut).cast("date"), "pre").otherwise("post")
