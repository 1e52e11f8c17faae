"""Velocity, size, language and message-length queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import config
from eventlens.operators import distribution as D
from eventlens.operators.ranking import sample_rows, top_k
from eventlens.operators.ranks import exact_quantiles
from eventlens.plans.registry import query
from eventlens.plans.sqlbase import (
    ORDER_PUSHES, REPO_LANGUAGES, SIZED_PUSHES, YM, YQ, commits_cte, lit,
)
from eventlens.sources.adapters import document_archive, order_archive, repo_languages, table
from eventlens.sources.archive import explode_commits, pushes

_COMMITS = commits_cte()
_CONV = f"regexp_matches(message, {lit(config.CONVENTIONAL)})"
_MENTION = f"regexp_matches(lower(message), {lit(config.MODEL_MENTIONS)})"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def rounded(df, *cols, digits=6):
    """Rounds doubles so that engines agree; the library itself returns full precision."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@query("velocity", "AG6", "SC8", "SR4", sql=f"""WITH {ORDER_PUSHES}
SELECT {YM}, count(*) AS total_pushes, count(DISTINCT login) AS unique_pushers,
       {r6("count(*) / count(DISTINCT login)::DOUBLE", "pushes_per_dev")}
FROM order_pushes GROUP BY 1, 2""")
def velocity(spark, d):
    return rounded(D.velocity(order_archive(spark, d)), "pushes_per_dev")


@query("velocity_by_team_size", "AG7", "PF9", "SC14", sql=f"""WITH {ORDER_PUSHES},
r AS (SELECT {YM}, repo_name, count(*) AS c, count(DISTINCT login) AS u FROM order_pushes GROUP BY 1, 2, 3)
SELECT year, month, CASE WHEN u <= 2 THEN 'solo_or_pair' WHEN u <= 10 THEN 'small_team' ELSE 'large_org' END AS repo_class,
       sum(c)::BIGINT AS total_pushes, count(DISTINCT repo_name) AS repo_count,
       {r6("sum(c) / count(DISTINCT repo_name)::DOUBLE", "pushes_per_repo")}
FROM r GROUP BY 1, 2, 3""")
def velocity_by_team_size(spark, d):
    return rounded(D.velocity_by_team_size(order_archive(spark, d)), "pushes_per_repo")


_SIZES = f"""count(*) AS total_push_events, {r6("avg(size)", "avg_commits_per_push")},
       quantile_disc(size, 0.25) AS p25_commits_per_push, quantile_disc(size, 0.5) AS median_commits_per_push,
       quantile_disc(size, 0.75) AS p75_commits_per_push, quantile_disc(size, 0.95) AS p95_commits_per_push,
       {r6("stddev_samp(size)", "stddev_commits_per_push")}"""


@query("size_distribution", "AG8", "SC7", "SC10", "SC11", "SC1", sql=f"""WITH {SIZED_PUSHES}
SELECT {YQ}, {_SIZES} FROM sized GROUP BY 1, 2""")
def size_distribution(spark, d):
    return rounded(D.size_distribution(order_archive(spark, d, with_size=True)),
                   "avg_commits_per_push", "stddev_commits_per_push")


@query("size_distribution_sketch", "AG8", "SC10", sql=f"""WITH {SIZED_PUSHES}
SELECT {YQ}, {_SIZES} FROM sized GROUP BY 1, 2""")
def size_distribution_sketch(spark, d):
    return rounded(D.size_distribution(order_archive(spark, d, with_size=True), approx=True),
                   "avg_commits_per_push", "stddev_commits_per_push")


@query("order_value_quantiles", "SC10", "AG8", sql=f"""
SELECT o_orderpriority AS series, quantile_disc(o_totalprice, 0.25) AS p25, quantile_disc(o_totalprice, 0.5) AS p50,
       quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1""")
def order_value_quantiles(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), "o_totalprice")
    return exact_quantiles(o, ["series"], "o_totalprice", {"p25": 0.25, "p50": 0.5, "p95": 0.95})


_DOMINANT = f"""{REPO_LANGUAGES},
dominant AS (SELECT repo_name, language, bytes FROM repo_language WHERE language IN ({', '.join(map(lit, config.TARGET_LANGUAGES))})
             QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY bytes DESC, language) = 1)"""


@query("dominant_language", "W1", "PF14", sql=f"""WITH {_DOMINANT}
SELECT repo_name, language AS category, bytes FROM dominant""")
def dominant_language(spark, d):
    return D.dominant_category(repo_languages(spark, d), "repo_name", "language", config.TARGET_LANGUAGES)


@query("size_by_language", "AG9", "J1", "W1", "PF14", sql=f"""WITH {SIZED_PUSHES}, {_DOMINANT}
SELECT {YQ}, language, count(*) AS total_pushes, {r6("avg(size)", "avg_commits_per_push")},
       quantile_disc(size, 0.5) AS median_commits_per_push
FROM sized JOIN dominant USING (repo_name) GROUP BY 1, 2, 3""")
def size_by_language(spark, d):
    return rounded(D.size_by_category(order_archive(spark, d, with_size=True), repo_languages(spark, d)),
                   "avg_commits_per_push")


@query("message_stats", "AG10", "PF10", "SC9", "SC12", "SC8", sql=f"""{_COMMITS}
SELECT {YQ}, count(*) AS total_commits, {r6("avg(length(message))", "avg_message_length")},
       quantile_disc(length(message), 0.5) AS median_message_length,
       count(*) FILTER ({_CONV}) AS conventional_commit_count,
       {r6(f"count(*) FILTER ({_CONV}) / count(*)::DOUBLE", "conventional_commit_ratio")}
FROM commits GROUP BY 1, 2""")
def message_stats(spark, d):
    return rounded(D.message_stats(document_archive(spark, d)), "avg_message_length", "conventional_commit_ratio")


@query("mention_counts", "AG11", "PF11", "SC12", sql=f"""{_COMMITS}
SELECT {YQ}, count(DISTINCT repo_name) AS distinct_repos, count(*) AS total_mentions
FROM commits WHERE {_MENTION} GROUP BY 1, 2""")
def mention_counts(spark, d):
    return D.mention_counts(document_archive(spark, d))


@query("message_flags", "PF10", "PF11", "SEM-11", sql=f"""{_COMMITS}
SELECT sha, {_CONV} AS conventional, {_MENTION} AS mentions FROM commits""")
def message_flags(spark, d):
    commits = explode_commits(pushes(document_archive(spark, d)), ("sha", "message"), keep=[])
    return commits.select("sha", D.is_conventional().alias("conventional"), D.mentions_any().alias("mentions"))


def _hash_sql(key: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


@query("hash_sample_by_era", "PF12", "SC13", "SR3", "PF13", sql=f"""{_COMMITS}
SELECT * FROM (SELECT created_at, login, repo_name, message, sha, 'pre' AS era FROM commits
  WHERE created_at < TIMESTAMP '2025-10-01' AND {_hash_sql('sha')} < 214748364 ORDER BY {_hash_sql('sha')}, sha LIMIT 500000)
UNION ALL
SELECT * FROM (SELECT created_at, login, repo_name, message, sha, 'post' AS era FROM commits
  WHERE created_at >= TIMESTAMP '2025-10-01' AND {_hash_sql('sha')} < 214748364 ORDER BY {_hash_sql('sha')}, sha LIMIT 500000)""")
def hash_sample_by_era(spark, d):
    from eventlens.sources.archive import month_range

    archive = pushes(document_archive(spark, d))
    sample = lambda first, last, era: sample_rows(
        explode_commits(month_range(archive, first, last), ("message", "sha")), ["sha"], 0.05, 500_000, era
    ).drop("type")
    return sample("2025-01", "2025-09", "pre").unionByName(sample("2025-10", "2030-12", "post"))


@query("capped_hash_sample", "PF12", "SR3", sql=f"""{_COMMITS}
SELECT sha, message FROM commits WHERE {_hash_sql('sha')} < 2147483648 ORDER BY {_hash_sql('sha')}, sha LIMIT 1500""")
def capped_hash_sample(spark, d):
    """A cap that bites: the 1,500 rows of least hash."""
    rows = explode_commits(pushes(document_archive(spark, d)), ("sha", "message")).select("sha", "message")
    return sample_rows(rows, ["sha"], 0.5, 1500)


@query("annual_rollup", "AG12", sql=f"""WITH {ORDER_PUSHES},
m AS (SELECT {YM}, count(*) AS p, count(DISTINCT login) AS u FROM order_pushes GROUP BY 1, 2)
SELECT year, sum(p)::BIGINT AS total_pushes, {r6("avg(u)", "avg_unique_pushers")},
       {r6("avg(p / u::DOUBLE)", "avg_pushes_per_dev")} FROM m GROUP BY 1""")
def annual_rollup(spark, d):
    return rounded(D.annual_rollup(D.velocity(order_archive(spark, d))), "avg_unique_pushers", "avg_pushes_per_dev")


@query("era_split", "PF13", "SC15", sql="""
SELECT CASE WHEN make_date(year(o_orderdate), quarter(o_orderdate) * 3 - 2, 1) < DATE '1998-05-01' THEN 'pre' ELSE 'post' END AS era,
       count(*) AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1""")
def era_split(spark, d):
    o = table(spark, d, "orders")
    day = F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3 - 2, F.lit(1))
    return o.groupBy(D.tag_era(day, "1998-05-01").alias("era")).agg(
        F.count("*").alias("n"), F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts"))


@query("largest_orders", "SR1", "SR4", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def largest_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return top_k(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)
