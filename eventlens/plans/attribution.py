"""Attribution queries over the document archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions.rules import arm, contains_any, first_match
from eventlens.operators import attribution as A
from eventlens.plans.registry import query
from eventlens.plans.sqlbase import ORDER_PUSHES, YM, case_sql, commits_cte, needle_sql, tool_sql, DOC_LINES
from eventlens.sources.adapters import commits_of_two_sources, document_archive, nested_archive, order_archive
from eventlens.sources.archive import explode_commits, in_months, month_range, prefilter, pushes

_SINGLE = commits_cte(config.NEEDLES_SINGLE)
_ALL = commits_cte(config.NEEDLES_ALL)
_PLAIN = commits_cte()
_IS_CLAUDE = tool_sql("claude")
_TOOL = case_sql(config.TOOL_RULES)
_COUNTS = """count(*) AS commits, count(DISTINCT repo_name) AS distinct_repos,
       count(DISTINCT login) AS distinct_developers"""


@query("tool_monthly", "AG4", "PF2", "PF3", "PF7", "PF8", "SR4", "J2", "SC4", "SC5", "SC6", sql=f"""{_ALL}
SELECT * FROM (SELECT {YM}, {_TOOL} AS tool, {_COUNTS} FROM commits GROUP BY 1, 2, 3) WHERE tool IS NOT NULL""")
def tool_monthly(spark, d):
    return A.tool_monthly(document_archive(spark, d))


@query("tool_monthly_unfiltered", "AG4", "PF7", sql=f"""{_PLAIN}
SELECT * FROM (SELECT {YM}, {_TOOL} AS tool, {_COUNTS} FROM commits GROUP BY 1, 2, 3) WHERE tool IS NOT NULL""")
def tool_monthly_unfiltered(spark, d):
    return A.tool_monthly(document_archive(spark, d), use_prefilter=False)


@query("monthly_counts", "AG1", "PF5", sql=f"""{_SINGLE}
SELECT {YM}, {_COUNTS} FROM commits WHERE {_IS_CLAUDE} GROUP BY 1, 2""")
def monthly_counts(spark, d):
    return A.monthly_counts(document_archive(spark, d))


_PER_REPO = """count(*) AS commits, count(DISTINCT login) AS distinct_developers,
       min(created_at) AS first_commit, max(created_at) AS last_commit"""


@query("top_repositories", "AG2", "SR1", sql=f"""{_SINGLE}
SELECT repo_name, {_PER_REPO} FROM commits WHERE {_IS_CLAUDE}
GROUP BY 1 ORDER BY commits DESC, repo_name LIMIT 500""")
def top_repositories(spark, d):
    return A.top_entities(document_archive(spark, d))


@query("top_repositories_by_month", "W2", "AG2", sql=f"""{_SINGLE},
r AS (SELECT strftime(created_at, '%Y-%m') AS month, repo_name, {_PER_REPO}
      FROM commits WHERE {_IS_CLAUDE} GROUP BY 1, 2)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY month ORDER BY commits DESC, repo_name) <= 500""".replace(
    ")\n,\nr AS", "),\nr AS"))
def top_repositories_by_month(spark, d):
    return A.top_entities_by_month(document_archive(spark, d))


@query("variant_breakdown", "AG3", "PF6", sql=f"""{_SINGLE}
SELECT {case_sql(config.VARIANT_RULES, config.VARIANT_DEFAULT)} AS attribution_type, count(*) AS commit_count,
       count(DISTINCT repo_name) AS distinct_repos
FROM commits WHERE {_IS_CLAUDE} GROUP BY 1""")
def variant_breakdown(spark, d):
    return A.variant_breakdown(document_archive(spark, d))


_SAMPLE = """created_at, login AS developer, repo_name, sha AS commit_sha, message AS commit_message,
       author_name, author_email"""


@query("latest_commit_sample", "SR2", "PF4", sql=f"""{_SINGLE}
SELECT {_SAMPLE} FROM commits WHERE {_IS_CLAUDE} ORDER BY created_at DESC, sha LIMIT 1000""")
def latest_commit_sample(spark, d):
    return A.commit_sample(document_archive(spark, d))


@query("latest_commit_sample_by_month", "W2", "SR2", "SRC2", "SO1", sql=f"""{_SINGLE}
SELECT {_SAMPLE}, strftime(created_at, '%Y-%m') AS month FROM commits WHERE {_IS_CLAUDE}
QUALIFY row_number() OVER (PARTITION BY month ORDER BY created_at DESC, sha) <= 1000""")
def latest_commit_sample_by_month(spark, d):
    return A.commit_sample(document_archive(spark, d), per_month=True)


@query("monthly_totals", "AG5", "PF1", "SC11", "SC1", sql=f"""WITH {ORDER_PUSHES}
SELECT {YM}, count(*) AS total_push_events, count(DISTINCT login) AS unique_pushers,
       count(DISTINCT repo_name) AS unique_repos
FROM order_pushes GROUP BY 1, 2""")
def monthly_totals(spark, d):
    return A.monthly_totals(order_archive(spark, d))


@query("archive_month_range", "SRC1", "PF1", sql=f"""WITH {ORDER_PUSHES}
SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM order_pushes
WHERE created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1998-12-01' GROUP BY 1""")
def archive_month_range(spark, d):
    rows = pushes(month_range(order_archive(spark, d), "1996_03", "199811"))
    return rows.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("archive_listed_months", "SRC2", "SO1", sql=f"""WITH {ORDER_PUSHES}
SELECT strftime(created_at, '%Y-%m') AS month, repo_name, count(*) AS n, count(DISTINCT login) AS developers
FROM order_pushes WHERE strftime(created_at, '%Y-%m') IN ('1995-01', '1997-06', '2001-07') GROUP BY 1, 2""")
def archive_listed_months(spark, d):
    rows = pushes(in_months(order_archive(spark, d), ["199706", "1995-01", "2001_07"]))
    return rows.groupBy("month", "repo_name").agg(
        F.count("*").alias("n"), F.countDistinct("login").alias("developers"))


# objects, arrays and other than objects in place of fields give null; an object in place of the array gives no rows
_NESTED = f"""{commits_cte(push_only=False)}
SELECT type, created_at, login, repo_name,
       CASE WHEN k % 67 <> 6 THEN CASE WHEN k % 47 = 2 THEN CAST(pos AS VARCHAR) ELSE sha END END AS sha,
       CASE WHEN k % 67 <> 6 AND k % 53 <> 3 AND k % 59 <> 4 THEN message END AS message,
       CASE WHEN k % 67 <> 6 AND k % 61 <> 5 THEN author_name END AS author_name,
       CASE WHEN k % 67 <> 6 AND k % 61 <> 5 THEN author_email END AS author_email
FROM commits WHERE doc_id % 43 <> 7"""


@query("exploded_commits", "PF3", "PF4", "SC3", "SC4", "J2", sql=_NESTED)
def exploded_commits(spark, d):
    return explode_commits(nested_archive(spark, d))


@query("payload_prefilter", "PF2", "SC2", sql=f"""WITH {DOC_LINES},
hit AS (SELECT doc_id, bool_or({needle_sql(config.NEEDLES_ALL)}) AS h_all,
               bool_or({needle_sql(config.NEEDLES_SINGLE)}) AS h_single FROM doc_commits GROUP BY 1)
SELECT repo_name, count(*) AS pushes_all, count(*) FILTER (h_single) AS pushes_single
FROM (SELECT DISTINCT doc_id, repo_name, type FROM doc_commits) JOIN hit USING (doc_id)
WHERE h_all AND type = 'PushEvent' GROUP BY 1""")
def payload_prefilter(spark, d):
    rows = prefilter(pushes(document_archive(spark, d)), config.NEEDLES_ALL)
    return rows.groupBy("repo_name").agg(
        F.count("*").alias("pushes_all"),
        F.count_if(contains_any(F.col("payload"), config.NEEDLES_SINGLE)).alias("pushes_single"))


_SEARCHED = f"""SELECT * REPLACE (CASE doc_id % 37 WHEN 0 THEN 'devin-ai-integration[bot]' WHEN 1 THEN 'google-labs-jules[bot]'
                 WHEN 2 THEN 'copilot-swe-agent[bot]' ELSE login END AS login) FROM commits"""


@query("tool_monthly_by_source", "PF7", "PF8", "AG4", sql=f"""{_PLAIN},
labelled AS (SELECT 'archive' AS source, *, {_TOOL} AS tool FROM commits
             UNION ALL SELECT 'search', *, {case_sql(config.SEARCH_RULES)} FROM ({_SEARCHED}))
SELECT {YM}, tool, count(*) FILTER (source = 'archive') AS commits_archive, count(*) FILTER (source = 'search') AS commits_search,
       count(DISTINCT repo_name) AS distinct_repos, count(DISTINCT replace(login, '[bot]', '')) AS distinct_developers
FROM labelled WHERE tool IS NOT NULL GROUP BY 1, 2, 3""".replace(")\n,\nlabelled", "),\nlabelled"))
def tool_monthly_by_source(spark, d):
    return A.tool_monthly_by_source(commits_of_two_sources(spark, d))


@query("attribution_signals", "PF5", "PF7", "PF8", "SC5", sql=f"""{_PLAIN}
SELECT {', '.join(f"count(*) FILTER ({tool_sql(t)}) AS n_{t}" for t in config.SIX_TOOLS)},
       count(*) FILTER (({_TOOL}) IS NOT NULL) AS n_any, count(*) AS n FROM commits""")
def attribution_signals(spark, d):
    commits = explode_commits(pushes(document_archive(spark, d)), ("message", "author_name", "author_email"))
    return commits.agg(
        *[F.count_if(arm(config.TOOL_RULES, t)).alias(f"n_{t}") for t in config.SIX_TOOLS],
        F.count_if(first_match(config.TOOL_RULES).isNotNull()).alias("n_any"),
        F.count("*").alias("n"))
