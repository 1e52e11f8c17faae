"""Counts of attributed commits: per month, repository, variant and tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import config
from eventlens.functions.rules import account_identity, any_signal, arm, first_match, first_match_by_source, rule_table, with_signals
from eventlens.operators.ranking import top_k, topn_per_group
from eventlens.sources.archive import explode_commits, prefilter, pushes


def year_month(ts: str = "created_at") -> list[Column]:
    return [F.year(ts).alias("year"), F.month(ts).alias("month")]


def distinct_count(col: str, approx: bool = False) -> Column:
    return F.approx_count_distinct(col) if approx else F.countDistinct(col)


def attributed_commits(archive: DataFrame, tool: str = "claude", needles=None, use_prefilter: bool = True,
                       fields=("message", "author_email")) -> DataFrame:
    """Commits that carry any signal of one tool."""
    rows = prefilter(pushes(archive), needles or config.NEEDLES_SINGLE, use_prefilter)
    return explode_commits(rows, fields).where(arm(config.TOOL_RULES, tool))


def labelled_commits(archive: DataFrame, use_prefilter: bool = True) -> DataFrame:
    """Commits of every tool with their label; unlabelled commits are dropped.

    The label comes out of a generator: the filter on it can't be moved below
    the projection, so each regular expression runs at most once per commit.
    """
    rows = prefilter(pushes(archive), config.NEEDLES_ALL, use_prefilter)
    commits = explode_commits(rows, ("message", "author_name", "author_email"),
                              keep=["created_at", "login", "repo_name"])
    return commits.select("created_at", "login", "repo_name", F.explode(F.array(first_match(config.TOOL_RULES))).alias("tool")).where(
        F.col("tool").isNotNull())


def identity_counts(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Rows per key, repository and developer: additive, and all that distinct counts need."""
    return rows.groupBy(*keys, "repo_name", "login").agg(F.count("*").alias("commits"))


def count_identities(rows: DataFrame, keys: list[Column], names: list[str], count: str, repos: str, developers: str, approx: bool) -> DataFrame:
    """Rows, distinct repositories and distinct developers per key.

    Distinct counts of two columns copy every row, so rows collapse to one per identity first.
    """
    per = identity_counts(rows, keys)
    return per.groupBy(*names).agg(
        F.sum("commits").alias(count), distinct_count("repo_name", approx).alias(repos), distinct_count("login", approx).alias(developers))


def monthly_counts(archive: DataFrame, approx: bool = False, **kw) -> DataFrame:
    return count_identities(attributed_commits(archive, **kw), year_month(), ["year", "month"],
                            "commits", "distinct_repos", "distinct_developers", approx)


def top_entities(archive: DataFrame, k: int = 500, **kw) -> DataFrame:
    """The busiest repositories over the scanned range."""
    return top_k(_per_repo(attributed_commits(archive, **kw), ["repo_name"]),
                 [F.desc("commits"), F.asc("repo_name")], k)


def top_entities_by_month(archive: DataFrame, k: int = 500, **kw) -> DataFrame:
    """The busiest repositories of every month, in one job."""
    commits = attributed_commits(archive, **kw).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return topn_per_group(_per_repo(commits, ["month", "repo_name"]), ["month"],
                          [F.desc("commits"), F.asc("repo_name")], k)


def _per_repo(commits: DataFrame, keys) -> DataFrame:
    return commits.groupBy(*keys).agg(
        F.count("*").alias("commits"),
        F.countDistinct("login").alias("distinct_developers"),
        F.min("created_at").alias("first_commit"),
        F.max("created_at").alias("last_commit"),
    )


def variant_breakdown(archive: DataFrame, needles=None, use_prefilter: bool = True) -> DataFrame:
    """Attributed commits by the variant that they name; each signal is evaluated once per commit."""
    rows = prefilter(pushes(archive), needles or config.NEEDLES_SINGLE, use_prefilter)
    claude = dict(config.TOOL_RULES)["claude"]
    commits, known = with_signals(explode_commits(rows, ("message", "author_email"), keep=["repo_name"]), claude)
    return (
        commits.where(any_signal(claude, known))
        .select("repo_name", first_match(config.VARIANT_RULES, config.VARIANT_DEFAULT, known).alias("attribution_type"))
        .groupBy("attribution_type")
        .agg(F.count("*").alias("commit_count"), F.countDistinct("repo_name").alias("distinct_repos"))
        .orderBy(F.desc("commit_count"), "attribution_type")
    )


def tool_monthly_by_source(commits: DataFrame, rules_of: dict[str, list] | None = None) -> DataFrame:
    """Commits of several sources (column ``source``) per month and tool: how many each source sees, and whom.

    ``commits`` has source, created_at, login, repo_name, message, author_name, author_email.  Every source is held
    against its own rules; developers are counted by identity, so an account that two sources write differently is one.
    """
    rules_of = rules_of or config.SOURCE_RULES
    tool = F.explode(F.array(first_match_by_source(rule_table(rules_of)))).alias("tool")
    rows = commits.select("source", "created_at", account_identity(F.col("login")).alias("login"), "repo_name", tool).where("tool IS NOT NULL")
    per = rows.groupBy(*year_month(), "tool", "repo_name", "login").agg(
        *[F.count_if(F.col("source") == s).alias(f"commits_{s}") for s in rules_of])
    return per.groupBy("year", "month", "tool").agg(
        *[F.sum(f"commits_{s}").alias(f"commits_{s}") for s in rules_of],
        F.countDistinct("repo_name").alias("distinct_repos"), F.countDistinct("login").alias("distinct_developers"))


def commit_sample(archive: DataFrame, k: int = 1000, per_month: bool = False, **kw) -> DataFrame:
    """The latest attributed commits with full metadata."""
    rows = attributed_commits(archive, fields=("sha", "message", "author_name", "author_email"), **kw).select(
        "created_at", F.col("login").alias("developer"), "repo_name", F.col("sha").alias("commit_sha"),
        F.col("message").alias("commit_message"), "author_name", "author_email",
    )
    order = [F.desc("created_at"), F.asc("commit_sha")]
    if per_month:
        rows = rows.withColumn("month", F.date_format("created_at", "yyyy-MM"))
        return topn_per_group(rows, ["month"], order, k)
    return top_k(rows, order, k)


def tool_monthly(archive: DataFrame, approx: bool = False, use_prefilter: bool = True) -> DataFrame:
    """All tools in one scan: commits, distinct repositories and developers per month and tool."""
    return count_identities(labelled_commits(archive, use_prefilter), [*year_month(), "tool"], ["year", "month", "tool"],
                            "commits", "distinct_repos", "distinct_developers", approx).orderBy("year", "month", F.desc("commits"), "tool")


def monthly_totals(archive: DataFrame, approx: bool = False) -> DataFrame:
    """Denominators; the payload column is never read."""
    return count_identities(pushes(archive), year_month(), ["year", "month"],
                            "total_push_events", "unique_repos", "unique_pushers", approx).orderBy("year", "month")
