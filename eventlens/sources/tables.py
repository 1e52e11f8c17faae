"""Flat inputs: aggregate CSVs, message samples, the observation log, and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.ranking import latest_per_key
from eventlens.sources.records import read_quoted_csv

MONTHLY_SCHEMA = "year INT, month INT, total_pushes BIGINT, unique_pushers BIGINT, pushes_per_dev DOUBLE"
QUARTERLY_SCHEMA = (
    "year INT, quarter INT, total_push_events BIGINT, avg_commits_per_push DOUBLE, p25_commits_per_push DOUBLE, "
    "median_commits_per_push DOUBLE, p75_commits_per_push DOUBLE, p95_commits_per_push DOUBLE, stddev_commits_per_push DOUBLE"
)
MESSAGE_SCHEMA = (
    "created_at TIMESTAMP, developer STRING, repo_name STRING, commit_sha STRING, commit_message STRING, "
    "author_name STRING, author_email STRING"
)
OBSERVATION_SCHEMA = (
    "ts TIMESTAMP, tool STRING, q STRING, date_field STRING, start DATE, `end` DATE, draw INT, "
    "total_count BIGINT, incomplete_results BOOLEAN, http_status INT, elapsed_s DOUBLE"
)
OBSERVATION_KEY = ["tool", "q", "start", "end", "draw"]


def month_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.make_date("year", "month", F.lit(1)))


def quarter_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.make_date("year", (F.col("quarter") - 1) * 3 + 1, F.lit(1)))


def read_monthly_csv(spark: SparkSession, path: str, schema: str = MONTHLY_SCHEMA) -> DataFrame:
    """A (year, month) aggregate with its first-of-month date, in date order."""
    return month_date(spark.read.schema(schema).csv(path, header=True)).orderBy("date")


def read_quarterly_csv(spark: SparkSession, path: str, schema: str = QUARTERLY_SCHEMA) -> DataFrame:
    return quarter_date(spark.read.schema(schema).csv(path, header=True)).orderBy("date")


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGE_SCHEMA, era: str | None = None) -> DataFrame:
    """Message samples with quoted newlines, each file in many splits; a null message becomes the empty string."""
    df = read_quoted_csv(spark, path, schema)
    df = df.withColumn("commit_message", F.coalesce("commit_message", F.lit("")))
    return df.withColumn("era", F.lit(era)) if era else df


def dedupe_observations(log: DataFrame) -> DataFrame:
    """The last record of every (tool, q, start, end, draw)."""
    return latest_per_key(log, OBSERVATION_KEY, ["ts"])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log; blank lines are skipped and the last record per key wins."""
    return dedupe_observations(spark.read.schema(OBSERVATION_SCHEMA).json(path).where(F.col("tool").isNotNull()))


def check_inputs(inputs: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row per input: rows, first and last value of its time column, and rows with any null."""
    out = None
    for name, (df, ts) in inputs.items():
        any_null = F.lit(False)
        for c in df.columns:
            any_null = any_null | F.col(c).isNull()
        edge = lambda f: (f(F.col(ts)).cast("string") if ts else F.lit(None).cast("string"))
        row = df.agg(F.count("*").alias("n_rows"), edge(F.min).alias("first"), edge(F.max).alias("last"),
                     F.count_if(any_null).alias("n_null_rows")).select(
            F.lit(name).alias("input"), "n_rows", (F.col("n_rows") > 0).alias("present"), "first", "last", "n_null_rows")
        out = row if out is None else out.unionByName(row)
    return out
