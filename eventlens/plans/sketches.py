"""Rollups of stored sketches, held against the exact numbers within their stated error."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventlens.operators import attribution as A
from eventlens.operators import distribution as D
from eventlens.operators import sketches as K
from eventlens.plans.attribution import _ALL, _TOOL
from eventlens.plans.registry import query
from eventlens.plans.sqlbase import SIZED_PUSHES, YQ
from eventlens.session import scratch_path
from eventlens.sources.adapters import document_archive, document_pushes, order_archive, table
from eventlens.sources.archive import push_size, pushes
from eventlens.streaming import incremental as I

#: Standard errors that an estimate may be off.
SIGMAS = 4
#: Batches of the streamed pushes, and the files that they have at least.
STREAM_BATCHES = 2
LEAST_FILES = 4


def _near(estimate: str, exact: str, lg_k: int = K.LG_K):
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), SIGMAS * K.distinct_error(lg_k) * F.col(exact))


@query("tool_quarterly_sketch", "AG1", "AG4", "STR2", sql=f"""{_ALL}
SELECT * FROM (
  SELECT {YQ}, {_TOOL} AS tool, count(*) AS commits, count(DISTINCT repo_name) AS exact_repos, count(DISTINCT login) AS exact_developers,
         true AS repos_near, true AS developers_near
  FROM commits GROUP BY 1, 2, 3) WHERE tool IS NOT NULL""")
def tool_quarterly_sketch(spark, d):
    """Months' stored sketches rolled up to quarters, beside exact counts."""
    path = scratch_path(spark, "tool-sketches")
    I.count_sketches(document_archive(spark, d)).write.parquet(path)
    quarter = F.ceil(F.col("month") / 3).cast("int").alias("quarter")
    got = I.sketched_counts(spark.read.parquet(path).select("*", quarter), ["year", "quarter", "tool"])
    exact = A.labelled_commits(document_archive(spark, d)).groupBy(*D.year_quarter(), "tool").agg(
        F.countDistinct("repo_name").alias("exact_repos"), F.countDistinct("login").alias("exact_developers"))
    return got.join(exact, ["year", "quarter", "tool"]).select(
        "year", "quarter", "tool", "commits", "exact_repos", "exact_developers",
        _near("distinct_repos", "exact_repos").alias("repos_near"), _near("distinct_developers", "exact_developers").alias("developers_near"))


def _write_push_files(docs, path: str) -> int:
    """Write the pushes of documents in as many files as Spark reads parts of the table, so that a file doesn't grow with it; how many.

    Rows are dealt out in turn: a large repository, or a part that holds most rows, makes no large file.
    """
    files = max(LEAST_FILES, docs.rdd.getNumPartitions())
    document_pushes(docs.repartition(files)).write.parquet(path)
    return files


@query("streamed_tool_sketches", "STR2", "AG4", "AG1", sql=f"""{_ALL}
SELECT * FROM (
  SELECT CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month, {_TOOL} AS tool, count(*) AS commits,
         true AS same_repos, true AS same_developers
  FROM commits GROUP BY 1, 2, 3) WHERE tool IS NOT NULL""")
def streamed_tool_sketches(spark, d):
    """Sketches that batches of a stream have stored, united, against one sketch of all rows."""
    src, store, results, progress = (scratch_path(spark, n) for n in ("pushes", "sketches", "tool-months", "progress"))
    files = _write_push_files(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", math.ceil(files / STREAM_BATCHES)).parquet(src)
    I.ingest_archive(spark, stream, store, results, progress, sketches=True)
    whole = I.sketched_counts(I.count_sketches(document_archive(spark, d)), ["year", "month", "tool"])
    got = I.latest_results(spark, results)
    return got.alias("g").join(whole.alias("w"), ["year", "month", "tool"]).select(
        "year", "month", "tool", "g.commits", (F.col("g.distinct_repos") == F.col("w.distinct_repos")).alias("same_repos"),
        (F.col("g.distinct_developers") == F.col("w.distinct_developers")).alias("same_developers"))


_PROBS = D.SIZE_PROBS


@query("size_distribution_rollup", "AG8", "SC10", sql=f"""WITH {SIZED_PUSHES}
SELECT 'quarter' AS level, CAST(year(created_at) AS INTEGER) AS year, CAST(quarter(created_at) AS INTEGER) AS quarter, count(*) AS total_push_events,
       {', '.join(f'true AS {c}_near' for c in _PROBS)} FROM sized GROUP BY 1, 2, 3
UNION ALL
SELECT 'year', CAST(year(created_at) AS INTEGER), CAST(NULL AS INTEGER), count(*), {', '.join('true' for _ in _PROBS)} FROM sized GROUP BY 1, 2, 3""")
def size_distribution_rollup(spark, d):
    """Quantiles of quarters and years from months' stored sketches: each within the sketch's error in rank of the exact rows."""
    path = scratch_path(spark, "size-sketches")
    rows = pushes(order_archive(spark, d, with_size=True)).select(*A.year_month(), F.quarter("created_at").alias("quarter"), push_size().alias("size"))
    K.sketch_quantiles(rows, ["year", "quarter", "month"], "size", "total_push_events").write.parquet(path)
    months = spark.read.parquet(path)
    out = None
    for level, keys in (("quarter", ["year", "quarter"]), ("year", ["year"])):
        got = K.quantile_estimates(K.merge_sketches(months, keys, quantiles=["sketch"], sums=["total_push_events"]), _PROBS)
        # shares of the values below and up to each estimate, from one histogram row per size
        sizes = rows.groupBy(*keys, "size").agg(F.count("*").alias("n"))
        near = sizes.join(got, keys).groupBy(*keys, "total_push_events").agg(*[_rank_near(c, p) for c, p in _PROBS.items()])
        part = near.select(F.lit(level).alias("level"), "year", (F.col("quarter") if level == "quarter" else F.lit(None).cast("int")).alias("quarter"),
                           "total_push_events", *[f"{c}_near" for c in _PROBS])
        out = part if out is None else out.unionByName(part)
    return out


def _rank_near(column: str, p: float):
    known = F.sum(F.when(F.col("size").isNotNull(), F.col("n")))
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)) / known
    e = K.rank_error()
    return F.coalesce((share(F.col("size") < F.col(column)) <= p + e) & (share(F.col("size") <= F.col(column)) >= p - e), known.isNull()).alias(f"{column}_near")
