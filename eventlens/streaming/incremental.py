"""Incremental ingest with Structured Streaming.

Each micro-batch is reduced to a mergeable form and stored by month under its batch number, overwriting whatever a
failed attempt left there, so a restart repeats no work and loses none.  A batch then reads again only the months
that it touches, and commits a new version of the result table (``sources.versions``).  A result table belongs to one
checkpoint: a batch whose version is committed is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators import windows as W
from eventlens.operators.attribution import identity_counts, labelled_commits, year_month
from eventlens.operators.series import upsert_latest
from eventlens.operators.sketches import LG_K, distinct_estimates, merge_sketches, sketch_distinct
from eventlens.sources.tables import OBSERVATION_SCHEMA, dedupe_observations
from eventlens.sources.versions import committed, read_version, version_path, write_version


def consume_available(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every file not seen before to ``put``, in batches, then stop."""
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def compact(spark: SparkSession, store: str, target: str, merge: Callable[[DataFrame], DataFrame], partition_by: list[str] = ()) -> None:
    """Fold all batches of a store into one, written to a new store."""
    folded = merge(spark.read.parquet(store).drop("batch")).withColumn("batch", F.lit(0))
    folded.write.mode("overwrite").partitionBy(*partition_by, "batch").parquet(target)


# ---- observation log -------------------------------------------------------
def observation_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of the observation log; blank lines are skipped."""
    return (
        spark.readStream.schema(OBSERVATION_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
        .json(path).where(F.col("tool").isNotNull())
    )


def _store(rows: DataFrame, store: str, batch_id: int, by: list[str], labels: list[str] = ()) -> list:
    """Write a batch under the directories of ``by``, one file each, and the combinations of them and ``labels`` that it touches.

    At most one combination per calendar month and label reaches the driver.
    """
    rows = rows.withColumn("batch", F.lit(batch_id)).persist()
    try:
        rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(store)
        return rows.select(*by, *labels).distinct().collect()
    finally:
        rows.unpersist()


def read_touched(spark: SparkSession, store: str, touched: list, by: list[str], schema: str, labels: list[str] = ()) -> DataFrame:
    """The stored rows of some combinations: only the directories that they name are listed and read."""
    paths = sorted({"/".join([store, *(f"{c}={t[c]}" for c in by)]) for t in touched})
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", store).parquet(*paths)
    if not labels:
        return rows
    label = F.concat_ws("\0", *[F.col(c).cast("string") for c in (*by, *labels)])
    return rows.where(label.isin(["\0".join(str(t[c]) for c in (*by, *labels)) for t in touched]))


def _upsert(spark: SparkSession, new: DataFrame, results: str, batch_id: int, keys: list[str]) -> None:
    """Commit the result table after a batch: its rows replace those of the same key in the last committed version."""
    earlier = [v for v in committed(spark, results) if v < batch_id]
    old = spark.read.parquet(version_path(results, earlier[-1])) if earlier else None
    write_version(upsert_latest(old, new.withColumn("version", F.lit(batch_id).cast("long")), keys, "version"), results, batch_id)


def latest_results(spark: SparkSession, results: str) -> DataFrame:
    return read_version(spark, results).drop("version")


def ingest_observations(spark: SparkSession, path: str, store: str, results: str, checkpoint: str, today,
                        files_per_batch: int = 100, **estimate) -> None:
    """Keep the last record per key of each batch by month, and estimate anew the (tool, month)s that it touches.

    Keys repeated across batches are settled on read, so a late record that is older than the one it repeats loses.
    Records without a window belong to no month and are left out.  ``estimate`` goes to ``estimate_months``.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        if batch_id in committed(spark, results):
            return
        rows = dedupe_observations(batch.where("start IS NOT NULL")).withColumn("month", F.date_format("start", "yyyy-MM"))
        touched = _store(rows, store, batch_id, ["month"], ["tool"])
        obs = read_touched(spark, store, touched, ["month"], OBSERVATION_SCHEMA + ", month STRING, batch INT", ["tool"]).drop("month", "batch")
        _upsert(spark, W.estimate_months(dedupe_observations(obs), ["tool"], today, **estimate), results, batch_id, ["tool", "month"])

    consume_available(observation_stream(spark, path, files_per_batch), put, checkpoint)


# ---- attributed counts -----------------------------------------------------
_KEYS = ["year", "month", "tool", "repo_name", "login"]


def count_identities(archive: DataFrame) -> DataFrame:
    """Commits per month, tool, repository and developer: additive, and enough for exact distinct counts."""
    return identity_counts(labelled_commits(archive), [*year_month(), "tool"])


def merge_identities(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*_KEYS).agg(F.sum("commits").alias("commits"))


def tool_counts(identities: DataFrame) -> DataFrame:
    return identities.groupBy("year", "month", "tool").agg(
        F.sum("commits").alias("commits"),
        F.countDistinct("repo_name").alias("distinct_repos"),
        F.countDistinct("login").alias("distinct_developers"),
    )


# ---- the same from stored sketches -----------------------------------------
_SKETCHES = {"repo_name": "repo_sketch", "login": "developer_sketch"}


def count_sketches(archive: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Per month and tool: commits, and sketches of repositories and developers; a few kilobytes however many there are."""
    return sketch_distinct(labelled_commits(archive), [*year_month(), "tool"], _SKETCHES, "commits", lg_k)


def sketched_counts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts from any union of ``count_sketches``, by month and tool or coarser keys."""
    merged = merge_sketches(parts, keys, distinct=list(_SKETCHES.values()), sums=["commits"])
    return distinct_estimates(merged, {"repo_sketch": "distinct_repos", "developer_sketch": "distinct_developers"})


_MONTH_BY = ["year", "month"]


def ingest_archive(spark: SparkSession, stream: DataFrame, store: str, results: str, checkpoint: str, sketches: bool = False) -> None:
    """Identity counts by month directory, and the counts of the months that a batch touches.

    Only the directories of those months are read again.  With ``sketches`` a batch stores one row per month and tool
    instead of one per identity, and distinct counts are estimates.  The stream's own ``maxFilesPerTrigger`` bounds a batch.
    """
    reduced = count_sketches if sketches else count_identities
    counted = (lambda rows: sketched_counts(rows, ["year", "month", "tool"])) if sketches else tool_counts

    def put(batch: DataFrame, batch_id: int) -> None:
        if batch_id in committed(spark, results):
            return
        rows = reduced(batch)
        touched = _store(rows, store, batch_id, _MONTH_BY)
        again = read_touched(spark, store, touched, _MONTH_BY, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", batch INT")
        _upsert(spark, counted(again.drop("batch")), results, batch_id, ["year", "month", "tool"])

    consume_available(stream, put, checkpoint)


def ingested_tool_monthly(spark: SparkSession, results: str, months: list[tuple[int, int]] | None = None) -> DataFrame:
    """Counts per month and tool over everything ingested, or those of some months."""
    rows = latest_results(spark, results)
    if months is not None:
        wanted = F.lit(False)
        for y, m in months:
            wanted = wanted | ((F.col("year") == y) & (F.col("month") == m))
        rows = rows.where(wanted)
    return rows.orderBy("year", "month", F.desc("commits"), "tool")
