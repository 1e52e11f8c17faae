"""Physical plans: what reaches the scan, and what does not shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from eventlens.operators import attribution as A
from eventlens.operators import distribution as D
from eventlens.operators.ranking import topn_per_group
from eventlens.sources import archive as R
from eventlens.sources import sinks
from eventlens.sources.adapters import document_archive, order_archive

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def archive_path(spark, tmp_path):
    rows = [(dt.datetime(2025, m, 3), "PushEvent", f"u{m}", "r", '{"size": 1}', f"2025-{m:02d}") for m in range(1, 7)]
    df = spark.createDataFrame(rows, "created_at timestamp, type string, login string, name string, payload string, month string")
    path = str(tmp_path / "archive")
    sinks.write_archive(df.select("created_at", "type", F.struct("login").alias("actor"), F.struct("name").alias("repo"), "payload", "month"), path)
    return path


def test_totals_never_read_the_payload(spark, tmp_path):
    text = plan(A.monthly_totals(R.read_archive(spark, archive_path(spark, tmp_path))))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "payload" not in schema
    assert "EqualTo(type,PushEvent)" in text


def test_month_range_prunes_partitions(spark, tmp_path):
    df = D.velocity(R.read_archive(spark, archive_path(spark, tmp_path), "2025_02", "202503"))
    filters = plan(df).split("PartitionFilters: [")[1].split("]")[0]
    assert "2025-02" in filters and "2025-03" in filters
    assert [r.month for r in df.collect()] == [2, 3]


def test_timestamp_range_reaches_the_scan(spark):
    text = plan(R.month_range(order_archive(spark, SF), "1996-01", "1996-12"))
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed


def test_top_n_is_trimmed_before_the_shuffle(spark):
    df = topn_per_group(order_archive(spark, SF), ["repo_name"], [F.desc("created_at"), F.asc("login")], 2)
    text = plan(df)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_hot_repository_joins_as_counts(spark):
    lang = spark.createDataFrame([("hot/repo", [("Python", 5), ("C", 5)])], "repo_name string, language array<struct<name:string,bytes:bigint>>")
    text = plan(D.size_by_category(order_archive(spark, SF, with_size=True), lang))
    # the histogram aggregation sits below the language join
    join = text.split("Join")[1]
    assert "HashAggregate" in join
    assert D.dominant_category(lang, "repo_name", "language").first().category == "C"


def test_no_cartesian_products(spark):
    from eventlens.plans import QUERIES

    for name in ("tool_monthly", "size_by_language", "segmented_regression", "growth_projection", "tool_matrix", "stratified_split"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_labels_are_evaluated_once_and_nothing_moves_before_the_parse(spark):
    df = A.tool_monthly(document_archive(spark, SF))
    optimised = df._jdf.queryExecution().optimizedPlan().toString()
    once = A.labelled_commits(document_archive(spark, SF))._jdf.queryExecution().analyzed().toString()
    assert optimised.count("RLIKE") == once.count("RLIKE") == 11
    text = plan(df)
    below_parse = text.split("from_json")[-1]
    assert "Exchange" not in below_parse and "Expand" in text
    expand = text.split("Expand")[1]
    assert "HashAggregate" in expand  # one row per identity by then
