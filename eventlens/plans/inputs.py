"""Round trips through files, and the incremental forms of two batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import attribution as A
from eventlens.operators import distribution as D
from eventlens.operators import growth as G
from eventlens.plans.distribution import r6, rounded
from eventlens.plans.growth import START, _GIVEN, cumulative_orders, given_parameters
from eventlens.plans.registry import ORACLES, query
from eventlens.plans.series import CAP, TODAY, current_query
from eventlens.plans.sqlbase import ORDER_PUSHES, SIZED_PUSHES, YM, YQ
from eventlens.session import scratch_path
from eventlens.sources import archive, sinks, tables
from eventlens.sources.adapters import document_archive, document_pushes, observation_log, order_archive, table_stream
from eventlens.streaming import incremental as I

_DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING"


@query("monthly_csv_round_trip", "SRC3", "SRC6", sql=f"""WITH {ORDER_PUSHES}
SELECT {YM}, count(*) AS total_pushes, count(DISTINCT login) AS unique_pushers,
       {r6("count(*) / count(DISTINCT login)::DOUBLE", "pushes_per_dev")}, CAST(date_trunc('month', min(created_at)) AS DATE) AS date
FROM order_pushes GROUP BY 1, 2""")
def monthly_csv_round_trip(spark, d):
    path = scratch_path(spark, "monthly-csv")
    sinks.write_csv(D.velocity(order_archive(spark, d)), path)
    return rounded(tables.read_monthly_csv(spark, path), "pushes_per_dev")


@query("quarterly_csv_round_trip", "SRC3", "SRC6", "AG8", sql=f"""WITH {SIZED_PUSHES}
SELECT {YQ}, count(*) AS total_push_events, {r6("avg(size)", "avg_commits_per_push")}, quantile_disc(size, 0.25)::DOUBLE AS p25_commits_per_push,
       quantile_disc(size, 0.5)::DOUBLE AS median_commits_per_push, quantile_disc(size, 0.75)::DOUBLE AS p75_commits_per_push,
       quantile_disc(size, 0.95)::DOUBLE AS p95_commits_per_push, {r6("stddev_samp(size)", "stddev_commits_per_push")},
       CAST(date_trunc('quarter', min(created_at)) AS DATE) AS date
FROM sized GROUP BY 1, 2""")
def quarterly_csv_round_trip(spark, d):
    path = scratch_path(spark, "quarterly-csv")
    cols = [c.split()[0] for c in tables.QUARTERLY_SCHEMA.split(", ")]
    sinks.write_csv(D.size_distribution(order_archive(spark, d, with_size=True)).select(*cols), path)
    return rounded(tables.read_quarterly_csv(spark, path), "avg_commits_per_push", "stddev_commits_per_push")


@query("message_csv_round_trip", "SRC4", "SRC6", sql=ORACLES["latest_commit_sample"].replace(
    "message AS commit_message", "coalesce(message, '') AS commit_message"))
def message_csv_round_trip(spark, d):
    path = scratch_path(spark, "messages-csv")
    sample = A.commit_sample(document_archive(spark, d))
    sinks.write_csv(sample.withColumn("created_at", F.col("created_at").cast("string")), path)
    out = tables.read_messages(spark, path)
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("partitioned_archive_scan", "SRC1", "SRC6", "AG6", sql=f"""WITH {ORDER_PUSHES}
SELECT {YM}, count(*) AS total_pushes, count(DISTINCT login) AS unique_pushers,
       {r6("count(*) / count(DISTINCT login)::DOUBLE", "pushes_per_dev")}
FROM order_pushes WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-07-01' GROUP BY 1, 2""")
def partitioned_archive_scan(spark, d):
    """The nested, month-partitioned layout, read back through partition pruning."""
    path = scratch_path(spark, "archive")
    rows = order_archive(spark, d, with_size=True).select(
        F.col("created_at").cast("timestamp").alias("created_at"), "type", F.struct("login").alias("actor"),
        F.struct(F.col("repo_name").alias("name")).alias("repo"), "payload",
        F.date_format("created_at", "yyyy-MM").alias("month"))
    sinks.write_archive(rows, path)
    return rounded(D.velocity(archive.read_archive(spark, path, "1997_01", "199806")), "pushes_per_dev")


@query("fits_json_round_trip", "SNK2", "FIT8", sql=f"""WITH {_GIVEN},
axis AS (SELECT series_id, model, amp, rate, shift, unnest(generate_series(0, last_t + 12)) AS t FROM given WHERE space = 'lin')
SELECT a.series_id, a.model, {r6('a.amp', 'amp')}, q.n, {r6('q.aic', 'aic')}, CAST(a.t AS INTEGER) AS t,
       CAST(round_even(CASE a.model WHEN 'exponential' THEN a.amp * exp(a.rate * a.t)
            WHEN 'logistic' THEN a.amp / (1 + exp(-a.rate * (a.t - a.shift))) ELSE a.amp * exp(-exp(-a.rate * (a.t - a.shift))) END, 0) AS BIGINT) AS fitted
FROM axis a JOIN quality q ON q.series_id = a.series_id AND q.model = a.model AND q.space = 'lin'""")
def fits_json_round_trip(spark, d):
    """Fit records as nested JSON: parameters and fitted curve inside one row per series and model."""
    s = cumulative_orders(spark, d)
    params = given_parameters(s).where("space = 'lin'")
    fits = G.fit_quality(G.fit_points(s, [("lin", START, None)]), params)
    path = scratch_path(spark, "fits-json")
    blob = G.fit_records(fits, G.project(params, s))
    sinks.write_json(blob, path)
    back = spark.read.schema(blob.schema).json(path)
    out = back.select("series_id", "model", F.col("params.amp").alias("amp"), "n", "aic", F.posexplode("fitted").alias("t", "fitted"))
    return rounded(out, "amp", "aic")


@query("streamed_month_estimates", "STR1", "SRC5", "SE6", sql=ORACLES["month_estimates"])
def streamed_month_estimates(spark, d):
    """The result table after several batches, one of them after a restart."""
    log, store, results, progress = (scratch_path(spark, n) for n in ("log", "observations", "months", "progress"))
    rows = observation_log(spark, d)
    first = F.col("draw") == 0
    for some in (first, ~first):
        rows.where(some).repartition(4).write.mode("append").json(log)
        I.ingest_observations(spark, log, store, results, progress, TODAY, files_per_batch=3, cap=CAP, current_query=current_query())
    return I.latest_results(spark, results)


@query("streamed_tool_monthly", "STR2", "AG4", sql=ORACLES["tool_monthly"])
def streamed_tool_monthly(spark, d):
    docs = table_stream(spark, d, "documents", _DOC_SCHEMA)
    store, results = scratch_path(spark, "identities"), scratch_path(spark, "tool-months")
    I.ingest_archive(spark, document_pushes(docs), store, results, scratch_path(spark, "progress"))
    return I.ingested_tool_monthly(spark, results)
