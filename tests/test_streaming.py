"""Incremental ingest equals the batch result, across restarts and repeated batches."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from eventlens.operators import attribution as A
from eventlens.plans import QUERIES, sketches
from eventlens.sources.adapters import document_archive, document_pushes
from eventlens.sources import versions as V
from eventlens.streaming import incremental as I

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df.select(*cols).collect()))


def test_tool_counts_equal_batch(spark):
    assert rows(QUERIES["streamed_tool_monthly"](spark, SF)) == rows(A.tool_monthly(document_archive(spark, SF)))


def written_documents(spark, tmp_path, layout, n=60):
    """A folder of tables whose documents, with repeated ids and nulls, are one file, a folder of files or folders by language."""
    docs = spark.range(n).selectExpr(
        "if(id % 19 = 5, NULL, id div 2) AS doc_id", "if(id % 11 = 3, NULL, repeat(concat('line ', id, '\\n'), cast(id % 9 AS int))) AS text",
        "if(id % 3 = 0, 'en', 'de') AS lang", "if(id % 13 = 7, NULL, concat('s', id % 2)) AS source")
    d = tmp_path / layout
    at = f"{d}/documents.parquet"
    if layout == "file":
        docs.coalesce(1).write.parquet(f"{tmp_path}/written")
        d.mkdir()
        shutil.copy(next((tmp_path / "written").glob("part-*.parquet")), at)
    elif layout == "folder":
        docs.repartition(7).write.parquet(at)
    else:
        docs.write.partitionBy("lang").parquet(at)
    return str(d)


@pytest.mark.parametrize("layout", ["file", "folder", "by_language"])
def test_a_table_streams_in_any_layout(spark, tmp_path, layout):
    d = written_documents(spark, tmp_path, layout)
    # another table, whose name begins alike
    spark.read.parquet(f"{d}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{d}/documents_old.parquet")
    want = rows(A.tool_monthly(document_archive(spark, d)))
    assert want and rows(QUERIES["streamed_tool_monthly"](spark, d)) == want


def test_streamed_files_grow_in_number(spark, tmp_path, monkeypatch):
    """Pushes of one repository, in a table of many parts: a file for each part, alike in rows, in two batches."""
    docs = spark.range(0, 13 * 600, 13).selectExpr("id AS doc_id", "concat('aider: ', id, '\n', uuid()) AS text", "'en' AS lang", "'s' AS source")
    docs.repartition(24).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sketches, "scratch_path", lambda _, name: str(tmp_path / name))
    sizes = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        got = QUERIES["streamed_tool_sketches"](spark, str(tmp_path)).collect()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    files = [r["count"] for r in spark.read.parquet(f"{tmp_path}/pushes").groupBy(F.input_file_name()).count().collect()]
    assert len(files) >= 24 and sum(files) == 600 and max(files) <= 4 * 600 / len(files)
    assert V.committed(spark, str(tmp_path / "tool-months")) == [0, 1]
    assert all(r.same_repos and r.same_developers for r in got)
    want = A.tool_monthly(document_archive(spark, str(tmp_path))).collect()
    assert want and sorted((r.year, r.month, r.tool, r.commits) for r in got) == sorted((r.year, r.month, r.tool, r.commits) for r in want)


def test_archive_ingest_resumes(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src, store, out, ckpt = (str(tmp_path / n) for n in ("src", "store", "out", "ckpt"))
    schema = docs.schema
    stream = lambda: document_pushes(spark.readStream.schema(schema).parquet(src))
    for lo in (0, 1):
        docs.where(f"doc_id % 2 = {lo}").write.mode("append").parquet(src)
        I.ingest_archive(spark, stream(), store, out, ckpt)
        I.ingest_archive(spark, stream(), store, out, ckpt)  # nothing new: no batch
    expected = rows(A.tool_monthly(document_archive(spark, SF)))
    assert rows(I.ingested_tool_monthly(spark, out)) == expected
    compacted = str(tmp_path / "compacted")
    I.compact(spark, store, compacted, I.merge_identities, ["year", "month"])
    assert rows(I.tool_counts(spark.read.parquet(compacted))) == expected
    one = I.ingested_tool_monthly(spark, out, months=[(2025, 3)]).collect()
    assert one and all((r.year, r.month) == (2025, 3) for r in one)


def test_only_touched_months_are_written_again(spark, tmp_path):
    src, store, out, ckpt = (str(tmp_path / n) for n in ("src", "store", "out", "ckpt"))
    schema = "created_at timestamp_ntz, type string, login string, repo_name string, payload string"
    push = lambda day, login: (day, "PushEvent", login, "r", '{"commits":[{"sha":"1","message":"Generated with Claude Code","author":{"name":"n","email":"e"}}]}')
    for rows_ in ([push("2025-01-03", "a"), push("2025-02-03", "a")], [push("2025-02-04", "b")]):
        data = spark.createDataFrame(rows_, "created_at string, type string, login string, repo_name string, payload string")
        data.withColumn("created_at", data.created_at.cast("timestamp_ntz")).write.mode("append").parquet(src)
        I.ingest_archive(spark, spark.readStream.schema(schema).parquet(src), store, out, ckpt)
    got = {(r.month, r.version): (r.commits, r.distinct_developers) for r in spark.read.parquet(f"{out}/batch=1").collect()}
    assert got == {(1, 0): (1, 1), (2, 1): (2, 2)}


def test_a_version_counts_once_it_is_committed(spark, tmp_path):
    root = str(tmp_path / "results")
    frame = lambda n: spark.createDataFrame([(n,)], "n int")
    with pytest.raises(ValueError):
        V.read_version(spark, root)
    assert V.write_version(frame(0), root, 0) and V.write_version(frame(1), root, 1)
    assert not V.write_version(frame(9), root, 1)  # committed already
    frame(2).write.parquet(V.version_path(root, 2))  # written, never committed
    assert V.committed(spark, root) == [0, 1] and V.read_version(spark, root).first().n == 1 and V.read_version(spark, root, 0).first().n == 0
    assert V.write_version(frame(2), root, 2) and V.write_version(frame(5), root, 5)
    frame(3).write.parquet(V.version_path(root, 3))
    assert V.compact_versions(spark, root, keep=2) == [2, 5]
    assert sorted(p.name for p in (tmp_path / "results").iterdir() if p.name[0] != ".") == ["_committed", "batch=2", "batch=3", "batch=5"]
    assert V.compact_versions(spark, root) == [5] and V.read_version(spark, root).first().n == 5
    assert [p.name for p in (tmp_path / "results").glob("batch*")] == ["batch=5"]


def record(day, ts, draw, n, tool="aider"):
    return json.dumps({"ts": f"2026-03-01T00:00:{ts:02d}Z", "tool": tool, "q": "q", "start": f"2026-{day}-01", "end": f"2026-{day}-{dict([('02', 28)]).get(day, 30)}",
                       "draw": draw, "total_count": n, "incomplete_results": True})


def test_a_batch_reads_only_what_it_touches(spark, tmp_path, monkeypatch):
    src = tmp_path / "log"
    src.mkdir()
    store, out, ckpt = (str(tmp_path / n) for n in ("store", "out", "ckpt"))
    read, real = [], I.read_touched
    monkeypatch.setattr(I, "read_touched", lambda *a: (rows := real(*a), read.append(sorted(rows.inputFiles())))[0])
    run = lambda: I.ingest_observations(spark, str(src), store, out, ckpt, "2026-08-16")
    (src / "a.jsonl").write_text("\n".join(record(m, 5, d, 100 + d, tool) for m in ("02", "06") for tool in ("aider", "a/b =x") for d in range(3)))
    run()
    (src / "b.jsonl").write_text("\n".join([record("02", 1, 0, 9), record("02", 9, 1, 500)]))  # a late, older record and a newer one
    run()
    assert all("/month=2026-02/" in f for f in read[1]) and {f.split("batch=")[1][0] for f in read[1]} == {"0", "1"}
    got = {(r.tool, r.month): (r.estimate, r.lo, r.hi) for r in I.latest_results(spark, out).collect()}
    assert got == {("aider", "2026-02"): (102, 100, 500)} | {k: (101, 100, 102) for k in (("aider", "2026-06"), ("a/b =x", "2026-02"), ("a/b =x", "2026-06"))}


def test_restart_after_a_half_written_version(spark, tmp_path, monkeypatch):
    src = tmp_path / "log"
    src.mkdir()
    store, out, ckpt = (str(tmp_path / n) for n in ("store", "out", "ckpt"))
    run = lambda: I.ingest_observations(spark, str(src), store, out, ckpt, "2026-08-16")
    (src / "a.jsonl").write_text("\n".join(record("02", 5, d, 100 + d) for d in range(3)))
    run()
    (src / "b.jsonl").write_text(record("02", 9, 1, 500))
    real = I.write_version
    monkeypatch.setattr(I, "write_version", lambda df, root, version: (df.limit(0).write.parquet(V.version_path(root, version)), 1 / 0))
    with pytest.raises(Exception, match="division by zero"):
        run()
    assert I.latest_results(spark, out).first().estimate == 101
    monkeypatch.setattr(I, "write_version", real)
    run()
    assert I.latest_results(spark, out).first().estimate == 102
    run()
    assert V.committed(spark, out) == [0, 1]


def test_a_batch_done_twice_changes_nothing(spark, tmp_path):
    """The version was committed, but the stream's own progress was lost."""
    src = tmp_path / "log"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(record("02", 5, d, 100 + d) for d in range(3)))
    for progress in ("one", "two"):
        I.ingest_observations(spark, str(src), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / progress), "2026-08-16")
    assert V.committed(spark, str(tmp_path / "out")) == [0] and I.latest_results(spark, str(tmp_path / "out")).first().estimate == 101


def test_sketches_of_batches_equal_one_sketch(spark, tmp_path):
    from pyspark.sql import functions as F

    from eventlens.operators import sketches as K

    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("u"), F.col("id") % 20_011).alias("u"), (F.col("id") * 7919 % 10_007).alias("v"))
    parts = K.sketch_quantiles(rows.withColumn("b", F.col("v") % 5), ["k", "b"], "v").join(
        K.sketch_distinct(rows.withColumn("b", F.col("v") % 5), ["k", "b"], {"u": "su"}).drop("n"), ["k", "b"])
    whole = K.sketch_distinct(rows, ["k"], {"u": "su"})
    merged = K.merge_sketches(parts, ["k"], distinct=["su"], quantiles=["sketch"])
    read = lambda df: {r.k: (r.n, r.d) for r in K.distinct_estimates(df.select("k", "n", "su"), {"su": "d"}).collect()}
    assert read(merged) == read(whole)
    exact = {r.k: r.d for r in rows.groupBy("k").agg(F.countDistinct("u").alias("d")).collect()}
    assert all(abs(d - exact[k]) <= 4 * K.distinct_error() * exact[k] for k, (_, d) in read(merged).items())
    probs = {"low": 0.05, "mid": 0.5, "high": 0.99}
    for r in K.quantile_estimates(merged, probs).collect():
        of = sorted(x.v for x in rows.where(f"k = {r.k}").collect())
        for name, p in probs.items():
            below, upto = sum(v < r[name] for v in of) / len(of), sum(v <= r[name] for v in of) / len(of)
            assert below <= p + K.rank_error() and upto >= p - K.rank_error()
    nothing = K.quantile_estimates(K.sketch_quantiles(rows.selectExpr("k", "cast(null as bigint) as v"), ["k"], "v"), probs).first()
    assert nothing.n == 20_000 and nothing.mid is None


def test_observation_ingest_settles_duplicates(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    store, out, ckpt = (str(tmp_path / n) for n in ("store", "out", "ckpt"))
    rec = lambda ts, draw, n: json.dumps({
        "ts": f"2026-03-01T00:00:{ts:02d}Z", "tool": "aider", "q": "q", "start": "2026-02-01", "end": "2026-02-28",
        "draw": draw, "total_count": n, "incomplete_results": True})
    (src / "a.jsonl").write_text("\n\n".join([rec(1, 0, 1), rec(2, 1, 6401), rec(3, 0, 6400)]))
    I.ingest_observations(spark, str(src), store, out, ckpt, "2026-08-16")
    assert I.latest_results(spark, out).first().complete is False
    (src / "b.jsonl").write_text("\n".join([rec(5, 2, 6402), rec(0, 1, 9)]))  # a late, older duplicate
    I.ingest_observations(spark, str(src), store, out, ckpt, "2026-08-16")
    r = I.latest_results(spark, out).first()
    assert r.complete and (r.estimate, r.lo, r.hi) == (6401, 6400, 6402)
