"""Calendar windows, draws and monthly estimates."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.operators import series as S
from eventlens.operators import windows as W
from eventlens.sources.tables import OBSERVATION_SCHEMA, read_observations

D = dt.date


def bounds(spark, month, today):
    r = W.month_bounds(spark.createDataFrame([(month,)], "month string"), "month", today).first()
    return r.start, r.end, r.partial, r.days


def test_month_bounds(spark):
    assert bounds(spark, "2026-02", "2026-08-16") == (D(2026, 2, 1), D(2026, 2, 28), False, 28)
    assert bounds(spark, "2026-08", "2026-08-16") == (D(2026, 8, 1), D(2026, 8, 15), True, 15)
    assert bounds(spark, "2028-02", "2028-08-16")[1] == D(2028, 2, 29)


def test_month_bounds_on_first_and_last_day(spark):
    assert bounds(spark, "2026-08", "2026-08-01")[2:] == (True, 0)  # nothing observed yet
    assert bounds(spark, "2026-08", "2026-08-31")[2:] == (True, 30)


def split(spark, start, end, n):
    df = spark.range(1).select(W.split_range(F.lit(start), F.lit(end), F.lit(n)).alias("w"))
    return [(r.start, r.end) for r in df.first().w]


def test_split_covers_evenly(spark):
    w = split(spark, D(2026, 7, 1), D(2026, 7, 31), 4)
    sizes = [(b - a).days + 1 for a, b in w]
    assert sizes == [8, 8, 8, 7]
    assert w[0][0] == D(2026, 7, 1) and w[-1][1] == D(2026, 7, 31)
    assert all(w[i + 1][0] == w[i][1] + dt.timedelta(days=1) for i in range(3))


def test_split_never_exceeds_days(spark):
    assert split(spark, D(2026, 7, 1), D(2026, 7, 3), 10) == [(D(2026, 7, i),) * 2 for i in (1, 2, 3)]
    assert split(spark, D(2026, 7, 2), D(2026, 7, 1), 3) == []


@settings(max_examples=15, deadline=None)
@given(days=st.integers(1, 31), n=st.integers(1, 40))
def test_split_property(spark, days, n):
    start = D(2026, 1, 1)
    w = split(spark, start, start + dt.timedelta(days=days - 1), n)
    sizes = [(b - a).days + 1 for a, b in w]
    assert sum(sizes) == days and max(sizes) - min(sizes) <= 1 and len(w) == min(n, days)


@pytest.mark.parametrize("probe,n", [(100_000, 1), (11_600_000, 13)])
def test_plan_windows(spark, probe, n):
    df = spark.createDataFrame([(D(2026, 7, 1), D(2026, 7, 31), probe)], "start date, end date, probe long")
    assert len(W.plan_windows(df, "probe", 1_500_000).first().windows) == n


def test_expand_months(spark):
    df = spark.createDataFrame([("2025-11..2026-02",), ("2026-04",), ("2026-05..2026-03",)], "token string")
    got = [r.month for r in W.expand_months(df, "token").orderBy("month").collect()]
    assert got == ["2025-11", "2025-12", "2026-01", "2026-02", "2026-04"]


def log(spark, rows):
    schema = "tool string, start date, end date, draw int, total_count long, incomplete_results boolean"
    return spark.createDataFrame(rows, schema)


def all_windows(year, month, days):
    for i in range(1, days + 1):
        for j in range(i, days + 1):
            yield D(year, month, i), D(year, month, j)


def test_small_tool_needs_one_window(spark):
    whole = (D(2026, 2, 1), D(2026, 2, 28))
    obs = log(spark, [("devin", *whole, d, 2800 + 10 * d, True) for d in range(3)])
    r = W.estimate_months(obs, ["tool"], "2026-08-16").first()
    assert (r.estimate, r.lo, r.hi, r.n_windows, r.probe_whole_month, r.complete) == (2810, 2800, 2820, 1, 2800, True)


def test_large_tool_is_split_until_truth_is_recovered(spark):
    per_day, rows = 600_000, []
    for a, b in all_windows(2026, 7, 31):
        days = (b - a).days + 1
        for draw in range(3 if days <= 2 else 1):  # large windows are asked once only
            n = per_day * days + 10 * draw
            rows.append(("claude", a, b, draw, int(n * 0.65) if n > 3_000_000 else n, True))
    r = W.estimate_months(log(spark, rows), ["tool"], "2026-08-16").first()
    assert r.complete and r.n_windows >= 16
    assert abs(r.estimate - per_day * 31) <= 10 * r.n_windows
    assert r.probe_whole_month < r.estimate


def test_window_over_cap_by_median_is_split(spark):
    rows = []
    for a, b in all_windows(2026, 2, 28):
        days = (b - a).days + 1
        for draw in range(3):
            rows.append(("t", a, b, draw, days * 10 + (0 if draw == 0 else 50), True))
    r = W.estimate_months(log(spark, rows), ["tool"], "2026-08-16", cap=300).first()
    # 28 days: first draw 280 fits, the median 330 does not; two halves of 14 days do
    assert r.n_windows == 2 and r.estimate == 2 * 190


def test_single_day_over_cap_is_kept(spark):
    rows = [("t", a, b, d, 100 * ((b - a).days + 1), True) for a, b in all_windows(2026, 2, 28) for d in range(3)]
    r = W.estimate_months(log(spark, rows), ["tool"], "2026-08-16", cap=10).first()
    assert r.n_windows == 28 and r.estimate == 2800


def test_replay_from_log(spark):
    obs = log(spark, [("aider", D(2026, 2, 1), D(2026, 2, 28), d, 6400 + d, True) for d in range(3)])
    assert W.estimate_months(obs, ["tool"], "2026-08-16").first().estimate == 6401


def test_missing_draws_are_reported(spark):
    obs = log(spark, [("aider", D(2026, 2, 1), D(2026, 2, 28), 0, 6400, True)])
    r = W.estimate_months(obs, ["tool"], "2026-08-16").first()
    assert r.complete is False and r.estimate is None


def test_exact_first_draw_is_enough(spark):
    obs = log(spark, [("jules", D(2026, 2, 1), D(2026, 2, 28), 0, 6400, False)])
    r = W.estimate_months(obs, ["tool"], "2026-08-16").first()
    assert r.complete and r.estimate == 6400 and r.draws_used == 1


def test_even_median_is_truncated(spark):
    obs = log(spark, [("t", D(2026, 2, 1), D(2026, 2, 2), d, v, True) for d, v in enumerate((1, 4))])
    assert W.draw_stats(obs, ["tool"], draws=2).first().median == 2


def test_adaptive_windows_cover_and_respect_cap(spark):
    ts = [dt.datetime(2026, 3, 1 + (i * i) % 31, 5) for i in range(400)]
    df = spark.createDataFrame([("a", t) for t in ts], "k string, ts timestamp_ntz")
    w = W.adaptive_windows(df, ["k"], "ts", 30).orderBy("start").collect()
    assert sum(r.n for r in w) == 400
    assert all(r.n <= 30 or r.start == r.end for r in w)
    assert w[0].start == D(2026, 3, 1) and w[-1].end == D(2026, 3, 31)
    assert all(b.start == a.end + dt.timedelta(days=1) for a, b in zip(w, w[1:]))


def test_log_round_trip(spark, tmp_path):
    rec = {"ts": "2026-08-16T00:00:00+00:00", "tool": "claude", "q": "x", "start": "2026-02-01", "end": "2026-02-14", "draw": 1,
           "total_count": 5, "incomplete_results": True}
    newer = dict(rec, ts="2026-08-16T00:00:05+00:00", total_count=2227638)
    (tmp_path / "raw.jsonl").write_text("\n".join([json.dumps(newer), "", json.dumps(rec), ""]) + "\n")
    rows = read_observations(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].total_count == 2227638 and rows[0].start == D(2026, 2, 1)
    assert OBSERVATION_SCHEMA.startswith("ts TIMESTAMP")


def test_upsert_newer_wins(spark):
    schema = "tool string, month string, estimate long, version int"
    old = spark.createDataFrame([("claude", "2026-02", 100, 1)], schema)
    new = spark.createDataFrame([("claude", "2026-02", 200, 2), ("jules", "2026-02", 5, 2)], schema)
    got = {r.tool: r.estimate for r in S.upsert_latest(old, new, ["tool", "month"]).collect()}
    assert got == {"claude": 200, "jules": 5}


def test_draws_of_different_queries_are_not_mixed(spark):
    obs = spark.createDataFrame(
        [("aider", q, D(2026, 2, 1), D(2026, 2, 28), i, n, True) for q, n in (("old", 900), ("new", 100)) for i in range(3)],
        "tool string, q string, start date, end date, draw int, total_count long, incomplete_results boolean")
    both = {r.q: r.estimate for r in W.estimate_months(obs, ["tool"], "2026-08-16").collect()}
    assert both == {"old": 900, "new": 100}
    one = W.estimate_months(obs, ["tool"], "2026-08-16", current_query=F.lit("new")).collect()
    assert [(r.tool, r.estimate) for r in one] == [("aider", 100)]


def test_rows_without_a_time_are_left_out(spark):
    ts = spark.createDataFrame([("a", "2026-02-03"), ("a", None)], "tool string, day string").selectExpr("tool", "CAST(day AS TIMESTAMP) AS ts")
    assert [r.n for r in W.adaptive_windows(ts, ["tool"], "ts", 5).collect()] == [1]
    m = spark.createDataFrame([("a", "2026-02", 5), ("a", None, 6), ("z", "2026-02", 7)], "tool string, month string, y long")
    got = {(r.tool, r.month): r.y for r in S.tool_matrix(m, ["tool"], "y", "2026-01", "2026-02", listed=["a", "b"]).collect()}
    assert got == {("a", "2026-01"): None, ("a", "2026-02"): 5, ("b", "2026-01"): None, ("b", "2026-02"): None}


def test_repeated_rows_of_a_total_are_an_error(spark):
    df = spark.createDataFrame([("a", "2026-02", 100, 100, 100, False), ("a", "2026-02", 100, 100, 100, False), ("b", "2026-02", 10, 10, 10, False)],
                               "tool string, month string, estimate long, lo long, hi long, partial boolean")
    assert S.complete_total(df.dropDuplicates(), ["a", "b"]).first().estimate == 110
    with pytest.raises(Exception, match="more than one row"):
        S.complete_total(df, ["a", "b"]).collect()


def test_stitching_by_the_last_month_or_month_by_month(spark):
    exact = spark.createDataFrame([("a", "2026-01", 1), ("a", "2026-03", 3), ("b", "2026-01", 1)], "tool string, month string, y long")
    other = spark.createDataFrame([(t, f"2026-0{i}", 10 * i) for t in "ab" for i in range(1, 5)], "tool string, month string, y long")
    rows = lambda by: sorted((r.tool, r.month, r.y) for r in S.stitch_series(exact, other, ["tool"], by_month=by).collect())
    assert rows(False) == [("a", "2026-01", 1), ("a", "2026-03", 3), ("a", "2026-04", 40), ("b", "2026-01", 1), ("b", "2026-04", 40)]
    assert rows(True) == [("a", "2026-01", 1), ("a", "2026-02", 20), ("a", "2026-03", 3), ("a", "2026-04", 40),
                          ("b", "2026-01", 1), ("b", "2026-02", 20), ("b", "2026-03", 30), ("b", "2026-04", 40)]
