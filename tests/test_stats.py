"""Rank, trend, regression and break statistics against brute force and known values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.functions import pvalues as P
from eventlens.operators import ranks, stats
from eventlens.operators.changepoint import changepoints, kernel_breaks

RNG = np.random.default_rng(7)


def two_sample(spark, keys=("a", "b"), n=300, integers=True):
    rows = []
    for k in keys:
        v = RNG.integers(0, 40, n) if integers else RNG.normal(0, 1, n)
        hot = RNG.random(n) < 0.35  # one value holds a third of the rows
        v = np.where(hot, 7, v)
        rows += [(k, float(x), bool(g)) for x, g in zip(v, RNG.random(n) < 0.4)]
    return rows, spark.createDataFrame(rows, "k string, v double, first boolean")


@pytest.mark.parametrize("ranges", [None, 40])
def test_pair_counts_match_brute_force(spark, ranges):
    rows, df = two_sample(spark)
    got = {r.k: r for r in ranks.pair_counts(df, ["k"], "v", F.col("first"), ranges=ranges).collect()}
    for k in ("a", "b"):
        x = [v for kk, v, g in rows if kk == k and g]
        y = [v for kk, v, g in rows if kk == k and not g]
        r = got[k]
        assert (r.n1, r.n2) == (len(x), len(y))
        assert r.wins == sum(a > b for a, b in itertools.product(x, y))
        assert r.draws == sum(a == b for a, b in itertools.product(x, y))
        _, t = np.unique(x + y, return_counts=True)
        assert r.tie_term == float(((t.astype(float)) ** 3 - t).sum())


@pytest.mark.parametrize("ranges", [None, 40])
@pytest.mark.parametrize("integers", [True, False])
def test_exact_quantiles(spark, ranges, integers):
    rows, df = two_sample(spark, n=211, integers=integers)
    probs = {"p25": 0.25, "p50": 0.5, "p95": 0.95}
    disc = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", probs, ranges=ranges).collect()}
    cont = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", probs, interpolate=True, ranges=ranges).collect()}
    for k in ("a", "b"):
        v = sorted(x for kk, x, _ in rows if kk == k)
        for name, p in probs.items():
            assert disc[k][name] == v[math.ceil(p * len(v)) - 1]
            assert cont[k][name] == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_u_statistics_are_complementary(spark):
    _, df = two_sample(spark, keys=("a",))
    pre = stats.mann_whitney(df, ["k"], "v", F.col("first")).first()
    post = stats.mann_whitney(df, ["k"], "v", ~F.col("first")).first()
    assert pre.u + post.u == pre.n1 * pre.n2
    assert pre.p_value == pytest.approx(post.p_value)
    assert pre.rank_biserial == pytest.approx(-post.rank_biserial)


def test_small_tie_free_rank_test_is_exact(spark):
    x, y = [1.1, 2.2, 3.3], [4.4, 5.5, 6.6, 7.7]
    df = spark.createDataFrame([("k", v, True) for v in x] + [("k", v, False) for v in y], "k string, v double, first boolean")
    r = stats.mann_whitney(df, ["k"], "v", F.col("first")).first()
    assert r.u == 0 and r.p_value == pytest.approx(2 / 35)  # 1 of C(7,3) arrangements, two-sided


def brute_rank_p(n1, n2, u):
    seen = [sum(1 for i in c for j in range(n1 + n2) if j not in c and i > j) for c in itertools.combinations(range(n1 + n2), n1)]
    big = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(s >= big for s in seen) / len(seen))


@pytest.mark.parametrize("n1,n2", [(2, 5), (4, 4), (5, 3)])
def test_rank_sum_exact_distribution(n1, n2):
    for u in range(n1 * n2 + 1):
        assert P.rank_sum_exact_p(n1, n2, u) == pytest.approx(brute_rank_p(n1, n2, u))


def test_rank_sum_is_exact_at_any_size():
    m, n = 4, 700
    ways = [1] + [0] * (m * n)  # coefficients of the product, term by term
    for i in range(1, m + 1):
        for x in range(len(ways) - 1, n + i - 1, -1):
            ways[x] -= ways[x - n - i]
        for x in range(i, len(ways)):
            ways[x] += ways[x - i]
    for u in (0, 1, 37, 800, 1400, 2799):
        k = min(u, m * n - u)
        assert P.rank_sum_exact_p(m, n, u) == pytest.approx(min(1.0, 2 * sum(ways[: k + 1]) / math.comb(n + m, m)), rel=1e-12)
    assert P.rank_sum_exact_p(8, 600, 0) == pytest.approx(2 / math.comb(608, 8), rel=1e-12)
    assert 0.2 < P.rank_sum_exact_p(8, 50_000_000, 1.5e8) < 0.3
    with pytest.raises(ValueError):
        P.rank_sum_exact_p(9, 20, 3)


def test_long_kendall_with_one_inversion():
    assert P.kendall_exact_p(40, 1) == pytest.approx(2 / math.factorial(39), rel=1e-9)
    assert P.kendall_exact_p(90_000, 0) == 0.0 and P.kendall_exact_p(34, 34 * 33 // 2) == pytest.approx(2 / math.factorial(34), rel=1e-9)
    with pytest.raises(ValueError):
        P.kendall_exact_p(34, 5)


def test_kendall_exact_distribution():
    for n in (3, 5, 6):
        inv = [sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) for p in itertools.permutations(range(n))]
        for d in range(n * (n - 1) // 2 + 1):
            c = min(d, n * (n - 1) // 2 - d)
            assert P.kendall_exact_p(n, d) == pytest.approx(min(1.0, 2 * sum(i <= c for i in inv) / len(inv)))


@pytest.mark.parametrize("t,dof,p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.228139, 10, 0.05), (12.7062, 1, 0.05), (-2.776445, 4, 0.05), (4.0, 2, 0.0571909584)])
def test_student_tail(spark, t, dof, p):
    df = spark.createDataFrame([(t, float(dof))], "t double, d double")
    assert df.select(P.student_two_sided("t", "d")).first()[0] == pytest.approx(p, abs=2e-6)


def test_normal_tail(spark):
    df = spark.createDataFrame([(1.959964,), (-2.575829,), (0.0,)], "z double")
    got = [r[0] for r in df.select(P.normal_two_sided("z")).collect()]
    assert got == pytest.approx([0.05, 0.01, 1.0], abs=1e-6)


@pytest.mark.parametrize("ranges", [None, 40])
@pytest.mark.parametrize("n", [1, 2, 7, 64, 65])
def test_kendall_inversions(spark, n, ranges):
    y = RNG.integers(0, 20, n)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, t int, y double")
    rows = stats.kendall_trend(df, ["k"], "t", "y", ranges=ranges).collect()
    pairs = list(itertools.combinations(y, 2))
    d, c = sum(a > b for a, b in pairs), sum(a < b for a, b in pairs)
    tied = sum(a == b for a, b in pairs)
    assert rows[0].discordant == d
    if len(pairs) > tied:
        assert rows[0].tau == pytest.approx((c - d) / math.sqrt(len(pairs) * (len(pairs) - tied)))


def test_kendall_small_sample_uses_exact_p(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 2, 4, 3, 5])], "k string, t int, y double")
    r = stats.kendall_trend(df, ["k"], "t", "y").first()
    assert r.tau == pytest.approx(0.8) and r.p_value == pytest.approx(2 * 5 / 120) and r.direction == "increasing"


def line(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series_id string, t long, y double")


def test_segmented_regression_and_level_test(spark):
    y = [1.0, 2.1, 2.9, 4.2, 10.0, 12.2, 13.9, 16.1, 18.0]
    b = spark.createDataFrame([("s", 4)], "series_id string, break_t long")
    r = stats.segmented_regression(line(spark, y), b, ["series_id"]).first()
    slope, icept = np.polyfit(range(4, 9), y[4:], 1)
    assert r.post_slope == pytest.approx(slope) and r.post_intercept == pytest.approx(icept)
    assert r.pre_n == 4 and r.post_n == 5 and r.post_p < 1e-4
    assert r.slope_change_ratio == pytest.approx(slope / np.polyfit(range(4), y[:4], 1)[0])
    w = stats.welch_t(line(spark, y), b, ["series_id"]).first()
    a, c = np.array(y[:4]), np.array(y[4:])
    se = math.sqrt(a.var(ddof=1) / 4 + c.var(ddof=1) / 5)
    assert w.t_statistic == pytest.approx((a.mean() - c.mean()) / se)
    assert w.percent_change == pytest.approx((c.mean() / a.mean() - 1) * 100)


def test_flat_first_segment_has_infinite_ratio(spark):
    b = spark.createDataFrame([("s", 3)], "series_id string, break_t long")
    r = stats.segmented_regression(line(spark, [2, 2, 2, 3, 4, 5.5]), b, ["series_id"]).first()
    assert r.pre_slope == 0 and r.pre_r2 == 0 and math.isinf(r.slope_change_ratio)


def brute_segmentation(y, penalty, min_size):
    n = len(y)
    d2 = np.subtract.outer(y, y) ** 2
    med = np.median(d2[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(d2 / med if med else d2, 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    cost = lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)
    best = (cost(0, n) + penalty, [])
    for m in range(1, n // min_size):
        for cuts in itertools.combinations(range(min_size, n - min_size + 1), m):
            edges = [0, *cuts, n]
            if all(b - a >= min_size for a, b in zip(edges, edges[1:])):
                total = sum(cost(a, b) + penalty for a, b in zip(edges, edges[1:]))
                best = min(best, (total, list(cuts)))
    return best[1]


@pytest.mark.parametrize("penalty", [0.3, 1.0, 3.0])
def test_kernel_segmentation_is_optimal(penalty):
    y = np.array([1.0, 1.2, 0.9, 1.1, 5.0, 5.3, 4.8, 9.0, 9.4, 9.1, 9.2, 5.1, 5.0, 4.9])
    assert kernel_breaks(y, penalty, 3) == brute_segmentation(y, penalty, 3)


def test_changepoints_per_series(spark):
    step = [("s", i, 10.0 if i < 20 else 30.0) for i in range(40)]
    flat = [("f", i, 5.0) for i in range(40)]
    short = [("x", i, float(i)) for i in range(4)]
    df = spark.createDataFrame(step + flat + short, "series_id string, t long, y double")
    assert [(r.series_id, r.break_t) for r in changepoints(df, ["series_id"]).collect()] == [("s", 20)]
    best = {r.series_id: r.break_t for r in stats.best_split(df, ["series_id"]).collect()}
    assert best["s"] == 20 and "x" not in best


def test_dispersion_ignores_and_counts_nulls(spark):
    df = spark.createDataFrame([("s", 1.0, 3.0, True), ("s", None, 3.0, True), ("s", 1.0, 5.0, False)],
                               "k string, lo double, hi double, pre boolean")
    r = stats.dispersion_shift(df, ["k"], "lo", "hi", F.col("pre")).first()
    assert (r.iqr_pre_mean, r.iqr_post_mean, r.n_null, r.iqr_change_percent) == (2.0, 4.0, 1, 100.0)


def test_median_of_pairs_without_pairs():
    from eventlens.operators.changepoint import median_square

    for n in (2, 3, 4, 7, 50, 201):
        for y in (RNG.normal(size=n), RNG.integers(0, 5, n).astype(float), RNG.normal(size=n) * 1e12 + 0.1, np.zeros(n)):
            d = np.subtract.outer(y, y)[np.triu_indices(n, 1)] ** 2
            assert median_square(y) == pytest.approx(np.median(d), rel=1e-14)


@pytest.mark.parametrize("seed", range(25))
def test_pruning_keeps_the_breaks_and_drops_starts(seed):
    from eventlens.operators.changepoint import kernel_search

    rng = np.random.default_rng(seed)
    n = int(rng.integers(6, 260))
    kinds = [lambda: np.repeat(rng.normal(0, 4, n // 20 + 1), 20)[:n] + rng.normal(0, 0.4, n), lambda: rng.integers(0, 3, n).astype(float), lambda: rng.normal(0, 1, n), lambda: np.zeros(n)]
    y = kinds[seed % 4]()
    for penalty in (0.2, 1.0, 3.0):
        for min_size in (1, 3, 7):
            full, all_starts = kernel_search(y, penalty, min_size, prune=False)
            pruned, left = kernel_search(y, penalty, min_size)
            assert pruned == full and left <= all_starts


def test_pruned_search_of_a_long_series_is_no_longer_quadratic():
    from eventlens.operators.changepoint import kernel_search

    rng = np.random.default_rng(3)
    y = np.repeat(np.tile([0.0, 8.0, 3.0, 12.0], 250), 20) + rng.normal(0, 0.3, 20_000)
    breaks, left = kernel_search(y, 3.0, 3)
    assert breaks == list(range(20, 20_000, 20)) and left < 20_000 * 100
