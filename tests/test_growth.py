"""Growth fits against published parameters of one monthly series."""

import pytest

from eventlens.operators import growth as G
from eventlens.operators import series as S

# A published 20-month series with its bands (the last month is
# unfinished), and the parameters and AIC values published for it.
MONTHS = ["2025-01", "2025-02", "2025-03", "2025-04", "2025-05", "2025-06", "2025-07", "2025-08", "2025-09", "2025-10",
          "2025-11", "2025-12", "2026-01", "2026-02", "2026-03", "2026-04", "2026-05", "2026-06", "2026-07", "2026-08"]
Y = [24, 2139, 23273, 21703, 43017, 224256, 440682, 557127, 486418, 953767, 1116487, 1549783, 3396432, 5439099, 10291623,
     11756992, 13854357, 17436783, 19804129, 9020552]
LO = [24, 2139, 23273, 21703, 43017, 224256, 440682, 557127, 486418, 913666, 1097728, 1491021, 3193736, 5395728, 9987189,
      11662448, 13545953, 17015282, 19736348, 9008169]
HI = [24, 2139, 23273, 21703, 43017, 224256, 440682, 557127, 486418, 963175, 1121902, 1550982, 3396934, 5449455, 10318239,
      11766395, 13973570, 17469361, 19804946, 9020583]
FULL = {"exponential": (187476.75, 0.26406360, 0.0, 508.7972), "logistic": (22495559, 0.5750761, 14.823037, 480.6230),
        "gompertz": (29638725, 0.2699889, 14.700731, 479.1789)}
HINDCAST_AIC = {"exponential": 347.9528, "logistic": 349.9741, "gompertz": 357.6259}
SENSITIVITY = {  # (space, start): best, aic exp/logistic/gompertz, ceilings
    ("lin", "2025-02"): ("gompertz", 508.8, 480.6, 479.2, 22495559, 29638725),
    ("lin", "2025-06"): ("gompertz", 399.8, 378.7, 377.5, 22495666, 29638723),
    ("lin", "2025-11"): ("gompertz", 261.0, 249.1, 246.1, 22188322, 28216716),
    ("log", "2025-02"): ("gompertz", 93.5, 86.3, 76.2, 11490726, 59066034),
    ("log", "2025-06"): ("exponential", 37.6, 39.3, 42.9, 105657393, None),
    ("log", "2025-11"): ("logistic", 21.6, 5.6, 9.8, 20885335, 42472802),
}


@pytest.fixture(scope="module")
def series(spark):
    rows = []
    for i, (m, y, lo, hi) in enumerate(zip(MONTHS, Y, LO, HI)):
        sigma = 0.05 if m <= "2025-09" else max(0.10, (hi - lo) / (2 * y))
        rows.append(("focus", m, i, y, sigma, m == "2026-08"))
    return spark.createDataFrame(rows, "series_id string, month string, t long, y long, sigma double, partial boolean")


@pytest.fixture(scope="module")
def full(series):
    return G.fit_growth(series, [("lin", "2025-02", None)])


def test_full_window(full):
    for r in full.collect():
        amp, rate, shift, aic = FULL[r.model]
        assert r.n == 18
        assert r.amp == pytest.approx(amp, rel=1e-3) and r.rate == pytest.approx(rate, rel=1e-3)
        assert r.shift == pytest.approx(shift, rel=1e-3, abs=1e-9)
        assert r.aic == pytest.approx(aic, abs=1e-3)
    assert G.best_model(full).first().best_by_aic == "gompertz"


def test_hindcast_finds_runaway_ceilings(series):
    fits = {r.model: r for r in G.fit_growth(series, [("lin", "2025-02", "2026-03")]).collect()}
    assert {m: r.aic for m, r in fits.items()} == pytest.approx(HINDCAST_AIC, abs=1e-3)
    assert fits["logistic"].runaway and fits["gompertz"].runaway and not fits["exponential"].runaway
    assert fits["exponential"].doubling_months == pytest.approx(1.22013, abs=1e-4)
    later = G.hindcast(series, "2026-03", "2025-02").where("model = 'exponential' AND month = '2026-07'").first()
    assert later.predicted == pytest.approx(98478304, rel=1e-3) and later.observed == 19804129


def test_sensitivity(series):
    table, summary = G.sensitivity(series, ["2025-02", "2025-06", "2025-11"])
    rows = {(r.space, r.start): r for r in table.collect()}
    assert set(rows) == set(SENSITIVITY)
    for k, (best, ae, al, ag, cl, cg) in SENSITIVITY.items():
        r = rows[k]
        assert r.best == best
        assert (r.exponential_aic, r.logistic_aic, r.gompertz_aic) == pytest.approx((ae, al, ag), abs=0.051)
        assert r.logistic_ceiling == pytest.approx(cl, rel=1e-3)
        assert r.gompertz_ceiling == (None if cg is None else pytest.approx(cg, rel=1e-3))
    s = summary.first()
    assert (s.sigmoid_wins, s.configs) == (5, 6)
    assert s.ceiling_min == pytest.approx(11490726, rel=1e-3) and s.ceiling_max == pytest.approx(105657393, rel=1e-3)


def test_headline(spark, series, full):
    counts = S.headline_counts(series, ["series_id"])
    past = G.fit_growth(series, [("lin", "2025-02", "2026-03")])
    totals = spark.createDataFrame([("2026-07", 40_000_000), ("2026-06", 1)], "month string, total long")
    r = G.headline(counts, full, past, G.project(full, series), G.project(past, series), totals).first()
    assert (r.last_full_month, r.last_value, r.mom_pct, r.growth_multiple, r.cumulative) == ("2026-07", 19804129, 14, 825172, 96418643)
    assert (r.doubling_now, r.doubling_then, r.inflection_month) == (2.62, 1.22, "2026-04")
    assert r.logistic_pct == 88 and r.gompertz_pct == 67
    assert r.past_prediction == pytest.approx(98478304, rel=1e-3) and r.share_last_pct == pytest.approx(49.5)


def test_projection_axis(series, full):
    p = G.project(full, series).where("model = 'gompertz'").orderBy("t").collect()
    assert len(p) == 32 and p[-1].month == "2027-08" and p[19].month == "2026-08"
    assert p[-1].fitted == pytest.approx(29277289, rel=1e-3)


def test_too_short_series_fails_softly(spark):
    df = spark.createDataFrame([("x", "2025-02", 0, 5, 0.1, False), ("x", "2025-03", 1, 9, 0.1, False)],
                               "series_id string, month string, t long, y long, sigma double, partial boolean")
    rows = {r.model: r for r in G.fit_growth(df, [("lin", "2025-01", None)]).collect()}
    assert rows["logistic"].error and rows["logistic"].aic is None
    assert rows["exponential"].error is None


def test_a_zero_month_only_stops_logarithms(spark):
    rows = [("s", f"2025-{m:02d}", m - 1, 0 if m == 1 else 2 ** m, False, 0.1) for m in range(1, 9)]
    s = spark.createDataFrame(rows, "series_id string, month string, t long, y long, partial boolean, sigma double")
    fits = G.fit_growth(s, [("lin", "2025-01", None), ("log", "2025-01", None)]).collect()
    assert {(r.space, r.error is None) for r in fits} == {("lin", True), ("log", False)}
    assert [r.doubling_months for r in fits if r.space == "lin" and r.model == "exponential"] == [pytest.approx(1, rel=0.01)]
