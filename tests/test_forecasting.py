"""Models by criterion against series made by known rules."""

import numpy as np
from pyspark.sql import functions as F

from lathework.operators import forecasting as M
from lathework.operators import timeseries


def season(n, m=12, seed=1, noise=1.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 50 + 0.4 * t + 8 * np.sin(2 * np.pi * t / m) + rng.normal(0, noise, n)


def test_smoothing_states_follow_the_recursion():
    y = season(60)
    p = np.array([[0.3, 0.1, 0.2, 0.95], [0.7, 0.0, 0.1, 0.9]])
    for trend in M.TRENDS:
        for kind in M.SEASONS:
            sse, (level, growth, s) = M._states(y, trend, kind, 12, p)
            for k in range(2):
                one, (lv, gr, own) = M._states(y, trend, kind, 12, p[k : k + 1])
                assert np.allclose(sse[k], one[0]) and np.allclose(level[k], lv[0]) and np.allclose(s[:, k], own[:, 0])


def test_smoothing_chooses_trend_and_season():
    y = season(132)
    future = season(144)[132:]
    assert np.abs(M.ets(y, 12, 12) - future).mean() < 2.5
    flat = np.random.default_rng(2).normal(10, 1, 80)
    assert np.abs(M.ets(flat, 6) - 10).max() < 1.0
    rising = np.exp(season(96, noise=0.3) / 25)
    assert np.abs(M.ets(rising, 12, 12) / np.exp(season(108, noise=0.0) / 25)[96:] - 1).mean() < 0.12
    assert M.ets(np.array([1.0, 2.0, 3.0]), 2).shape == (2,)


def test_arima_finds_averages_differences_and_seasons():
    rng = np.random.default_rng(3)
    e = rng.normal(0, 1, 400)
    ma = 20 + e[1:] + 0.8 * e[:-1]
    found = M._hannan_rissanen(ma, [], [1])
    assert abs(found[1][1] - 0.8) < 0.12 and abs(found[0] - 1) < 0.25
    ar = np.zeros(400)
    for t in range(1, 400):
        ar[t] = 0.7 * ar[t - 1] + e[t]
    assert abs(M.sarima(ar, 30)[-1]) < 1.0
    walk = np.cumsum(e) + 0.3 * np.arange(400)
    assert M.kpss(walk) > 0.463 > M.kpss(e)
    assert abs(M.sarima(walk, 20)[-1] - (walk[-1] + 6)) < 4
    y = season(120)
    assert M.seasonal_strength(y, 12) > 0.64
    assert np.abs(M.sarima(y, 12, 12) - season(132)[120:]).mean() < 3
    assert M.sarima(np.array([1.0, 2.0, 1.5, 2.2]), 3).shape == (3,)


def test_bends_and_aggregated_demand():
    t = np.arange(150, dtype=float)
    y = np.where(t < 80, t, 80 - 0.5 * (t - 80))
    assert np.abs(M.changing_trend(y, 10, 1, ridge=0.01) - (80 - 0.5 * (150 + np.arange(10) - 80))).max() < 4
    assert np.abs(M.changing_trend(season(120), 12, 12) - season(132)[120:]).mean() < 3
    demand = np.zeros(120)
    demand[::4] = 8.0
    assert abs(M.imapa(demand, 3)[0] - 2.0) < 0.6 and M.imapa(np.zeros(9), 2).tolist() == [0, 0]


def test_several_seasons():
    t = np.arange(24 * 7 * 6)
    a, b = 5 * np.sin(2 * np.pi * t / 24), 3 * np.cos(2 * np.pi * t / 168)
    trend, seasons, rest = M.mstl(10 + 0.01 * t + a + b, [24, 168])
    assert np.abs(seasons[24] - a).mean() < 0.6 and np.abs(seasons[168] - b).mean() < 0.8 and np.abs(rest).mean() < 0.4
    assert M.mstl(np.arange(10.0), [24])[1] == {}


def test_backtests_and_coverage(spark):
    y = season(96)
    wide, rolling = timeseries.backtest(y, "ets", 6, 12, 3), timeseries.backtest(y, "seasonal_naive", 6, 12, window=36)
    assert wide["mase"] < 1 and 0 < rolling["mape"] < 0.5
    rows = spark.range(24 * 3 + 6).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).alias("at"))
    got = timeseries.coverage(rows.where("at <> timestamp_ntz'2024-01-02 05:00:00'"), "at", "day").orderBy("slot").collect()
    assert [(r.n, round(r.coverage, 3), r.partial) for r in got] == [(12, 0.5, True), (23, 0.958, False), (24, 1.0, False), (18, 0.75, True)]
