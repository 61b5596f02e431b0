"""Rolling kernels against every window looked at on its own."""

import numpy as np
import pytest

from quantloom.functions import kernels as K
from quantloom.functions import momentum as M
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.plans.pipeline import add_indicators

SIZES = (1, 2, 3, 5, 20, 60, 100)


def windows(x, n):
    return [x[max(0, i - n + 1) : i + 1] for i in range(len(x))]


@pytest.mark.parametrize("n", SIZES)
def test_kernels_equal_their_definition_at_every_length(n):
    rng = np.random.default_rng(n)
    for size in (0, 1, 2, n - 1, n, n + 1, 3 * n, 3 * n + 1, 500):
        x = rng.normal(1e4, 1, size)
        w = windows(x, n)
        assert np.allclose(K.rolling_sum(x, n), [v.sum() for v in w], rtol=1e-12)
        for op, f in ((np.maximum, max), (np.minimum, min)):
            assert K.rolling_extreme(x, n, op).tolist() == [f(v) for v in w]
        mean, dev = K.rolling_moments(x, n)
        assert np.allclose(mean, [v.mean() for v in w], rtol=1e-13)
        assert np.allclose(dev, [v.std() for v in w], atol=1e-9)
        if size >= n:
            assert np.allclose(K.rolling_wma(x, n)[n - 1 :], [(v * np.arange(1, n + 1)).sum() / (n * (n + 1) / 2) for v in w[n - 1 :]], rtol=1e-12)
            got = K.mean_deviation(x, K.rolling_sum(x, n) / n, n)
            assert np.isnan(got[: n - 1]).all()
            assert np.allclose(got[n - 1 :], [np.abs(v - v.mean()).mean() for v in w[n - 1 :]], atol=1e-9)


@pytest.mark.parametrize("n", (2, 5, 16, 20, 31, 32, 48))
def test_narrow_sums_add_whole_stretches_as_one_number(n):
    x = np.random.default_rng(n).normal(100, 30, 203).round(2)
    for size in (n - 1, n, 203):
        got = K.rolling_sum(x[:size], n)
        for i in range(n - 1, size):
            at, want = i - n + 1, 0.0
            while at <= i:
                step = K.STRETCH if at % K.STRETCH == 0 and at + K.STRETCH <= i + 1 else 1
                part = 0.0
                for v in x[at : at + step].tolist():
                    part += v
                want, at = want + part, at + step
            assert got[i] == want
    cut = 5 * K.STRETCH
    assert (K.rolling_sum(x[cut:], n)[n - 1 :] == K.rolling_sum(x, n)[cut + n - 1 :]).all()


@pytest.mark.parametrize("n", (4, 60))
def test_windows_of_equal_values_and_with_gaps(n):
    x = np.full(300, 33.3333333333)
    assert (K.rolling_moments(x, n)[1] == 0).all()
    assert (K.mean_deviation(x, K.rolling_sum(x, n) / n, n)[n - 1 :] == 0).all()
    rng = np.random.default_rng(1)
    x = rng.normal(100, 3, 300)
    x[rng.random(300) < 0.3] = np.nan
    x[100:180] = np.nan
    w = windows(x, n)
    some = np.array([(~np.isnan(v)).any() for v in w])
    for got, f in ((K.window_mean(x, n), np.nanmean), (K.window_extreme(x, n, np.maximum), np.nanmax), (K.window_moments(x, n)[1], np.nanstd), (K.window_sum(x, n), np.nansum)):
        assert (np.isnan(got) == ~some).all()
        assert np.allclose(got[some], [f(v) for v, s in zip(w, some) if s], atol=1e-9)


def test_ties_and_long_runs_in_the_order_tree():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, 5000).astype(float)
    n = 130
    got = K.mean_deviation(x, K.rolling_sum(x, n) / n, n)
    assert np.allclose(got[n - 1 :], [np.abs(v - v.mean()).mean() for v in windows(x, n)[n - 1 :]], atol=1e-9)


def test_wide_indicators_are_the_same_as_columns(spark):
    rng = np.random.default_rng(3)
    n = 400
    c = 50 + np.cumsum(rng.normal(size=n))
    rows = [(s, i, 0, float(x), float(x + rng.random()), float(x - rng.random()), None if i % 97 == 5 else float(x), 5.0) for s in "ab" for i, x in enumerate(c)]
    df = spark.createDataFrame(rows, "symbol string, ts int, seq int, open double, high double, low double, close double, volume double")
    wanted = {"sma": T.Sma(60), "bo": V.Bollinger(70, 2.0), "std": V.Std(55), "don": V.Donchian(80), "wr": M.WilliamsR(90), "st": M.Stochastic(60, 5), "ich": T.Ichimoku(9, 26, 60), "cci": M.Cci(100)}
    whole = {k: v for k, v in wanted.items() if k not in ("cci", "wr", "st")}  # these look at bars whose close is missing
    a, b = (add_indicators(df, whole, wide=w).orderBy("symbol", "ts").toPandas() for w in (48, 10**9))
    full = df.where("close IS NOT NULL")
    p, q = (add_indicators(full, wanted, wide=w).orderBy("symbol", "ts").toPandas() for w in (48, 10**9))
    for u, v in ((a, b), (p, q)):
        assert list(u.columns) == list(v.columns)
        for x in u.columns[3:]:
            assert np.allclose(u[x].to_numpy(float), v[x].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), x
    plan = add_indicators(df, whole)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange hashpartitioning") == 1
