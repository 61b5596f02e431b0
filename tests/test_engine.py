"""Batch against bar-by-bar results, hand-computed values, edge series, planning and errors."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import momentum as M
from quantloom.functions import patterns as P
from quantloom.functions import signals as S
from quantloom.functions import sizing as Z
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.operators.recurrence import ema, linear, wilder_mean
from quantloom.plans.pipeline import add_indicators
from quantloom.schema import Bars

COLS = ["symbol", "ts", "seq", "open", "high", "low", "close", "volume"]
WANTED = {
    "sma": T.Sma(5), "wma": T.Wma(7), "wide": T.Wma(70), "hma": T.Hma(9), "ema": T.Ema(6), "ema0": T.Ema(6, initial=40.0), "dema": T.Dema(4), "tema": T.Tema(4), "macd": T.Macd(5, 9, 4), "adx": T.Adx(7),
    "sar": T.ParabolicSar(), "ichi": T.Ichimoku(4, 6, 12), "pc": T.Pivots("classic"), "pf": T.Pivots("fibonacci"), "pv": T.Pivots("camarilla"), "ha": T.HeikinAshi(), "rsi": M.Rsi(7), "st": M.Stochastic(7, 3),
    "wr": M.WilliamsR(7), "cci": M.Cci(7), "roc": M.Roc(4), "atr": V.Atr(7), "std": V.Std(6), "bb": V.Bollinger(6), "kel": V.Keltner(8, 5), "kw": V.Keltner(5, 8, 2.0, "windowed"), "kp": V.KeltnerPrice(5, 7),
    "don": V.Donchian(6), "obv": U.Obv(), "vroc": U.Vroc(4), "adl": U.Adl(), "cmf": U.Cmf(6), "mfi": U.Mfi(6), "vwap": U.Vwap(),
}


def walk(symbol, n, seed, flat=None):
    rng = np.random.default_rng(seed)
    c = 50 + np.cumsum(rng.normal(size=n))
    o = np.r_[c[0], c[:-1]]
    h, l = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    if flat:
        for x in (o, h, l, c):
            x[flat[0] : flat[1]] = c[flat[0]]
    v = rng.integers(1, 50, n).astype(float)
    return [(symbol, i, 0, *map(float, x)) for i, x in enumerate(zip(o, h, l, c, v))]


def frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=COLS))


def closes(spark, xs, symbol="a"):
    return frame(spark, [(symbol, i, 0, x, x + 1.0, x - 1.0, x, 10.0) for i, x in enumerate(map(float, xs))])


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, walk("a", 160, 1) + walk("b", 90, 2, (5, 40)) + walk("short", 4, 3)).repartition(5).cache()


@pytest.fixture(scope="module")
def wide(bars):
    return add_indicators(bars, WANTED).toPandas().sort_values(["symbol", "ts"])


def none(x):
    return x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x))


def test_batch_equals_bar_by_bar(wide):
    for _, g in wide.groupby("symbol"):
        states = {a: i.start() for a, i in WANTED.items()}
        for r in g.to_dict("records"):
            for a, i in WANTED.items():
                y = states[a].next(r)
                for o, n in zip(i.outputs, i.names(a)):
                    got, want = r[n], None if y is None else y[o]
                    assert none(got) == none(want), (n, r["symbol"], r["ts"], got, want)
                    assert none(got) or got == pytest.approx(want, abs=1e-8, rel=1e-8), n


def test_reset_starts_afresh(wide):
    g = wide[wide.symbol == "a"].to_dict("records")[:40]
    for i in WANTED.values():
        s = i.start()
        once = [s.next(r) for r in g]
        s.reset()
        assert str([s.next(r) for r in g]) == str(once)


def test_first_value_position(wide):
    first = {"sma": 4, "wma": 6, "hma": 10, "ema": 0, "dema": 6, "tema": 9, "macd_macd": 0, "adx_adx": 13, "sar": 1, "ichi_kijun": 11, "rsi": 7, "st_d": 8, "wr": 6, "cci": 6, "atr": 6, "std": 5, "bb_upper": 5, "kel_middle": 7, "kp": 7, "don_upper": 5, "obv": 0, "vroc": 4, "adl": 0, "cmf": 5, "mfi": 6, "vwap": 0}
    g = wide[wide.symbol == "a"].reset_index()
    for n, at in first.items():
        assert g[n].first_valid_index() == at, n


def test_rows_order_and_other_symbols_do_not_matter(bars, wide):
    again = add_indicators(bars.where("symbol = 'a'").orderBy(F.desc("close")), WANTED).toPandas().sort_values("ts")
    own = wide[wide.symbol == "a"]
    for n in [x for a, i in WANTED.items() for x in i.names(a)]:
        np.testing.assert_allclose(again[n].to_numpy(float, na_value=np.nan), own[n].to_numpy(float, na_value=np.nan), atol=1e-9)


def test_known_values(spark):
    got = add_indicators(closes(spark, [1, 2, 3, 4, 5]), {"sma": T.Sma(3), "ema": T.Ema(3), "wma": T.Wma(3), "std": V.Std(2), "obv": U.Obv(), "roc": M.Roc(1)}).orderBy("ts").toPandas()
    assert got.sma.tolist()[2:] == [2, 3, 4] and got.ema.tolist() == [1, 1.5, 2.25, 3.125, 4.0625]
    assert got.wma.tolist()[2:] == pytest.approx([14 / 6, 20 / 6, 26 / 6]) and got["std"].tolist()[1:] == [0.5] * 4
    assert got.obv.tolist() == [0, 10, 20, 30, 40] and got.roc.tolist()[1] == 100


def test_flat_series(spark):
    flat = frame(spark, [("f", i, 0, 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(30)])
    got = add_indicators(flat, {"rsi": M.Rsi(5), "cci": M.Cci(5), "mfi": U.Mfi(5), "wr": M.WilliamsR(5), "st": M.Stochastic(5, 2), "adx": T.Adx(5), "std": V.Std(5), "adl": U.Adl(), "cmf": U.Cmf(5)}).orderBy("ts").toPandas().iloc[-1]
    assert (got.rsi, got.cci, got.mfi, got.wr, got.st_k, got.adx_adx, got["std"], got.adl, got.cmf) == (50, 0, 50, -50, 50, 0, 0, 0, 0)
    early = add_indicators(flat, {"adx": T.Adx(5)}).orderBy("ts").toPandas()
    assert early.adx_adx.first_valid_index() == 5


def test_rising_and_falling(spark):
    up = add_indicators(closes(spark, range(1, 40)), {"rsi": M.Rsi(14), "mfi": U.Mfi(14), "sar": T.ParabolicSar()}).orderBy("ts").toPandas()
    assert up.rsi.iloc[-1] == 100 and up.mfi.iloc[-1] == 100 and (up.sar.iloc[1:] < up.close.iloc[1:]).all()
    down = add_indicators(closes(spark, range(40, 1, -1)), {"rsi": M.Rsi(14), "sar": T.ParabolicSar()}).orderBy("ts").toPandas()
    assert down.rsi.iloc[-1] == 0 and (down.sar.iloc[1:] > down.close.iloc[1:]).all()


def test_invalid_bars(spark):
    df = frame(spark, [("z", i, 0, 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(8)])
    got = add_indicators(df, {"vroc": U.Vroc(2), "cmf": U.Cmf(3), "vwap": U.Vwap()}).toPandas()
    assert got.vroc.isna().all() and got.cmf.isna().all() and (got.vwap == 5).all()
    for i in (U.Vroc(2, "raise"), U.Cmf(3, "raise"), U.Adl("raise")):
        with pytest.raises(Exception, match="volume is 0|no range"):
            add_indicators(df, {"x": i}).collect()


def test_short_series(spark):
    df = closes(spark, [1, 2, 3])
    assert add_indicators(df, {"rsi": M.Rsi(14), "sma": T.Sma(5), "adx": T.Adx(14)}).select("rsi", "sma", "adx_adx").distinct().collect() == [(None, None, None)]
    with pytest.raises(Exception, match="fewer than 15 bars"):
        add_indicators(df, {"rsi": M.Rsi(14)}, on_short="raise").collect()
    assert add_indicators(df.limit(0), WANTED).count() == 0


@pytest.mark.parametrize("make", [lambda: T.Sma(0), lambda: T.Hma(1), lambda: T.Macd(9, 5, 3), lambda: T.Ichimoku(9, 8, 52), lambda: T.ParabolicSar(0.3, 0.02, 0.2), lambda: V.Bollinger(5, 0), lambda: V.Keltner(5, 5, -1), lambda: M.Rsi(0), lambda: U.Cmf(0), lambda: S.Divergence(0), lambda: T.Pivots("woodie"), lambda: U.Adl("zero")])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_names_and_periods():
    assert T.Sma(5).name == "sma" and T.Sma(5).period is None and T.Wma(5).period == 5 and M.WilliamsR(5).name == "williams_r"
    assert V.Bollinger(5).names("bb") == ["bb_middle", "bb_upper", "bb_lower", "bb_bandwidth"]


def test_clashing_outputs(bars):
    with pytest.raises(ValueError):
        add_indicators(bars, {"close": T.Sma(3)})
    with pytest.raises(ValueError, match="missing"):
        add_indicators(bars.drop("high"), {"x": T.Sma(3)})


def test_column_mapping(spark):
    c = Bars(symbol="s", ts="t", seq="q", open="o", high="h", low="l", close="c", volume="v")
    df = closes(spark, [1, 2, 3, 4]).toDF(*c.names)
    assert add_indicators(df, {"m": T.Sma(2), "e": T.Ema(2), "a": V.Atr(2)}, c=c).orderBy("t").select("m").collect()[1][0] == 1.5


def test_one_shuffle_and_pruned_scan(bars, tmp_path):
    path = f"{tmp_path}/bars"
    bars.withColumn("unused", F.lit(1)).write.parquet(path)
    df = add_indicators(bars.sparkSession.read.parquet(path).select(*COLS), {"sma": T.Sma(5), "bb": V.Bollinger(6), "rsi": M.Rsi(5), "macd": T.Macd()})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "unused" not in plan.split("ReadSchema")[1]


def test_symbol_filter_reaches_the_scan(bars, tmp_path):
    path = f"{tmp_path}/bars"
    bars.write.parquet(path)
    df = add_indicators(bars.sparkSession.read.parquet(path), {"sma": T.Sma(5)}).where("symbol = 'a'")
    assert "EqualTo(symbol,a)" in df._jdf.queryExecution().executedPlan().toString()


def test_recurrences():
    x = np.random.default_rng(0).normal(size=200)
    y = [x[0]]
    for v in x[1:]:
        y.append(2 / 11 * v + 9 / 11 * y[-1])
    np.testing.assert_allclose(ema(x, 10), y, atol=1e-12)
    w = wilder_mean(x, 7)
    z = x[:7].mean()
    for i, v in enumerate(x[7:], 7):
        z = (z * 6 + v) / 7
        assert w[i] == pytest.approx(z, abs=1e-12)
    assert np.isnan(w[:6]).all() and np.isnan(wilder_mean(x[:3], 7)).all()
    assert np.isnan(linear(np.array([1.0, np.nan, 2.0]), 0.5)).tolist() == [False, True, True]


# --- signals --------------------------------------------------------------------------------


def signal(spark, pairs, make):
    df = spark.createDataFrame([("s", i, 0, *p) for i, p in enumerate(pairs)], "symbol string, ts long, seq long, " + ", ".join(f"{n} double" for n in "abc"[: len(pairs[0])]))
    return [r[0] for r in df.select("ts", make().alias("x")).orderBy("ts").select("x").collect()]


def test_crosses_and_thresholds(spark):
    pairs = [(1.0, 2.0), (3.0, 2.0), (4.0, 2.0), (1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (float("nan"), 2.0), (3.0, 2.0)]
    assert signal(spark, pairs, lambda: S.cross_up("a", "b")) == [None, "LONG", "HOLD", "HOLD", "HOLD", "LONG", "HOLD", "HOLD"]
    assert signal(spark, pairs, lambda: S.cross_down("a", "b"))[:4] == [None, "HOLD", "HOLD", "SHORT"]
    assert signal(spark, pairs, lambda: S.threshold_above("a", 2))[:6] == [None, "LONG", "HOLD", "HOLD", "HOLD", "LONG"]
    assert signal(spark, pairs, lambda: S.threshold_below("a", 2))[:4] == [None, "HOLD", "HOLD", "SHORT"]


def test_breakout_must_come_back(spark):
    rows = [(5.0, 10.0, 0.0), (11.0, 10.0, 0.0), (12.0, 10.0, 0.0), (5.0, 10.0, 0.0), (-1.0, 10.0, 0.0)]
    assert signal(spark, rows, lambda: S.breakout("a", "b", "c")) == [None, "LONG", "HOLD", "HOLD", "SHORT"]


def test_combinators(spark):
    events = ["LONG", "SHORT", "EXIT", "HOLD", None]
    df = spark.createDataFrame([(a, b) for a in events for b in events], "a string, b string")
    for r in df.select("a", "b", S.both(F.col("a"), F.col("b")).alias("x"), S.either(F.col("a"), F.col("b")).alias("y"), S.inverse(F.col("a")).alias("z")).collect():
        pair = (r.a, r.b)
        assert r.x == ("EXIT" if "EXIT" in pair else None if None in pair else r.a if r.a == r.b and r.a in ("LONG", "SHORT") else "HOLD")
        assert r.y == next((e for e in events if e in pair and e), None)
        assert r.z == {"LONG": "SHORT", "SHORT": "LONG"}.get(r.a, r.a)


def test_divergence_against_a_loop(spark):
    rng = np.random.default_rng(8)
    p, o = rng.integers(0, 30, 400).astype(float), rng.normal(size=400)
    for n in (1, 2, 3):
        want, hi, lo = [], None, None
        for t in range(400):
            if t < 2 * n:
                want.append(None)
                continue
            c, event = t - n, "HOLD"
            others = [p[i] for i in range(t - 2 * n, t + 1) if i != c]
            if all(p[c] > x for x in others):
                if hi is not None and c - hi >= n + 1 and p[c] > p[hi] and o[c] < o[hi]:
                    event = "SHORT"
                hi = c
            if all(p[c] < x for x in others):
                if lo is not None and c - lo >= n + 1 and p[c] < p[lo] and o[c] > o[lo]:
                    event = "LONG"
                lo = c
            want.append(event)
        df = spark.createDataFrame([("s", i, 0, float(a), float(b)) for i, (a, b) in enumerate(zip(p, o))], "symbol string, ts long, seq long, price double, osc double")
        assert [r[0] for r in S.Divergence(n).apply(df, "price", "osc").orderBy("ts").select("divergence").collect()] == want
        assert {"LONG", "SHORT"} <= set(want)


# --- patterns, sizing -----------------------------------------------------------------------

SHAPES = {
    "doji": [(10, 12, 8, 10.1)], "hammer": [(10, 11.1, 7, 11)], "inverted_hammer": [(10, 14, 9.9, 11)], "bullish_marubozu": [(10, 20, 10, 20)], "bearish_marubozu": [(20, 20, 10, 10)],
    "bullish_engulfing": [(12, 12.5, 9.5, 10), (9, 13.5, 8.5, 13)], "bearish_engulfing": [(10, 12.5, 9.5, 12), (13, 13.5, 8.5, 9)],
    "bullish_harami": [(20, 21, 9, 10), (12, 16, 11, 15)], "bearish_harami": [(10, 21, 9, 20), (18, 19, 12, 15)],
    "morning_star": [(20, 21, 9, 10), (9, 11, 7, 9.5), (10, 19, 9, 18)], "evening_star": [(10, 21, 9, 20), (21, 23, 19, 20.5), (20, 21, 11, 12)],
    "three_white_soldiers": [(10, 13, 9, 12), (11, 15, 10, 14), (13, 17, 12, 16)], "three_black_crows": [(16, 17, 13, 14), (15, 16, 11, 12), (13, 14, 9, 10)],
}


def test_patterns(spark):
    rows = [(n, i, 0, *map(float, b), 1.0) for n, bars in SHAPES.items() for i, b in enumerate(bars)] + [("dot", i, 0, 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(3)]
    got = {r.symbol: [p.kind for p in r.patterns] for r in P.scan(frame(spark, rows)).orderBy("ts").collect()}
    for n in SHAPES:
        assert n in got[n], (n, got[n])
    assert not {"doji", "hammer", "bullish_marubozu"} & set(got["dot"])
    assert {n for n, _ in P.SCAN} == set(SHAPES)
    loose = P.scan(frame(spark, rows), cfg=P.PatternConfig(doji_body=0.9))
    assert "doji" in [p.kind for p in loose.where("symbol = 'hammer'").first().patterns]


def test_sizing(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    x = lambda *v: [F.lit(float(y)) for y in v]
    assert one(Z.kelly(*x(0.6, 2, 1))) == pytest.approx(0.4) and one(Z.kelly(*x(0.2, 1, 1))) == 0 and one(Z.kelly(*x(1.2, 1, 1))) == 0 and one(Z.kelly(*x(0.5, 0, 1))) == 0
    assert one(Z.fractional_kelly(*x(0.6, 2, 1, 0.5))) == pytest.approx(0.2) and one(Z.fractional_kelly(*x(0.6, 2, 1, math.inf))) == 0
    assert one(Z.fixed_fractional(*x(2))) == 1 and one(Z.fixed_fractional(*x(-1))) == 0 and one(Z.fixed_fractional(*x(math.nan))) == 0
    assert one(Z.risk_based(*x(10000, 0.01, 50, 48))) == 50 and one(Z.risk_based(*x(10000, 0.01, 50, 50))) == 0 and one(Z.risk_based(*x(10000, 0.01, 50, -1))) == 0
    assert one(Z.volatility_targeted(*x(10000, 0.1, 20))) == 50 and one(Z.volatility_targeted(*x(10000, 0.1, 0))) == 0
