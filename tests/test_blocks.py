"""Time blocks against undivided symbols; as-of joins, sessions and stored states against plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import momentum as M
from quantloom.functions import signals as S
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.functions.sessions import Calendar, Gap, gap_session_bars, with_sessions
from quantloom.operators import backtest as B
from quantloom.operators import block_backtest as K
from quantloom.operators import blocks as X
from quantloom.operators.asof import asof
from quantloom.plans.pipeline import add_indicators
from quantloom.plans.resumable import advance, runs
from quantloom.schema import Bars

WANTED = {
    "sma": T.Sma(20), "wma": T.Wma(7), "wma2": T.Wma(100), "hma": T.Hma(9), "std": V.Std(10), "bo": V.Bollinger(20, 2.0), "don": V.Donchian(20), "ich": T.Ichimoku(), "wr": M.WilliamsR(14), "st": M.Stochastic(14, 3),
    "cci": M.Cci(20), "cci2": M.Cci(80), "roc": M.Roc(10), "vroc": U.Vroc(5), "cmf": U.Cmf(20), "mfi": U.Mfi(14), "pv": T.Pivots("camarilla"), "pc": T.Pivots("classic"), "ema": T.Ema(10), "emi": T.Ema(10, initial=90.0),
    "dema": T.Dema(5), "tema": T.Tema(5), "macd": T.Macd(), "rsi": M.Rsi(14), "atr": V.Atr(14), "kel": V.Keltner(20, 10, 2.0), "kp": V.KeltnerPrice(20, 10), "ha": T.HeikinAshi(), "obv": U.Obv(), "adl": U.Adl(), "vwap": U.Vwap(),
    "adx": T.Adx(14), "adx2": T.Adx(60), "sar": T.ParabolicSar(),
}


def walk(symbol, n, rng):
    """A random walk that stands still every so often."""
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    o = np.append(c[0], c[:-1])
    h, l = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    still = (np.arange(n) // 50) % 11 == 3
    for x in (o, h, l, c):
        x[still] = 50.0
    return pd.DataFrame({"symbol": symbol, "ts": np.arange(n) * 60, "seq": 0, "open": o, "high": h, "low": l, "close": c, "volume": rng.integers(1, 100, n).astype(float)})


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame(pd.concat([walk("a", 4000, rng), walk("b", 300, rng), walk("c", 1500, rng)])).repartition(3).cache()


def same(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for x in a.columns:
        if a[x].dtype.kind in "fiu" or str(a[x].dtype).startswith(("Float", "Int")):
            assert np.allclose(a[x].to_numpy(float), b[x].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), x
        else:
            assert a[x].fillna("-").tolist() == b[x].fillna("-").tolist(), x


def test_every_indicator_in_blocks(bars, monkeypatch):
    monkeypatch.setattr(X, "RUN_IN", 60)  # short enough for stops to begin in wrong states
    same(add_indicators(bars, WANTED), X.add_indicators_blocked(bars, WANTED, block_bars=500), ["symbol", "ts"])


def test_blocks_are_of_bounded_size_and_whole(spark, bars, tmp_path):
    got, hot = X.cut(bars, f"file://{tmp_path}", 500)
    assert hot
    sizes = got.groupBy("symbol", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")).orderBy("symbol", "low").collect()
    assert all(250 <= r["n"] <= 1000 for r in sizes)
    assert {r["symbol"]: r["__block"] for r in sizes}["b"] == 0
    for p, q in zip(sizes, sizes[1:]):
        assert p["symbol"] != q["symbol"] or (p["high"] < q["low"] and q["__block"] == p["__block"] + 1)


def test_signals_in_blocks(bars):
    L, c = S.LiveSignal, Bars()
    sig = {"cu": L("cross_up", ((T.Sma(5), ""), (T.Sma(20), ""))), "cd": L("cross_down", ((T.Ema(5), ""), (T.Ema(20), ""))), "ta": L("threshold_above", ("close",), level=101.0),
           "tb": L("threshold_below", ((M.Rsi(14), ""),), level=45.0), "bo": L("breakout", ("close", (V.Donchian(10), "upper", 1), (V.Donchian(10), "lower", 1)))}
    sig |= {"ei": L("either", legs=(sig["cu"], sig["tb"])), "bth": L("both", legs=(sig["cu"], sig["ta"])), "inv": L("inverse", legs=(sig["cd"],))}
    q = add_indicators(bars, {"f": T.Sma(5), "s": T.Sma(20), "ef": T.Ema(5), "es": T.Ema(20), "r": M.Rsi(14), "d": V.Donchian(10)})
    q = q.withColumns({"du": F.lag("d_upper").over(c.window()), "dl": F.lag("d_lower").over(c.window())})
    q = q.withColumns({"cu": S.cross_up("f", "s"), "cd": S.cross_down("ef", "es"), "ta": S.threshold_above("close", 101.0), "tb": S.threshold_below("r", 45.0), "bo": S.breakout("close", "du", "dl")})
    q = q.withColumns({"ei": S.either(F.col("cu"), F.col("tb")), "bth": S.both(F.col("cu"), F.col("ta")), "inv": S.inverse(F.col("cd"))})
    same(q.select(*bars.columns, *sig), X.add_indicators_blocked(bars, sig, block_bars=500), ["symbol", "ts"])


def test_sums_do_not_depend_on_the_blocks(bars):
    """To the last bit: what is equal in one block must not cross in another."""
    wanted = {x: WANTED[x] for x in ("sma", "wma", "wma2", "st", "cmf", "mfi")} | {"sma2": T.Sma(60), "sma3": T.Sma(1), "cmf2": U.Cmf(70)}
    names = [n for a, i in wanted.items() for n in i.names(a)]
    runs = [X.add_indicators_blocked(bars, wanted, block_bars=n).orderBy("symbol", "ts").select(*names).collect() for n in (400, 701, 10_000)]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize(("quantity", "config"), [
    (B.Quantity(), B.Config(fee=0.001, slippage=0.0005)), (B.Quantity("percent_cash", 0.3), B.Config(fee=0.001, short_mtm="reference")),
    (B.Quantity("fixed", 40.0), B.Config(fee=0.001)), (B.Quantity(), B.Config(affordability="strict")), (B.Quantity(), B.Config(cash=0.0)),
])
def test_backtests_in_blocks(bars, quantity, config):
    rng = np.random.default_rng(7)
    pdf = bars.toPandas()
    pdf["action"] = rng.choice(["HOLD", "ENTER_LONG", "ENTER_SHORT", "EXIT"], len(pdf), p=[0.97, 0.01, 0.01, 0.01])
    pdf["close"] = np.abs(pdf["close"]) + 1
    df = bars.sparkSession.createDataFrame(pdf)
    a, b = B.run(df, quantity=quantity, config=config), K.run_blocked(df, quantity=quantity, config=config, block_bars=500)
    for name, keys in (("equity", ["symbol", "bar"]), ("trades", ["symbol", "trade"]), ("metrics", ["symbol"])):
        same(getattr(a, name), getattr(b, name), keys)


def test_a_broke_account_stays_broke_across_blocks(spark):
    """A short that loses more than all cash: nothing opens after it, in whatever block."""
    n = 4000
    close = np.where(np.arange(n) < 900, 10.0, 100.0)
    action = ["HOLD"] * n
    action[5], action[1500], action[2500], action[3500] = "ENTER_SHORT", "EXIT", "ENTER_LONG", "ENTER_SHORT"
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": range(n), "seq": range(n), "open": close, "high": close, "low": close, "close": close, "volume": 1.0, "action": action}))
    a, b = B.run(df), K.run_blocked(df, block_bars=500)
    same(a.equity, b.equity, ["bar"])
    assert b.metrics.first()["trade_count"] == 1


def test_what_blocks_cannot_do_is_refused(bars):
    for bad in (T.Ichimoku(displace=True), V.Keltner(atr_mode="windowed"), U.Adl(on_invalid="null"), S.LiveSignal("cross_up", ((T.Adx(5), "adx"), "close"))):
        with pytest.raises(ValueError, match="not known in time blocks"):
            X.add_indicators_blocked(bars, {"x": bad})
    with pytest.raises(ValueError, match="sessions"):
        X.add_indicators_blocked(bars.withColumn("s", F.lit(1)), {"x": T.Sma(3)}, c=Bars(session="s"))


def test_empty_and_short_tables_in_blocks(bars):
    none = bars.where("false")
    assert X.add_indicators_blocked(none, {"x": T.Sma(3), "y": T.Ema(3)}).collect() == []
    assert K.run_blocked(none.withColumn("action", F.lit("HOLD"))).metrics.collect() == []
    few = bars.where("symbol = 'b' AND ts < 120")
    assert [r["x"] for r in X.add_indicators_blocked(few, {"x": T.Sma(3)}).collect()] == [None, None]


# --- as-of ----------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"tolerance": 2.0}, {"exact": False}, {"block_rows": 300}, {"block_rows": 300, "exact": False, "tolerance": 3.0}, {"by": ()}, {"by": (), "block_rows": 200}])
def test_asof_against_all_pairs(spark, options):
    rng = np.random.default_rng(11)

    def rows(n):
        return [(k, int(t), i) for i, (k, t) in enumerate(zip(rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), rng.integers(0, 2000, n)))]

    left, right = rows(700), rows(2500)
    left[3] = ("a", None, 3)
    right[4] = ("a", None, 4)
    schema = "symbol string, ts long, seq long"
    got = asof(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), **options)
    want = []
    for k, t, i in left:
        fit = [(u, j) for m, u, j in right if t is not None and u is not None and (options.get("by") == () or m == k) and (u < t or (u == t and options.get("exact", True)))]
        best = max(fit, default=None)
        if best and t - best[0] > options.get("tolerance", 10**9):
            best = None
        want.append((i, best and best[1]))
    assert sorted((r["seq"], r["right_seq"]) for r in got.collect()) == sorted(want)


def test_asof_has_one_exchange_of_rows_and_no_join(spark):
    df = spark.createDataFrame([("a", 1, 1)], "symbol string, ts long, seq long")
    plan = asof(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert asof(df.where("false"), df).count() == 0
    assert asof(df, df.where("false")).first()["right_seq"] is None
    with pytest.raises(ValueError, match="another prefix"):
        asof(df, df, prefix="", by=())


# --- sessions -------------------------------------------------------------------------------


def test_calendar_and_gap_sessions(spark):
    hours = [0, 1, 5, 22, 23, 24, 25, 30, 49, 60]
    rows = [("a", pd.Timestamp(h * 3600, unit="s"), 0, 1.0, 2.0 + h, 0.5, 1.5, 1.0 + h) for h in hours]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "seq", "open", "high", "low", "close", "volume"]))
    day = with_sessions(df, Calendar(24)).orderBy("ts").collect()
    assert [r["session"].day for r in day] == [1, 1, 1, 1, 1, 2, 2, 2, 3, 3]
    shifted = with_sessions(df, Calendar(24, 23)).orderBy("ts").collect()
    assert len({r["session"] for r in shifted}) == 3 and shifted[4]["session"].hour == 23
    rule = Gap(240)
    begun = [r["session"] for r in with_sessions(df, rule).orderBy("ts").collect()]
    assert [b.timestamp() // 3600 for b in begun] == [0, 0, 0, 22, 22, 22, 22, 30, 49, 60]
    merged = gap_session_bars(df, rule).orderBy("session").collect()
    assert [r["bars"] for r in merged] == [3, 4, 1, 1, 1] and merged[1]["high"] == 27.0
    assert [rule.begins(a * 3.6e6, b * 3.6e6) for a, b in zip(hours, hours[1:])] == [a != b for a, b in zip(begun, begun[1:])]
    assert [Calendar(24).begins(a * 3.6e6, b * 3.6e6) for a, b in zip(hours, hours[1:])] == [a["session"] != b["session"] for a, b in zip(day, day[1:])]
    out = add_indicators(with_sessions(df, rule), {"ema": T.Ema(3), "sma": T.Sma(2), "vwap": U.Vwap()}, c=Bars(session="session")).orderBy("ts").collect()
    assert [r["sma"] is None for r in out] == [True, False, False, True, False, False, False, True, True, True]
    with pytest.raises(ValueError):
        Gap(0)


# --- stored states --------------------------------------------------------------------------


def test_day_by_day_is_all_at_once(spark, bars, tmp_path):
    pdf = bars.where("symbol <> 'a' AND ts < 18000").toPandas()
    pdf["ts"] = pd.to_datetime(pdf["ts"], unit="s")
    df = spark.createDataFrame(pdf)
    wanted = {k: v for k, v in WANTED.items() if k not in ("wma2", "cci2")} | {"cu": S.LiveSignal("cross_up", ((T.Sma(5), ""), (T.Ema(9), "")))}
    folder = f"file://{tmp_path}/states"
    got = [advance(df.where(F.col("ts") < F.lit(pd.Timestamp(s, unit="s"))), wanted, folder) for s in (3000, 3060, 9000, 9000, 18000)]
    assert [g.count() for g in got] == [100, 2, 198, 0, 300]
    plain = {k: v for k, v in wanted.items() if k != "cu"}
    rows = got[0].unionAll(got[1]).unionAll(got[2]).unionAll(got[4])
    same(add_indicators(df, plain), rows.drop("cu"), ["symbol", "ts"])
    assert {r[0] for r in rows.select("cu").distinct().collect()} == {None, "HOLD", "LONG"}
    assert len(runs(spark, folder)) == 5
    with pytest.raises(ValueError, match="other indicators"):
        advance(df, {"sma": T.Sma(9)}, folder)


def test_a_run_reads_new_bars_only(spark, tmp_path):
    df = spark.range(2000).selectExpr("'a' AS symbol", "timestamp_seconds(id) AS ts", "id AS seq", *[f"double(id) AS {x}" for x in ("open", "high", "low", "close", "volume")])
    for part in (0, 1000):
        df.where(f"seq >= {part} AND seq < {part + 1000}").coalesce(1).write.parquet(f"{tmp_path}/bars/part={part}")
    table = spark.read.parquet(f"{tmp_path}/bars").drop("part")
    folder = f"file://{tmp_path}/states"
    advance(table.where("seq < 1000"), {"sma": T.Sma(3)}, folder)
    out = advance(table, {"sma": T.Sma(3)}, folder)
    assert (out.count(), out.agg(F.min("seq")).first()[0]) == (1000, 1000)
