"""Backtests, CSV and Parquet, resampling, streaming parity, and registered queries against SQL."""

import glob
import importlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quantloom.functions import momentum as M
from quantloom.functions import patterns as P
from quantloom.functions import signals as S
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.operators import backtest as B
from quantloom.plans.pipeline import add_indicators
from quantloom.schema import Bars
from quantloom.sources import bars as IO
from quantloom.streaming.live import live_bars, live_indicators
from tests.test_engine import COLS, closes, frame, walk

SF = "/root/testdata/sf0.001"


def ramp(spark, actions, prices=None):
    prices = prices or list(range(1, len(actions) + 1))
    df = closes(spark, prices).drop("seq").withColumn("seq", F.col("ts"))
    a = spark.createDataFrame([(i, x) for i, x in enumerate(actions)], "ts long, action string")
    return df.join(a, "ts")


L, SH, X, H = B.ENTER_LONG, B.ENTER_SHORT, B.EXIT, B.HOLD


def test_buy_and_hold(spark):
    r = B.run(ramp(spark, [L, H, H, H, H]), config=B.Config(cash=100))
    assert [x.equity for x in r.equity.orderBy("bar").collect()] == [100, 200, 300, 400, 500] and r.trades.count() == 0
    m = r.metrics.first()
    assert (m.final_equity, m.total_return, m.max_drawdown, m.trade_count, m.win_rate, m.profit_factor) == (500, 4, 0, 0, 0, 0)


def test_fees_slippage_and_flip(spark):
    c = B.Config(cash=1000, fee=0.01, slippage=0.1)
    r = B.run(ramp(spark, [L, H, SH, H, X], [10, 10, 20, 20, 10]), quantity=B.Quantity("fixed", 2.0), config=c)
    t = r.trades.orderBy("trade").collect()
    assert [x.side for x in t] == ["LONG", "SHORT"]
    assert t[0].pnl == pytest.approx(2 * (18 - 11) - 0.01 * 2 * (11 + 18)) and t[1].pnl == pytest.approx(2 * (18 - 11) - 0.01 * 2 * (18 + 11))
    assert r.metrics.first().final_equity == pytest.approx(1000 + t[0].pnl + t[1].pnl) and r.metrics.first().profit_factor == float("inf")


def test_short_valuation(spark):
    df = ramp(spark, [SH, H, H], [10, 10, 5])
    q = B.Quantity("fixed", 1.0)
    assert [x.equity for x in B.run(df, quantity=q, config=B.Config(cash=100)).equity.orderBy("bar").collect()] == [100, 100, 105]
    assert [x.equity for x in B.run(df, quantity=q, config=B.Config(cash=100, short_mtm="reference")).equity.orderBy("bar").collect()] == [120, 120, 125]


def test_unaffordable_and_percent(spark):
    assert B.run(ramp(spark, [L, H]), quantity=B.Quantity("fixed", 1e6)).trades.count() == 0
    r = B.run(ramp(spark, [L, X], [10, 20]), quantity=B.Quantity("percent_cash", 0.5), config=B.Config(cash=100))
    assert r.metrics.first().final_equity == 150


def test_strategy_object_equals_actions(spark):
    class Cross(B.Strategy):
        def on_start(self, context):
            self.e = T.Ema(3).start()

        def on_candle(self, bar, context):
            y = self.e.next(bar)[""]
            return B.Action(L) if bar["close"] > y and context.portfolio.side <= 0 else B.Action(X) if bar["close"] < y else B.Action()

    df = frame(spark, walk("a", 80, 4) + walk("b", 80, 5)).drop("seq").withColumn("seq", F.col("ts"))
    one = B.run(df, Cross())
    acted = add_indicators(df, {"e": T.Ema(3)}).withColumn("action", F.when(F.col("close") > F.col("e"), L).when(F.col("close") < F.col("e"), X).otherwise(H))
    two = B.run(acted)
    assert one.trades.count() > 5 and sorted(map(tuple, one.metrics.collect())) == sorted(map(tuple, two.metrics.collect()))


# --- sources and sinks ----------------------------------------------------------------------


def test_csv_round_trip(spark, tmp_path):
    path = f"{tmp_path}/in.csv"
    open(path, "w").write("Date,Open,High,Low,Close,Volume\n" + "".join(f"2024-01-{i + 1:02d},{i},{i + 2},{i - 1},{i + 1}.5,{100 * i}\n" for i in range(8)))
    df = IO.read_csv(spark, path, symbol="x")
    out = IO.enriched(df, {"z": T.Sma(3), "a": T.Ema(2)})
    assert out.columns[3:] == ["Date", "Open", "High", "Low", "Close", "Volume", "a", "z"]
    IO.write_csv(out, f"{tmp_path}/out", single_file=True)
    lines = open(glob.glob(f"{tmp_path}/out/part-*.csv")[0]).read().splitlines()
    assert lines[0] == "Date,Open,High,Low,Close,Volume,a,z" and lines[1] == "2024-01-01,0,2,-1,1.5,0,1.5," and lines[3].endswith(",2.5") and len(lines) == 9


def test_csv_layouts_and_errors(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    open(path, "w").write("1381017600,1,2,0.5,1.5,10,7\n1381104000,1,2,0.5,1.6,10,8\n")
    got = IO.read_csv(spark, path, IO.EXCHANGE, width=7).orderBy("ts").collect()
    assert [r.close for r in got] == [1.5, 1.6] and got[0].ts.year == 2013
    open(path, "w").write("h;h;h;h;h;h\n05.01.2024;1;2;0;;10\n")
    layout = IO.CsvLayout(delimiter=";", date_format="%d.%m.%Y")
    with pytest.raises(Exception, match="close is empty"):
        IO.read_csv(spark, path, layout).collect()
    assert IO.read_csv(spark, path, layout, mode="PERMISSIVE").first().close is None
    assert IO.java_date_format("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


def test_parquet_round_trip(spark, tmp_path):
    df = frame(spark, walk("a", 20, 1) + walk("b", 20, 2))
    IO.write_parquet(df, f"{tmp_path}/p")
    assert sorted(map(tuple, IO.read_parquet(spark, f"{tmp_path}/p").select(COLS).collect())) == sorted(map(tuple, df.collect()))
    assert len(os.listdir(f"{tmp_path}/p")) >= 2


# --- streaming ------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    rows = walk("a", 60, 6) + walk("b", 45, 7)
    df = frame(spark, rows)
    wanted = {"sma": T.Sma(5), "ema": T.Ema(4), "tema": T.Tema(3), "rsi": M.Rsi(5), "adx": T.Adx(4), "sar": T.ParabolicSar(), "st": M.Stochastic(5, 3), "kel": V.Keltner(5, 4), "obv": U.Obv(), "mfi": U.Mfi(5)}
    src = f"{tmp_path}/src"
    for k in range(4):
        df.where(f"ts % 60 BETWEEN {15 * k} AND {15 * k + 14}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live_indicators(stream, wanted).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    want = add_indicators(df, wanted).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    late = int(got.groupby("symbol").late.max().sum())
    assert len(got) + late == len(rows)
    if late == 0:
        for n in [x for a, i in wanted.items() for x in i.names(a)]:
            assert got[n].isna().tolist() == want[n].isna().tolist() and (got[n] - want[n]).abs().max() < 1e-9, n


def test_history_warms_the_stream_up(spark, tmp_path):
    df = frame(spark, walk("a", 40, 6))
    wanted = {"ema": T.Ema(4), "rsi": M.Rsi(5)}
    df.where("ts >= 30").coalesce(1).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/src")
    q = live_indicators(stream, wanted, history=df.where("ts < 30")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("ts").toPandas()
    want = add_indicators(df, wanted).where("ts >= 30").orderBy("ts").toPandas()
    assert len(got) == 10 and (got.ema - want.ema).abs().max() < 1e-9 and (got.rsi - want.rsi).abs().max() < 1e-9


def test_true_range_column(spark):
    df = frame(spark, walk("a", 30, 6)).withColumn("tr", V.true_range_column())
    g = df.orderBy("ts").toPandas()
    assert (g.tr - V.true_range(g.high.to_numpy(), g.low.to_numpy(), g.close.to_numpy())).abs().max() < 1e-12


def df_close(rows, r):
    return next(x[COLS.index("close")] for x in rows if x[:2] == (r.symbol, r.seq))


LIVE = {
    "up": S.LiveSignal("cross_up", ((T.Sma(3), ""), (T.Sma(8), ""))), "down": S.LiveSignal("cross_down", ((T.Sma(3), ""), (T.Sma(8), ""))),
    "over": S.LiveSignal("threshold_above", ((M.Rsi(5), ""),), 60.0), "under": S.LiveSignal("threshold_below", ((M.Rsi(5), ""),), 40.0),
    "out": S.LiveSignal("breakout", ("close", (V.Donchian(5), "upper", 1), (V.Donchian(5), "lower", 1))),
}
LIVE |= {"and": S.LiveSignal("both", legs=(LIVE["up"], LIVE["over"])), "or": S.LiveSignal("either", legs=(LIVE["up"], LIVE["down"])), "not": S.LiveSignal("inverse", legs=(LIVE["up"],))}


def test_live_signals_equal_batch(spark, tmp_path):
    df = frame(spark, walk("a", 120, 9) + walk("b", 60, 10))
    src = f"{tmp_path}/src"
    for k in range(3):
        df.where(f"ts BETWEEN {40 * k} AND {40 * k + 39}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = live_indicators(stream, LIVE).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    w = add_indicators(df, {"f": T.Sma(3), "s": T.Sma(8), "r": M.Rsi(5), "d": V.Donchian(5)})
    w = w.withColumns({"du": F.lag("d_upper").over(Bars().window()), "dl": F.lag("d_lower").over(Bars().window())})
    w = w.withColumns({"up": S.cross_up("f", "s"), "down": S.cross_down("f", "s"), "over": S.threshold_above("r", 60), "under": S.threshold_below("r", 40), "out": S.breakout("close", "du", "dl")})
    w = w.withColumns({"and": S.both(F.col("up"), F.col("over")), "or": S.either(F.col("up"), F.col("down")), "not": S.inverse(F.col("up"))})
    want = w.toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == len(want)
    for n in LIVE:
        assert got[n].where(got[n].notna(), None).tolist() == want[n].where(want[n].notna(), None).tolist(), n
        assert got[n].nunique() > 1 or n == "and"
    with pytest.raises(ValueError):
        S.LiveSignal("cross_up", ("close",))


def test_live_divergence_patterns_and_backtest_equal_batch(spark, tmp_path):
    rows = walk("a", 150, 21) + walk("b", 70, 22)
    df = frame(spark, rows)
    src = f"{tmp_path}/src"
    for k in range(3):
        df.where(f"ts BETWEEN {50 * k} AND {50 * k + 49}").coalesce(1).write.mode("append").parquet(src)
    config = B.Config(fee=0.002, slippage=0.001)
    rule = S.Divergence(2, 2)
    wanted = {"div": S.LiveDivergence(rule, "close", "volume"), "lag": S.LiveDivergence(rule, "close", (M.Rsi(5), "")), "pat": P.LivePatterns(), "bt": B.LiveBacktest(LIVE["or"], config=config)}
    q = live_indicators(spark.readStream.schema(df.schema).parquet(src), wanted).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {(r.symbol, r.ts): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = rule.apply(df, "close", "volume", "div", swings=True)
    warm = rule.apply(add_indicators(df, {"r": M.Rsi(5)}).where("r IS NOT NULL"), "close", "r", "lag", swings=True)
    scanned = P.scan(batch).withColumn("pat", F.array_join("patterns.kind", ","))
    crossed = add_indicators(df, {"f": T.Sma(3), "s": T.Sma(8)}).withColumn("action", B.action_of(S.either(S.cross_up("f", "s"), S.cross_down("f", "s"))))
    result = B.run(crossed.withColumn("seq", F.col("ts")), config=config)
    none = lambda x: None if x is None or x != x else x
    events = set()
    for r in scanned.collect():
        g = got[r.symbol, r.ts]
        assert (g.div, none(g.div_high_bar), none(g.div_low_bar)) == (r.div, *((r.div_high_bar, r.div_low_bar) if r.div else (None, None))) and g.pat == r.pat
        events |= {r.div, r.pat}
    for r in warm.collect():
        g = got[r.symbol, r.ts]
        assert (g.lag, none(g.lag_high_bar), none(g.lag_low_bar)) == (r.lag, *((r.lag_high_bar, r.lag_low_bar) if r.lag else (None, None)))
    assert len(got) == 220 and {"LONG", "SHORT", "HOLD", None} <= events and len(events) > 8
    for r in result.equity.collect():
        g = got[r.symbol, r.seq]
        assert (g.bt_equity, g.bt_cash, g.bt_position) == (r.equity, r.cash, r.position)
        assert (r.entry_price is None) == (r.position == 0) and (r.position == 0 or abs(r.unrealised - r.position * (df_close(rows, r) - r.entry_price)) < 1e-9)
    for r in result.trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("p")).collect():
        g = max((x for k, x in got.items() if k[0] == r.symbol), key=lambda x: x.ts)
        assert g.bt_trade_count == r.n > 3 and abs(g.bt_realised - r.p) < 1e-9


def test_sweep_equals_single_backtests(spark):
    df = frame(spark, walk("a", 90, 31) + walk("b", 90, 32)).drop("seq").withColumn("seq", F.col("ts"))
    grid = [{"f": f, "s": s} for f in (2, 3) for s in (5, 8, 13)]
    act = lambda d, g: d.withColumn("action", B.action_of(S.either(S.cross_up(f"m{g['f']}", f"m{g['s']}"), S.cross_down(f"m{g['f']}", f"m{g['s']}"))))
    ready = lambda d: add_indicators(d, {f"m{n}": T.Sma(n) for n in (2, 3, 5, 8, 13)})
    for at_once in (4, 32):
        swept = B.sweep(df, grid, act, prepare=ready, at_once=at_once)
        got = {(r.symbol, r.param_id): tuple(r)[2:] for r in swept.collect()}
        want = {(r.symbol, i): tuple(r)[1:] for i, g in enumerate(grid) for r in B.run(act(ready(df), g)).metrics.collect()}
        assert got == want and len(got) == 12
    plan = B.sweep(df, grid, act, prepare=ready)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_one_fold_for_metrics(spark):
    df = frame(spark, walk("a", 60, 5)).withColumn("action", F.lit(H))
    plan = B.run(df).metrics._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_live_bars_equal_resampled(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    ev.coalesce(1).write.parquet(f"{tmp_path}/ev")
    args = dict(symbol=F.col("event_type"), price=F.col("value"), volume=F.lit(1), order=[F.col("ts"), F.col("event_id")])
    live = live_bars(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"), ts="ts", width="1 hour", lateness="0 seconds", **args)
    q = live.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in IO.resample(ev, bucket=F.date_trunc("hour", "ts"), **args).collect()}
    assert len(got) > 800 and all(want[k] == v for k, v in got.items())


# --- registered queries ---------------------------------------------------------------------


def same(spark, names, q, o, con):
    for n in names:
        a, b = q[n](spark, SF).toPandas(), con.sql(o[n]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns) and len(a) == len(b), n
        key = [c for c in ("symbol", "rn", "param_id", "place", "Date", "Hour", "date") if c in cols]
        a, b = a[cols].sort_values(key, ignore_index=True), b[cols].sort_values(key, ignore_index=True)
        for c in cols:
            x, y = a[c], b[c]
            assert x.isna().tolist() == y.isna().tolist(), (n, c)
            assert x[x.notna()].astype(object).tolist() == y[y.notna()].astype(object).tolist(), (n, c)


def test_queries_equal_sql(spark):
    entry = importlib.import_module("__spark_entry__")
    from quantloom import queries as E

    q, o = E.queries(), E.oracle_sql()
    assert set(q) == set(o) and set(q) <= set(entry.queries())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    same(spark, ["sma_crossover", "ohlcv_bars", "adx", "sar", "rsi", "cci", "mfi", "divergence", "pattern_scan", "backtest_trades", "backtest_metrics", "csv_enrich", "breakout", "signal_or", "csv_read", "strategy_object", "quantity_percent", "ema_initial", "adx_flat", "std_aggregate", "backtest_sweep"], q, o, con)
    assert entry.entry(spark).count() > 0
