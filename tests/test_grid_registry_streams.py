"""Parameter grids, indicators from SQL, streams out of order and by sessions, sinks that are restarted."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import momentum as M
from quantloom.functions import registry as R
from quantloom.functions import signals as S
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.functions.sessions import Calendar, Gap, with_sessions
from quantloom.operators import backtest as B
from quantloom.operators import grid as G
from quantloom.plans.pipeline import add_indicators
from quantloom.schema import Bars
from quantloom.streaming.live import live_indicators
from quantloom.streaming.sinks import UpsertSink


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(2)
    parts = []
    for s, n in (("a", 260), ("b", 130), ("c", 3)):
        c = np.abs(60 + np.cumsum(rng.normal(0, 1.5, n))) + 1
        o = np.append(c[0], c[:-1])
        at = pd.to_datetime(np.cumsum(rng.choice([600, 1200, 30_000], n, p=[0.6, 0.35, 0.05])), unit="s")
        parts.append(pd.DataFrame({"symbol": s, "ts": at, "seq": np.arange(n), "open": o, "high": np.maximum(o, c) + rng.random(n), "low": np.minimum(o, c) - rng.random(n), "close": c, "volume": rng.integers(1, 50, n).astype(float)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def close(a, b, keys):
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for x in b.columns:
        if x not in keys and x != "late":
            assert np.allclose(a[x].to_numpy(float, na_value=np.nan), b[x].to_numpy(float, na_value=np.nan), rtol=1e-9, atol=1e-9, equal_nan=True), x


# --- grids ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("quantity", "config"), [
    (B.Quantity(), B.Config(fee=0.001, slippage=0.0005)), (B.Quantity("fixed", 120.0), B.Config(fee=0.002)), (B.Quantity("percent_cash", 0.4), B.Config(short_mtm="reference")),
    (B.Quantity(), B.Config(affordability="strict")), (B.Quantity("fixed", 900.0), B.Config()), (B.Quantity(), B.Config(cash=0.0)),
])
def test_a_grid_equals_a_backtest_per_set(bars, quantity, config, monkeypatch):
    monkeypatch.setattr(G, "STEP", 50)
    legs = [(T.Sma(3), T.Sma(9)), (T.Ema(4), T.Sma(60)), (T.Sma(9), T.Sma(3)), (T.Wma(3), T.Dema(4)), (T.Sma(200), T.Sma(250))]
    got = G.sweep_grid(bars, legs, quantity=quantity, config=config).toPandas()
    for k, (f, s) in enumerate(legs):
        df = add_indicators(bars, {"f": f, "s": s}).withColumn("action", B.action_of(S.either(S.cross_up("f", "s"), S.cross_down("f", "s"))))
        want = B.run(df, quantity=quantity, config=config).metrics.toPandas()
        close(got[got["param_id"] == k].drop(columns="param_id"), want, ["symbol"])


def test_grids_in_groups_sessions_and_one_plan(spark, bars, monkeypatch):
    legs = [(T.Sma(f), T.Sma(s)) for f in range(2, 12) for s in range(12, 22)]
    whole = G.sweep_grid(bars, legs)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1
    a = whole.toPandas()
    monkeypatch.setattr(G, "HELD_BYTES", 8 * 260 * 5)
    close(G.sweep_grid(bars, legs).toPandas(), a, ["symbol", "param_id"])
    rule = lambda was, now: np.where(now[0] > 60, G.LONG, G.OUT)
    one = G.sweep_grid(bars, [(T.Sma(1),)], rule=rule).toPandas()
    df = bars.withColumn("action", F.when(F.col("close") > 60, "ENTER_LONG").otherwise("EXIT"))
    close(one.drop(columns="param_id"), B.run(df).metrics.toPandas(), ["symbol"])
    by = with_sessions(bars, Calendar(24))
    days = G.sweep_grid(by, legs[:2], c=Bars(session="session"))
    assert days.count() == 2 * by.select("symbol", "session").distinct().count()
    assert G.sweep_grid(bars.where("false"), legs).collect() == []
    with pytest.raises(ValueError, match="empty"):
        G.sweep_grid(bars, [])
    with pytest.raises(ValueError, match="no array form"):
        G.sweep_grid(bars, [(U.Obv(), T.Sma(3))])


# --- registry -------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "params", "i"), [
    ("sma", {"n": 5}, T.Sma(5)), ("EMA", {"n": 4, "initial": 50.0}, T.Ema(4, initial=50.0)), ("macd", None, T.Macd()), ("adx", {"n": 7}, T.Adx(7)), ("williams_r", {"n": 6}, M.WilliamsR(6)),
    ("bollinger", {"n": 6, "k": 1.5}, V.Bollinger(6, 1.5)), ("parabolic_sar", {}, T.ParabolicSar()), ("obv", None, U.Obv()),
])
def test_indicators_from_sql(spark, bars, name, params, i):
    R.register(spark)
    bars.createOrReplaceTempView("registry_bars")
    given = "" if params is None else f", '{json.dumps(params)}'"
    got = spark.sql(f"SELECT * FROM indicator(TABLE(SELECT symbol, ts, seq, open AS `open`, high AS `high`, low AS `low`, close AS `close`, volume AS `volume`, 'k' AS extra FROM registry_bars) PARTITION BY symbol ORDER BY (ts, seq), '{name}'{given})" if name == "sma" else
                    f"SELECT * FROM indicator(TABLE(registry_bars) PARTITION BY symbol ORDER BY (ts, seq), '{name}'{given})")
    want = add_indicators(bars, {"x": i})
    outputs = ["value"] if i.outputs == ("",) else list(i.outputs)
    renamed = got.select("symbol", "ts", "seq", *[F.col(o).alias(n) for o, n in zip(outputs, i.names("x"))])
    close(renamed.toPandas(), want.select("symbol", "ts", "seq", *i.names("x")).toPandas(), ["symbol", "ts", "seq"])


class Range:
    """An indicator of one's own: the largest range so far."""

    outputs, types = ("largest", "label"), ("double", "string")

    def __init__(self, scale: float = 1.0):
        self.scale, self.top = scale, 0.0

    def start(self):
        return Range(self.scale)

    def next(self, bar):
        self.top = max(self.top, self.scale * (bar["high"] - bar["low"]))
        return {"largest": self.top, "label": "wide" if self.top > 3 else "narrow"}


def test_an_indicator_of_ones_own(spark, bars):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    R.define("largest_range", Range)
    R.register(spark)
    bars.createOrReplaceTempView("registry_bars")
    got = spark.sql("""SELECT symbol, max(largest) AS m, max(label) AS l FROM indicator(TABLE(registry_bars) PARTITION BY symbol ORDER BY (ts, seq), 'largest_range', '{"scale": 2}') GROUP BY symbol""").collect()
    want = {r["symbol"]: r["m"] for r in bars.groupBy("symbol").agg((2 * F.max(F.col("high") - F.col("low"))).alias("m")).collect()}
    assert {r["symbol"]: pytest.approx(r["m"]) for r in got} == want
    assert R.make("sma", {"n": 3}) == T.Sma(3) and "largest_range" in R.names()
    for bad in ("nothing", "sma"):
        with pytest.raises(Exception, match="no indicator is called|missing"):
            R.make(bad)
    with pytest.raises(ValueError):
        R.define("no name", Range)
    with pytest.raises(ValueError):
        R.define("x", int)


# --- streams --------------------------------------------------------------------------------

LIVE = {"sma": T.Sma(4), "ema": T.Ema(5), "rsi": M.Rsi(5), "vwap": U.Vwap()}


def run(stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_bars_out_of_order_within_the_watermark_equal_the_batch(spark, pdf, bars, tmp_path):
    rng = np.random.default_rng(4)
    hours = 6 * 3600
    order = np.argsort(pdf["ts"].astype("int64").to_numpy() / 1e9 + rng.uniform(0, hours * 0.9, len(pdf)))  # nothing is more than six hours out of place
    end = pd.DataFrame([{**pdf.iloc[0].to_dict(), "symbol": "end", "ts": pdf["ts"].max() + pd.Timedelta(days=9 + i), "seq": i} for i in range(2)])
    shuffled = pdf.iloc[order]
    parts = [*(shuffled.iloc[i : i + 80] for i in range(0, len(shuffled), 80)), end.iloc[:1], end.iloc[1:]]
    for p in parts:
        spark.createDataFrame(p).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    run(live_indicators(stream, LIVE, lateness="6 hours"), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").where("symbol <> 'end'").toPandas()
    assert (got["late"] == 0).all()
    close(got.drop(columns="late"), add_indicators(bars, LIVE).toPandas(), ["symbol", "ts", "seq"])
    with pytest.raises(ValueError, match="lateness"):
        live_indicators(stream, LIVE, lateness="1 hour", ttl_ms=5)


@pytest.mark.parametrize("rule", [Calendar(24), Gap(60)])
def test_sessions_on_a_stream(spark, bars, tmp_path, rule):
    bars.coalesce(1).write.parquet(f"{tmp_path}/src")
    run(live_indicators(spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/src"), LIVE, sessions=rule), tmp_path)
    want = add_indicators(with_sessions(bars, rule), LIVE, c=Bars(session="session")).drop("session")
    close(spark.read.parquet(f"{tmp_path}/out").drop("late").toPandas(), want.toPandas(), ["symbol", "ts", "seq"])


# --- sinks ----------------------------------------------------------------------------------


def test_a_restarted_sink_writes_nothing_twice(spark, bars, tmp_path):
    sink, src = UpsertSink(f"file://{tmp_path}/table"), f"{tmp_path}/src"
    stream = lambda: spark.readStream.schema(bars.schema).parquet(src)
    bars.where("symbol = 'a'").coalesce(1).write.mode("append").parquet(src)
    sink.start(stream(), f"{tmp_path}/cp", availableNow=True).awaitTermination(120)
    assert sink.read(spark).count() == 260
    bars.where("symbol = 'b'").unionAll(bars.where("symbol = 'a' AND seq < 5").withColumn("close", F.lit(-1.0))).coalesce(1).write.mode("append").parquet(src)
    sink.start(stream(), f"{tmp_path}/cp", availableNow=True).awaitTermination(120)
    rows = sink.read(spark)
    assert rows.count() == 390 and rows.where("close = -1").count() == 5
    again = bars.where("symbol = 'b'").unionAll(bars.where("symbol = 'a' AND seq < 5").withColumn("close", F.lit(-1.0)))
    sink(again, 1)  # a batch that runs again after a failure
    assert sink.read(spark).count() == 390 and spark.read.parquet(f"{tmp_path}/table").count() == 260 + 135
    sink.compact(spark)
    assert sink.read(spark).count() == 390 and sink.read(spark).where("close = -1").count() == 5
    sink(again.withColumn("close", F.lit(-2.0)), 1)  # it is in the compacted table already
    sink(bars.where("symbol = 'c'"), 2)
    assert sink.read(spark).count() == 393 and sink.read(spark).where("close < 0").count() == 5
    sink.compact(spark)
    assert sink.read(spark).count() == 393


def test_versions_within_a_batch(spark, tmp_path):
    sink = UpsertSink(f"file://{tmp_path}/table", key=("k",), order="v")
    with pytest.raises(ValueError, match="nothing"):
        sink.read(spark)
    sink(spark.createDataFrame([("x", 1), ("x", 3), ("x", 2), ("y", None), ("y", 0), (None, 4)], "k string, v int"), 0)
    assert sorted(map(tuple, sink.read(spark).collect()), key=str) == [("x", 3), ("y", 0), (None, 4)]
