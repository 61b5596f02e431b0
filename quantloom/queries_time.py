"""Registered queries on long series, sessions, alignment, stored states and the rarer options of the engine,
each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import momentum as M
from quantloom.functions import signals as S
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.functions.registry import register
from quantloom.functions.sessions import Calendar, Gap, gap_session_bars, session_pivots, with_sessions
from quantloom.operators import backtest as B
from quantloom.operators.asof import asof
from quantloom.operators.block_backtest import run_blocked
from quantloom.operators.blocks import add_indicators_blocked
from quantloom.operators.grid import sweep_grid
from quantloom.plans.pipeline import add_indicators
from quantloom.plans.resumable import advance
from quantloom.queries import _AVERAGES, _BARS, _CONFIG, _METRICS, INDICATORS, _acted, _ema, _fold_sql, _lag, _metric_sql, _out, _r, _rec, _sql_indicators, _w, hourly_bars, numbered, sql
from quantloom.schema import Bars
from quantloom.sources.bars import EXCHANGE, read_csv, resample
from quantloom.sources.scratch import shared_folder

C = Bars()
Query = Callable[[SparkSession, str], DataFrame]
#: Bars of a block in these queries; what an indicator looks back on makes blocks longer.
BLOCK = 64
#: Units of fixed entries, with so many digits that no amount is half of the last digit shown.
UNITS = 83.7654321

# --- time blocks ----------------------------------------------------------------------------

_BLOCKED = ("sma", "wma", "hma", "ema", "dema", "tema", "macd", "adx", "sar", "ichimoku", "pivot_camarilla", "rsi", "stochastic", "williams_r", "cci", "atr", "bollinger", "keltner", "donchian", "std", "obv", "cmf", "mfi", "vwap", "heikin_ashi")


def _blocked(name: str) -> Query:
    i, skip = INDICATORS[name]
    names = [n for n in i.names(name) if n not in skip]
    return lambda spark, sf: add_indicators_blocked(numbered(spark, sf), {name: i}, block_bars=BLOCK).select("symbol", "rn", *map(_r, names))


_CROSSING = S.LiveSignal("either", legs=tuple(S.LiveSignal(k, ((T.Sma(5), ""), (T.Sma(20), ""))) for k in ("cross_up", "cross_down")))


def _blocked_run(spark: SparkSession, sf: str, quantity: B.Quantity = B.Quantity(), config: B.Config = _CONFIG) -> B.Result:
    bars = add_indicators_blocked(numbered(spark, sf), {"event": _CROSSING}, block_bars=BLOCK, keep_blocks=True)
    return run_blocked(bars.withColumns({"seq": F.col("rn").cast("long"), "action": B.action_of(F.col("event"))}), quantity=quantity, config=config)


def _blocked_signal(spark: SparkSession, sf: str) -> DataFrame:
    return add_indicators_blocked(numbered(spark, sf), {"event": _CROSSING}, block_bars=BLOCK).select("symbol", "rn", "event")


def _blocked_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _blocked_run(spark, sf).metrics.select("symbol", "trade_count", *map(_r, _METRICS))


def _equity_rows(r: B.Result) -> DataFrame:
    return r.equity.select("symbol", F.col("seq").cast("int").alias("rn"), *[_r(c) for c in ("equity", "cash", "position")])


def _trade_rows(r: B.Result) -> DataFrame:
    return r.trades.select("symbol", F.col("exit_seq").cast("int").alias("rn"), "side", *[_r(c) for c in ("quantity", "entry_price", "exit_price", "pnl", "fees")])


# --- wide windows ---------------------------------------------------------------------------

_WIDE = {"sma": T.Sma(100), "wma": T.Wma(80), "bo": V.Bollinger(100, 2.0), "don": V.Donchian(100), "cci": M.Cci(60), "wr": M.WilliamsR(90)}


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    names = [n for a, i in _WIDE.items() for n in i.names(a)]
    return add_indicators(numbered(spark, sf), _WIDE).select("symbol", "rn", *map(_r, names))


def _wide_sql() -> str:
    g = lambda n, e: f"CASE WHEN rn >= {n} THEN {e} END"
    tp, hi, lo = "(high + low + close) / 3", lambda n: f"max(high) {_w(n)}", lambda n: f"min(low) {_w(n)}"
    wma = f"list_sum(list_transform(list(close) {_w(80)}, lambda v, i: v * i)) / 3240.0"
    return sql(
        _out({"sma": g(100, "m"), "wma": g(80, "w"), "bo_middle": g(100, "m"), "bo_upper": g(100, "m + 2 * d"), "bo_lower": g(100, "m - 2 * d"), "bo_bandwidth": g(100, "4 * d / m"),
              "don_upper": g(100, "u"), "don_middle": g(100, "(u + l) / 2"), "don_lower": g(100, "l"), "cci": g(60, "CASE WHEN mad = 0 THEN 0 ELSE (tp - tpm) / (0.015 * mad) END"), "wr": g(90, "CASE WHEN hw = lw THEN -50 ELSE -100 * (hw - close) / (hw - lw) END")}, "z"),
        f"""y AS (SELECT *, avg(close) {_w(100)} AS m, stddev_pop(close) {_w(100)} AS d, {hi(100)} AS u, {lo(100)} AS l, {hi(90)} AS hw, {lo(90)} AS lw, {tp} AS tp, avg({tp}) {_w(60)} AS tpm, list({tp}) {_w(60)} AS tps, {wma} AS w FROM x)""",
        "z AS (SELECT *, list_sum(list_transform(tps, lambda v: abs(v - tpm))) / 60 AS mad FROM y)")


# --- sessions -------------------------------------------------------------------------------


def _session_vwap(spark: SparkSession, sf: str) -> DataFrame:
    bars = with_sessions(hourly_bars(spark, sf), Calendar(24))
    out = add_indicators(bars, {"vwap": U.Vwap(), "sma": T.Sma(3), "ema": T.Ema(4)}, c=Bars(session="session"))
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.date_format("session", "yyyy-MM-dd HH").alias("session"), *map(_r, ("vwap", "sma", "ema")))


def _session_vwap_sql() -> str:
    by = "(PARTITION BY symbol, s ORDER BY ts"
    a = _ema(4)
    return f"""WITH RECURSIVE {_BARS}, d AS MATERIALIZED (SELECT *, date_trunc('day', ts) AS s, (high + low + close) / 3 AS tp, CAST(row_number() OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts) AS INTEGER) AS k FROM x),
      e AS (SELECT symbol, s, k, close AS y FROM d WHERE k = 1 UNION ALL SELECT d.symbol, d.s, d.k, {a!r} * d.close + (1 - {a!r}) * e.y FROM e JOIN d ON d.symbol = e.symbol AND d.s = e.s AND d.k = e.k + 1)
      SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, strftime(s, '%Y-%m-%d %H') AS session, round(sum(tp * volume) OVER {by} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER {by} ROWS UNBOUNDED PRECEDING), 6) AS vwap,
        round(CASE WHEN k >= 3 THEN avg(close) OVER {by} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS sma, round(e.y, 6) AS ema FROM d JOIN e USING (symbol, s, k)"""


def _session_pivots(spark: SparkSession, sf: str) -> DataFrame:
    out = session_pivots(with_sessions(hourly_bars(spark, sf), Calendar(8, 1)), "classic")
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), *[_r(f"pivot_{x}") for x in ("pp", "r1", "s1", "r3", "s3")])


_SESSION_PIVOTS = f"""WITH {_BARS}, d AS (SELECT *, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01 01:00:00') AS s FROM x),
  a AS (SELECT symbol, s, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM d GROUP BY 1, 2),
  p AS (SELECT symbol, s, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM a WINDOW w AS (PARTITION BY symbol ORDER BY s))
  SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, round((h + l + c) / 3, 6) AS pivot_pp, round(2 * (h + l + c) / 3 - l, 6) AS pivot_r1, round(2 * (h + l + c) / 3 - h, 6) AS pivot_s1,
    round(h + 2 * ((h + l + c) / 3 - l), 6) AS pivot_r3, round(l - 2 * (h - (h + l + c) / 3), 6) AS pivot_s3 FROM d JOIN p USING (symbol, s)"""


def _gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = gap_session_bars(hourly_bars(spark, sf), Gap(60))
    return out.select("symbol", F.date_format("session", "yyyy-MM-dd HH").alias("session"), "bars", *[_r(x) for x in ("open", "high", "low", "close", "volume")])


def _gap_vwap(spark: SparkSession, sf: str) -> DataFrame:
    bars = with_sessions(hourly_bars(spark, sf), Gap(60))
    return add_indicators(bars, {"vwap": U.Vwap()}, c=Bars(session="session")).select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.date_format("session", "yyyy-MM-dd HH").alias("session"), _r("vwap"))


_GAPS = f"""WITH {_BARS}, g AS (SELECT *, CASE WHEN ts - {_lag('ts')} <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM x), d AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM g),
  e AS (SELECT *, min(ts) OVER (PARTITION BY symbol, s) AS begun FROM d)"""

# --- alignment ------------------------------------------------------------------------------


def _series(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type") == kind)
    return e.select("user_id", F.date_trunc("minute", "ts").alias("ts"), F.col("event_id").alias("seq"), "value")


def _asof(by: tuple[str, ...], tolerance: float | None, exact: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = asof(_series(spark, sf, "purchase"), _series(spark, sf, "view"), by=by, tolerance=tolerance, exact=exact, block_rows=500)
        return out.select("seq", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), _r("value"), "right_seq", F.date_format("right_ts", "yyyy-MM-dd HH:mm").alias("right_at"), _r("right_value"))

    return run


def _asof_sql(by_user: bool, tolerance: int | None, exact: bool) -> str:
    key = "user_id" if by_user else "0"
    match = "r IS NOT NULL" if tolerance is None else f"r IS NOT NULL AND ts - r.ts <= INTERVAL {tolerance} SECOND"
    at = lambda e: f"CASE WHEN {match} THEN {e} END"
    return f"""WITH e AS (SELECT event_type, user_id, date_trunc('minute', ts) AS ts, event_id AS seq, value FROM events WHERE event_type IN ('purchase', 'view')),
      u AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN {{'ts': ts, 'seq': seq, 'value': value, 'user_id': user_id}} END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY ts,
        CASE WHEN event_type = 'view' THEN 1 ELSE {2 if exact else 0} END, CASE WHEN event_type = 'view' THEN seq END ROWS UNBOUNDED PRECEDING) AS r FROM e)
      SELECT seq, user_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, round(value, 6) AS value, {at('r.seq')} AS right_seq, {at("strftime(r.ts, '%Y-%m-%d %H:%M')")} AS right_at, round({at('r.value')}, 6) AS right_value FROM u WHERE event_type = 'purchase'"""


# --- stored states --------------------------------------------------------------------------


def _resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over a growing table; each continues from the states of the one before."""
    bars, folder = hourly_bars(spark, sf), shared_folder(spark, "resumed")
    wanted = {"sma": T.Sma(5), "ema": T.Ema(10), "std": V.Std(10), "obv": U.Obv()}
    out = [advance(part, wanted, folder) for part in (bars.where("ts < '2024-01-09 05:00:00'"), bars.where("ts < '2024-01-20'"), bars)]
    return out[0].unionAll(out[1]).unionAll(out[2]).select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), *map(_r, wanted))


_RESUMED = sql(
    "SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in {"sma": f"CASE WHEN rn > 4 THEN avg(close) {_w(5)} END", "ema": "e.y", "std": f"CASE WHEN rn > 9 THEN stddev_pop(close) {_w(10)} END", "obv": "sum(f) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING)"}.items()) + " FROM o JOIN e USING (symbol, rn)",
    _rec("e", "x", "close", _ema(10)), f"o AS (SELECT *, CASE WHEN close > {_lag('close')} THEN volume WHEN close < {_lag('close')} THEN -volume ELSE 0 END AS f FROM x)")

# --- options --------------------------------------------------------------------------------


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    r = B.run(_acted(numbered(spark, sf), {"fast": 5, "slow": 20}).withColumn("seq", F.col("rn").cast("long")), quantity=B.Quantity("fixed", UNITS), config=_CONFIG)
    return _equity_rows(r)


def _short_reference(spark: SparkSession, sf: str) -> DataFrame:
    config = B.Config(fee=_CONFIG.fee, slippage=_CONFIG.slippage, short_mtm="reference")
    return _equity_rows(B.run(_acted(numbered(spark, sf), {"fast": 5, "slow": 20}).withColumn("seq", F.col("rn").cast("long")), config=config))


def _fixed_fold(units: float) -> tuple[str, ...]:
    """The fold with fixed units: a long entry whose cost is above the cash is refused."""
    fee, slip = _CONFIG.fee, _CONFIG.slippage
    head, fold, body, *rest = _fold_sql(5, 20)
    opens, share = "act <> 0 AND (side = 0 OR closes) AND c1 > 0 AS opens", f"1.0 * c1 / (CASE WHEN act = 1 THEN (close * {1 + slip!r}) ELSE (close * {1 - slip!r}) END * {1 + fee!r}) AS units"
    assert opens in body and share in body
    fits = f"act <> 0 AND (side = 0 OR closes) AND (act = -1 OR {units!r} * (close * {1 + slip!r}) * {1 + fee!r} <= c1 * (1 + 1e-12)) AS opens"
    return head, fold, body.replace(opens, fits).replace(share, f"{units!r} AS units"), *rest


def _policies(spark: SparkSession, sf: str) -> DataFrame:
    """Bars without range and volume are what a policy is for: many ticks make bars of one price."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    bars = resample(e, symbol=F.col("event_type"), bucket=F.date_trunc("minute", "ts"), price=F.round("value", 0), volume=F.when(F.col("value") > 60, F.lit(1)).otherwise(F.lit(0)), order=[F.col("ts"), F.col("event_id")])
    bars = bars.withColumn("rn", F.row_number().over(C.window()))
    wanted = {"adl": U.Adl(), "adl_skip": U.Adl(on_invalid="null"), "vroc": U.Vroc(2), "cmf": U.Cmf(4), "cmf_skip": U.Cmf(4, on_invalid="null")}
    return add_indicators(bars, wanted).select("symbol", "rn", *map(_r, wanted))


_POLICIES = f"""WITH b AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, max(v) AS high, min(v) AS low, arg_max(v, (ts, event_id)) AS close, CAST(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS DOUBLE) AS volume
    FROM (SELECT *, round(value, 0) AS v FROM events) GROUP BY 1, 2),
  x AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS INTEGER) AS rn FROM b),
  f AS (SELECT *, CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) END * volume AS f, CASE WHEN high <> low THEN (2 * close - high - low) / (high - low) END * volume AS g, {_lag('volume', 2)} AS old FROM x)
  SELECT symbol, rn, round(sum(f) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 6) AS adl, round(sum(g) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 6) AS adl_skip,
    round(CASE WHEN old <> 0 THEN 100 * (volume - old) / old END, 6) AS vroc, round(CASE WHEN rn >= 4 THEN sum(f) {_w(4)} / nullif(sum(volume) {_w(4)}, 0) END, 6) AS cmf,
    round(CASE WHEN rn >= 4 THEN sum(g) {_w(4)} / nullif(sum(volume) {_w(4)}, 0) END, 6) AS cmf_skip FROM f"""


def _exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as headerless files of unix seconds with a trade count, one file per symbol, read back and averaged."""
    bars, folder = hourly_bars(spark, sf), shared_folder(spark, "exchange")
    rows = bars.select("symbol", F.unix_timestamp("ts").alias("t"), "open", "high", "low", "close", "volume", F.lit(7).alias("trades"))
    rows.repartition("symbol").sortWithinPartitions("symbol", "t").write.partitionBy("symbol").csv(folder, header=False)
    names = [r["symbol"] for r in bars.select("symbol").distinct().collect()]
    read = None
    for name in sorted(names):
        one = read_csv(spark, f"{folder}/symbol={name}", EXCHANGE, symbol=name, width=7)
        read = one if read is None else read.unionAll(one)
    out = add_indicators(read, {"sma": T.Sma(5)})
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), *[_r(x) for x in ("open", "high", "low", "close", "volume", "sma")])


_EXCHANGE = sql("SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("open", "high", "low", "close", "volume")) + f", round(CASE WHEN rn >= 5 THEN avg(close) {_w(5)} END, 6) AS sma FROM x")


# --- grids and SQL --------------------------------------------------------------------------

_GRID = [(f, s) for f in (3, 5) for s in (10, 20)]


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    out = sweep_grid(hourly_bars(spark, sf), [(T.Sma(f), T.Sma(s)) for f, s in _GRID], config=_CONFIG)
    return out.select("symbol", "param_id", "trade_count", *map(_r, _METRICS))


def _sql_table(spark: SparkSession, sf: str) -> DataFrame:
    """The relative strength of all bars by the table function."""
    register(spark)
    view = f"sql_table_{uuid.uuid4().hex}"
    numbered(spark, sf).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT symbol, rn, round(value, 6) AS rsi FROM indicator(TABLE({view}) PARTITION BY symbol ORDER BY (ts, seq), 'rsi', '{{"n": 14}}')""")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"blocked_{n}": _blocked(n) for n in _BLOCKED}
    return out | {
        "blocked_signal": _blocked_signal, "blocked_backtest_equity": lambda s, d: _equity_rows(_blocked_run(s, d)), "blocked_backtest_trades": lambda s, d: _trade_rows(_blocked_run(s, d)), "blocked_backtest_metrics": _blocked_metrics,
        "blocked_quantity_fixed": lambda s, d: _equity_rows(_blocked_run(s, d, B.Quantity("fixed", UNITS))), "wide_windows": _wide,
        "session_vwap": _session_vwap, "session_pivots": _session_pivots, "gap_sessions": _gap_sessions, "gap_session_vwap": _gap_vwap,
        "asof_last": _asof((), None, True), "asof_by_user": _asof(("user_id",), None, True), "asof_tolerance": _asof((), 600, False),
        "resumed_indicators": _resumed, "quantity_fixed": _fixed, "short_reference": _short_reference, "error_policies": _policies, "csv_exchange": _exchange,
        "grid_sweep": _grid, "sql_table_function": _sql_table,
    }


def oracle_sql() -> dict[str, str]:
    plain = _sql_indicators()
    fold = _fold_sql(5, 20)
    equity = "SELECT symbol, rn, round(equity, 6) AS equity, round(cash, 6) AS cash, round(position, 6) AS position FROM eq"
    fixed = sql(equity, *_fixed_fold(UNITS))
    reference = [x.replace("CASE WHEN side = 0 THEN cash ELSE cash + side * q * close END AS equity", "CASE WHEN side = 0 THEN cash WHEN side = -1 THEN cash + q * (2 * entry - close) ELSE cash + side * q * close END AS equity") for x in fold]
    return {f"blocked_{n}": plain[n] for n in _BLOCKED} | {
        "blocked_signal": sql("SELECT symbol, rn, CASE WHEN cu = 'LONG' THEN 'LONG' WHEN cd = 'SHORT' THEN 'SHORT' WHEN cu = 'HOLD' OR cd = 'HOLD' THEN 'HOLD' END AS event FROM v", _AVERAGES),
        "blocked_backtest_equity": sql(equity, *fold), "blocked_backtest_metrics": sql(_metric_sql(), *fold),
        "blocked_backtest_trades": sql("SELECT symbol, rn, side, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("quantity", "entry_price", "exit_price", "pnl", "fees")) + " FROM tr", *fold),
        "blocked_quantity_fixed": fixed, "quantity_fixed": fixed, "short_reference": sql(equity, *reference), "wide_windows": _wide_sql(),
        "session_vwap": _session_vwap_sql(), "session_pivots": _SESSION_PIVOTS,
        "gap_sessions": f"{_GAPS} SELECT symbol, strftime(begun, '%Y-%m-%d %H') AS session, count(*) AS bars, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, round(sum(volume), 6) AS volume FROM e GROUP BY symbol, begun",
        "gap_session_vwap": f"{_GAPS} SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS hour, strftime(begun, '%Y-%m-%d %H') AS session, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) AS vwap FROM e WINDOW w AS (PARTITION BY symbol, begun ORDER BY ts ROWS UNBOUNDED PRECEDING)",
        "asof_last": _asof_sql(False, None, True), "asof_by_user": _asof_sql(True, None, True), "asof_tolerance": _asof_sql(False, 600, False),
        "resumed_indicators": _RESUMED, "error_policies": _POLICIES, "csv_exchange": _EXCHANGE, "sql_table_function": plain["rsi"],
        "grid_sweep": " UNION ALL ".join(f"SELECT * FROM ({sql(_metric_sql(f'{i} AS param_id,'), *_fold_sql(f, s))})" for i, (f, s) in enumerate(_GRID)),
    }
