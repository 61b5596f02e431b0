"""Registered queries of the engine, one per operator, over hourly bars of ``events``.

Each query is paired with the SQL that computes the same rows; floating-point results are rounded
to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import momentum as M
from quantloom.functions import patterns as P
from quantloom.functions import signals as S
from quantloom.functions import sizing as Z
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.functions.indicator import Indicator
from quantloom.operators import backtest as B
from quantloom.plans.pipeline import add_indicators
from quantloom.schema import Bars
from quantloom.sources.bars import CsvLayout, enriched, read_csv, resample, write_csv
from quantloom.sources.scratch import shared_folder

C = Bars()
Query = Callable[[SparkSession, str], DataFrame]


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    return resample(e, symbol=F.col("event_type"), bucket=F.date_trunc("hour", "ts"), price=F.col("value"), volume=F.lit(1), order=[F.col("ts"), F.col("event_id")])


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_bars(spark, sf_dir).withColumn("rn", F.row_number().over(C.window()))


def _r(x: str | Column, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, 6).alias(name or x)


def indicator_query(alias: str, i: Indicator, skip: tuple[str, ...] = ()) -> Query:
    names = [n for n in i.names(alias) if n not in skip]
    return lambda spark, sf: add_indicators(numbered(spark, sf), {alias: i}).select("symbol", "rn", *map(_r, names))


# --- SQL pieces -----------------------------------------------------------------------------

_BARS = """b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
x AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS INTEGER) AS rn FROM b)"""
_BY = "PARTITION BY symbol ORDER BY rn"


def _w(n: int) -> str:
    return f"OVER ({_BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_ALL = f"OVER ({_BY} ROWS UNBOUNDED PRECEDING)"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({_BY})"


def sql(select: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join([_BARS, *ctes])} {select}"


def _out(cols: dict[str, str], source: str = "x") -> str:
    return f"SELECT symbol, rn, {', '.join(f'round({e}, 6) AS {n}' for n, e in cols.items())} FROM {source}"


def _rec(name: str, source: str, value: str, alpha: float) -> str:
    """Exponential smoothing seeded by the first value."""
    return f"""{name} AS (SELECT symbol, rn, {value} AS y FROM {source} WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, {alpha!r} * s.{value} + (1 - {alpha!r}) * p.y FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def _wilder(name: str, source: str, value: str, n: int, first: int = 1) -> str:
    """Mean of n values from row ``first`` on, then Wilder's recurrence."""
    at = first + n - 1
    return f"""{name} AS (SELECT symbol, CAST({at} AS INTEGER) AS rn, avg({value}) AS y FROM {source} WHERE rn BETWEEN {first} AND {at} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT s.symbol, s.rn, (p.y * {n - 1} + s.{value}) / {n} FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def _ema(n: int) -> float:
    return 2 / (n + 1)


def _wma_sql(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - k} * {_lag(x, k) if k else x}" for k in range(n)) + f") / {n * (n + 1) / 2!r}"


_TP = "(high + low + close) / 3"
_MFM = "CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) END"
_TR = f"tr AS MATERIALIZED (SELECT *, CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) END AS tr FROM x)"
_JOIN = lambda y: f"x LEFT JOIN {y} USING (symbol, rn)"


def _sql_indicators() -> dict[str, str]:
    hi, lo = lambda n: f"max(high) {_w(n)}", lambda n: f"min(low) {_w(n)}"
    mid = lambda n: f"({hi(n)} + {lo(n)}) / 2"
    g = lambda k, e: f"CASE WHEN rn > {k} THEN {e} END"
    out = {
        "sma": sql(_out({"sma": g(4, f"avg(close) {_w(5)}")})),
        "ema": sql(_out({"ema": "y"}, "e"), _rec("e", "x", "close", _ema(10))),
        "wma": sql(_out({"wma": _wma_sql("close", 7)})),
        "hma": sql(_out({"hma": g(10, _wma_sql("raw", 3))}, "h"), f"h AS (SELECT symbol, rn, 2 * {_wma_sql('close', 4)} - {_wma_sql('close', 9)} AS raw FROM x)"),
        "ichimoku": sql(_out({"ichimoku_tenkan": g(51, mid(9)), "ichimoku_kijun": g(51, mid(26)), "ichimoku_senkou_a": g(51, f"({mid(9)} + {mid(26)}) / 2"), "ichimoku_senkou_b": g(51, mid(52)), "ichimoku_chikou": g(51, "close")})),
        "std": sql(_out({"std": g(9, f"stddev_pop(close) {_w(10)}")})),
        "donchian": sql(_out({"donchian_upper": g(19, hi(20)), "donchian_middle": g(19, mid(20)), "donchian_lower": g(19, lo(20))})),
        "williams_r": sql(_out({"williams_r": g(13, f"CASE WHEN {hi(14)} = {lo(14)} THEN -50 ELSE -100 * ({hi(14)} - close) / ({hi(14)} - {lo(14)}) END")})),
        "roc": sql(_out({"roc": f"100 * (close - {_lag('close', 10)}) / {_lag('close', 10)}"})),
        "obv": sql(_out({"obv": f"sum(f) {_ALL}"}, "o"), f"o AS (SELECT *, CASE WHEN close > {_lag('close')} THEN volume WHEN close < {_lag('close')} THEN -volume ELSE 0 END AS f FROM x)"),
        "vroc": sql(_out({"vroc": f"100 * (volume - {_lag('volume', 5)}) / nullif({_lag('volume', 5)}, 0)"})),
        "adl": sql(_out({"adl": f"sum(f) {_ALL}"}, "o"), f"o AS (SELECT *, {_MFM} * volume AS f FROM x)"),
        "cmf": sql(_out({"cmf": g(19, f"sum(f) {_w(20)} / nullif(sum(volume) {_w(20)}, 0)")}, "o"), f"o AS (SELECT *, {_MFM} * volume AS f FROM x)"),
        "vwap": sql(_out({"vwap": f"CASE WHEN sum(volume) {_ALL} = 0 THEN {_TP} ELSE sum({_TP} * volume) {_ALL} / sum(volume) {_ALL} END"})),
    }
    out["dema"] = sql(_out({"dema": "CASE WHEN rn > 8 THEN 2 * e1.y - e2.y END"}, "e1 JOIN e2 USING (symbol, rn)"), _rec("e1", "x", "close", _ema(5)), _rec("e2", "e1", "y", _ema(5)))
    out["tema"] = sql(_out({"tema": "CASE WHEN rn > 12 THEN 3 * e1.y - 3 * e2.y + e3.y END"}, "e1 JOIN e2 USING (symbol, rn) JOIN e3 USING (symbol, rn)"),
                      _rec("e1", "x", "close", _ema(5)), _rec("e2", "e1", "y", _ema(5)), _rec("e3", "e2", "y", _ema(5)))
    out["macd"] = sql(_out({"macd_macd": "l.y", "macd_signal": "g.y", "macd_histogram": "l.y - g.y"}, "l JOIN g USING (symbol, rn)"),
                      _rec("f", "x", "close", _ema(12)), _rec("s", "x", "close", _ema(26)), "l AS (SELECT symbol, rn, f.y - s.y AS y FROM f JOIN s USING (symbol, rn))", _rec("g", "l", "y", _ema(9)))
    d = f"close - {_lag('close')}"
    out["rsi"] = sql(_out({"rsi": "CASE WHEN l.y = 0 THEN CASE WHEN g.y = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + g.y / l.y) END"}, "x LEFT JOIN g USING (symbol, rn) LEFT JOIN l USING (symbol, rn)"),
                     f"d AS MATERIALIZED (SELECT symbol, rn, greatest({d}, 0) AS up, greatest(-({d}), 0) AS down FROM x)", _wilder("g", "d", "up", 14, 2), _wilder("l", "d", "down", 14, 2))
    out["atr"] = sql(_out({"atr": "y"}, _JOIN("a")), _TR, _wilder("a", "tr", "tr", 14))
    out["adx"] = sql(_out({"adx_plus_di": "CASE WHEN a.y IS NOT NULL THEN p END", "adx_minus_di": "CASE WHEN a.y IS NOT NULL THEN m END", "adx_adx": "a.y"}, "x LEFT JOIN dx USING (symbol, rn) LEFT JOIN a USING (symbol, rn)"), _TR,
                     f"""dm AS MATERIALIZED (SELECT symbol, rn, tr, CASE WHEN high - {_lag('high')} > {_lag('low')} - low AND high > {_lag('high')} THEN high - {_lag('high')} ELSE 0.0 END AS pdm,
                       CASE WHEN {_lag('low')} - low > high - {_lag('high')} AND low < {_lag('low')} THEN {_lag('low')} - low ELSE 0.0 END AS mdm FROM tr)""",
                     _wilder("st", "dm", "tr", 7, 2), _wilder("sp", "dm", "pdm", 7, 2), _wilder("sm", "dm", "mdm", 7, 2),
                     """dx AS MATERIALIZED (SELECT symbol, rn, p, m, CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS dx
                       FROM (SELECT symbol, rn, 100 * sp.y / st.y AS p, 100 * sm.y / st.y AS m FROM st JOIN sp USING (symbol, rn) JOIN sm USING (symbol, rn)))""", _wilder("a", "dx", "dx", 7, 8))  # fmt: skip
    out["sar"] = sql("SELECT symbol, rn, round(shown, 6) AS sar FROM x LEFT JOIN s USING (symbol, rn)",
        f"z AS MATERIALIZED (SELECT *, {_lag('high')} AS ph, {_lag('low')} AS pl FROM x)",
        """t AS (SELECT symbol, rn, shown, long, CASE WHEN long THEN least(shown + af * (ep - shown), pl, low) ELSE greatest(shown + af * (ep - shown), ph, high) END AS sar, ep, af FROM (
             SELECT *, 0.02 + CASE WHEN FALSE THEN 0.02 ELSE 0 END AS af, CASE WHEN long THEN pl ELSE ph END AS shown, CASE WHEN long THEN greatest(high, ph) ELSE least(low, pl) END AS ep FROM (SELECT *, close >= (ph + pl) / 2 AS long FROM z WHERE rn = 2))
           UNION ALL
           SELECT symbol, rn, CASE WHEN flip THEN ep0 ELSE sar0 END, CASE WHEN flip THEN NOT long0 ELSE long0 END,
             CASE WHEN flip THEN ep0 WHEN long0 THEN least(sar0 + af1 * (ep1 - sar0), pl, low) ELSE greatest(sar0 + af1 * (ep1 - sar0), ph, high) END,
             CASE WHEN flip THEN CASE WHEN long0 THEN low ELSE high END ELSE ep1 END, CASE WHEN flip THEN 0.02 ELSE af1 END
           FROM (SELECT *, CASE WHEN long0 THEN low < sar0 ELSE high > sar0 END AS flip, CASE WHEN long0 THEN greatest(ep0, high) ELSE least(ep0, low) END AS ep1,
                   CASE WHEN (CASE WHEN long0 THEN high > ep0 ELSE low < ep0 END) THEN least(af0 + 0.02, 0.20) ELSE af0 END AS af1
                 FROM (SELECT z.*, t.sar AS sar0, t.long AS long0, t.ep AS ep0, CAST(t.af AS DOUBLE) AS af0 FROM t JOIN z ON z.symbol = t.symbol AND z.rn = t.rn + 1)))""",
        "s AS (SELECT symbol, rn, shown FROM t)").replace("0.02 + CASE WHEN FALSE THEN 0.02 ELSE 0 END AS af", "CAST(0.02 AS DOUBLE) AS af").replace("THEN 0.02 ELSE af1 END", "THEN CAST(0.02 AS DOUBLE) ELSE af1 END")
    h, l, c = "ph", "pl", "pc"
    prev = f"pv AS (SELECT symbol, rn, {_lag('high')} AS ph, {_lag('low')} AS pl, {_lag('close')} AS pc FROM x)"
    pp, span = f"(({h} + {l} + {c}) / 3)", f"({h} - {l})"
    classic = {"pp": pp, "r1": f"2 * {pp} - {l}", "r2": f"{pp} + {span}", "r3": f"{h} + 2 * ({pp} - {l})", "s1": f"2 * {pp} - {h}", "s2": f"{pp} - {span}", "s3": f"{l} - 2 * ({h} - {pp})"}
    fib = {"pp": pp} | {f"{s}{i}": f"{pp} {o} {f} * {span}" for s, o in (("r", "+"), ("s", "-")) for i, f in ((1, 0.382), (2, 0.618), (3, 1.0))}
    cam = {"pp": pp} | {f"{s}{i}": f"{c} {o} {span} * 1.1 / {f}" for s, o in (("r", "+"), ("s", "-")) for i, f in ((1, 12), (2, 6), (3, 4), (4, 2))}
    for name, levels in (("pivot_classic", classic), ("pivot_fibonacci", fib), ("pivot_camarilla", cam)):
        out[name] = sql(_out({f"{name}_{k}": e for k, e in levels.items()}, "pv"), prev)
    k = f"CASE WHEN rn >= 14 THEN CASE WHEN {hi(14)} = {lo(14)} THEN 50 ELSE 100 * (close - {lo(14)}) / ({hi(14)} - {lo(14)}) END END"
    out["stochastic"] = sql(_out({"stochastic_k": g(15, "k"), "stochastic_d": g(15, f"avg(k) {_w(3)}")}, "s"), f"s AS (SELECT symbol, rn, {k} AS k FROM x)")
    out["cci"] = sql(_out({"cci": g(19, "CASE WHEN mad = 0 THEN 0 ELSE (tp - mean) / (0.015 * mad) END")}, "q"),
                     f"t AS (SELECT symbol, rn, {_TP} AS tp, list({_TP}) {_w(20)} AS tps, avg({_TP}) {_w(20)} AS mean FROM x)", "q AS (SELECT *, list_sum(list_transform(tps, lambda v: abs(v - mean))) / 20 AS mad FROM t)")
    out["bollinger"] = sql(_out({"bollinger_middle": "m", "bollinger_upper": "m + 2 * d", "bollinger_lower": "m - 2 * d", "bollinger_bandwidth": "4 * d / m"}, "q"),
                           f"q AS (SELECT symbol, rn, {g(19, f'avg(close) {_w(20)}')} AS m, stddev_pop(close) {_w(20)} AS d FROM x)")
    out["keltner"] = sql(_out({"keltner_middle": "m", "keltner_upper": "m + 2 * a", "keltner_lower": "m - 2 * a", "keltner_bandwidth": "4 * a / m"}, "q"), _TR, _rec("e", "x", "close", _ema(20)), _wilder("w", "tr", "tr", 10),
                         "q AS (SELECT symbol, rn, CASE WHEN rn >= 20 THEN e.y END AS m, w.y AS a FROM e LEFT JOIN w USING (symbol, rn))")
    out["keltner_price"] = sql(_out({"keltner_price": "CASE WHEN rn > 19 THEN y END"}, "e"), _rec("e", "x", "close", _ema(20)))
    out["mfi"] = sql(_out({"mfi": g(14, "CASE WHEN dn = 0 THEN CASE WHEN up = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + up / dn) END")}, "q"),
                     f"t AS (SELECT symbol, rn, {_TP} AS tp, volume FROM x)", f"u AS (SELECT *, CASE WHEN tp > {_lag('tp')} THEN tp * volume ELSE 0 END AS f, CASE WHEN tp < {_lag('tp')} THEN tp * volume ELSE 0 END AS d FROM t)",
                     f"q AS (SELECT symbol, rn, sum(f) {_w(14)} AS up, sum(d) {_w(14)} AS dn FROM u)")
    out["heikin_ashi"] = sql(_out({"heikin_ashi_open": "ho", "heikin_ashi_high": "greatest(high, ho, hc)", "heikin_ashi_low": "least(low, ho, hc)", "heikin_ashi_close": "hc"}, "x JOIN h USING (symbol, rn)"),
                             """h AS (SELECT symbol, rn, (open + close) / 2 AS ho, (open + high + low + close) / 4 AS hc FROM x WHERE rn = 1
                               UNION ALL SELECT s.symbol, s.rn, (p.ho + p.hc) / 2, (s.open + s.high + s.low + s.close) / 4 FROM h p JOIN x s ON s.symbol = p.symbol AND s.rn = p.rn + 1)""")  # fmt: skip
    return out


INDICATORS: dict[str, tuple[Indicator, tuple[str, ...]]] = {
    "sma": (T.Sma(5), ()), "ema": (T.Ema(10), ()), "wma": (T.Wma(7), ()), "dema": (T.Dema(5), ()), "tema": (T.Tema(5), ()), "hma": (T.Hma(9), ()), "macd": (T.Macd(), ()),
    "adx": (T.Adx(7), ()), "sar": (T.ParabolicSar(), ()), "ichimoku": (T.Ichimoku(), ()), "pivot_classic": (T.Pivots("classic"), ("pivot_classic_r4", "pivot_classic_s4")),
    "pivot_fibonacci": (T.Pivots("fibonacci"), ("pivot_fibonacci_r4", "pivot_fibonacci_s4")), "pivot_camarilla": (T.Pivots("camarilla"), ()), "rsi": (M.Rsi(14), ()),
    "stochastic": (M.Stochastic(14, 3), ()), "williams_r": (M.WilliamsR(14), ()), "cci": (M.Cci(20), ()), "atr": (V.Atr(14), ()), "bollinger": (V.Bollinger(20, 2.0), ()),
    "keltner": (V.Keltner(20, 10, 2.0), ()), "keltner_price": (V.KeltnerPrice(20, 10), ()), "donchian": (V.Donchian(20), ()), "std": (V.Std(10), ()), "obv": (U.Obv(), ()),
    "vroc": (U.Vroc(5), ()), "roc": (M.Roc(10), ()), "adl": (U.Adl(), ()), "cmf": (U.Cmf(20), ()), "mfi": (U.Mfi(14), ()), "vwap": (U.Vwap(), ()), "heikin_ashi": (T.HeikinAshi(), ()),
}


# --- signals --------------------------------------------------------------------------------


def _with_averages(spark: SparkSession, sf: str) -> DataFrame:
    df = add_indicators(numbered(spark, sf), {"fast": T.Sma(5), "slow": T.Sma(20), "don": V.Donchian(10)})
    return df.withColumns({"up": F.lag("don_upper").over(C.window()), "low_band": F.lag("don_lower").over(C.window())})


_AVERAGES = f"""a AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) {_w(5)} END AS fast, CASE WHEN rn >= 20 THEN avg(close) {_w(20)} END AS slow,
  CASE WHEN rn >= 10 THEN max(high) {_w(10)} END AS du, CASE WHEN rn >= 10 THEN min(low) {_w(10)} END AS dl FROM x),
s AS (SELECT *, {_lag('fast')} AS pf, {_lag('slow')} AS ps, {_lag('close')} AS pc, {_lag('du')} AS up, {_lag('dl')} AS low_band FROM a),
v AS (SELECT *, CASE WHEN pf IS NULL OR ps IS NULL OR fast IS NULL OR slow IS NULL THEN NULL WHEN pf <= ps AND fast > slow THEN 'LONG' ELSE 'HOLD' END AS cu,
  CASE WHEN pf IS NULL OR ps IS NULL OR fast IS NULL OR slow IS NULL THEN NULL WHEN pf >= ps AND fast < slow THEN 'SHORT' ELSE 'HOLD' END AS cd,
  CASE WHEN pc IS NULL THEN NULL WHEN pc <= 100 AND close > 100 THEN 'LONG' ELSE 'HOLD' END AS ta,
  CASE WHEN pc IS NULL THEN NULL WHEN pc >= 100 AND close < 100 THEN 'SHORT' ELSE 'HOLD' END AS tb, {_lag('up')} AS pup, {_lag('low_band')} AS plow FROM s)"""


def _signal(name: str, make: Callable[[], Column]) -> Query:
    return lambda spark, sf: _with_averages(spark, sf).withColumn(name, make()).select("symbol", "rn", name)


def _combined(name: str, make: Callable[[Column, Column], Column]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _with_averages(spark, sf).withColumns({"cu": S.cross_up("fast", "slow"), "ta": S.threshold_above("close", 100)})
        return df.withColumn(name, make(F.col("cu"), F.col("ta"))).select("symbol", "rn", name)

    return run


def _divergence(spark: SparkSession, sf: str) -> DataFrame:
    df = add_indicators(numbered(spark, sf), {"osc": M.WilliamsR(5)}).where("osc IS NOT NULL")
    return S.Divergence(2).apply(df, "close", "osc").select("symbol", "rn", "divergence")


_DIVERGENCE = sql(
    """SELECT symbol, rn, CASE WHEN k <= 4 THEN NULL WHEN hi AND k - ph.k >= 3 AND c > ph.c AND o < ph.o THEN 'SHORT' WHEN lo AND k - pl.k >= 3 AND c < pl.c AND o > pl.o THEN 'LONG' ELSE 'HOLD' END AS divergence
       FROM (SELECT *, last_value(CASE WHEN hi THEN {'c': c, 'o': o, 'k': k} END IGNORE NULLS) OVER pw AS ph, last_value(CASE WHEN lo THEN {'c': c, 'o': o, 'k': k} END IGNORE NULLS) OVER pw AS pl
             FROM p WINDOW pw AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    f"""w AS (SELECT symbol, rn, close, CASE WHEN rn > 4 THEN CASE WHEN max(high) {_w(5)} = min(low) {_w(5)} THEN -50 ELSE -100 * (max(high) {_w(5)} - close) / (max(high) {_w(5)} - min(low) {_w(5)}) END END AS osc FROM x)""",
    "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM w WHERE osc IS NOT NULL)",
    """m AS (SELECT *, lag(close, 2) OVER q AS c, lag(osc, 2) OVER q AS o, lag(close, 4) OVER q AS c4, lag(close, 3) OVER q AS c3, lag(close, 1) OVER q AS c1 FROM n WINDOW q AS (PARTITION BY symbol ORDER BY k))""",
    "p AS (SELECT *, k > 4 AND c > c4 AND c > c3 AND c > c1 AND c > close AS hi, k > 4 AND c < c4 AND c < c3 AND c < c1 AND c < close AS lo FROM m)",
)


def crossover(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: bars, two averages, and the bars at which they cross."""
    df = _with_averages(spark, sf).withColumn("signal", S.either(S.cross_up("fast", "slow"), S.cross_down("fast", "slow")))
    return df.where("signal IN ('LONG', 'SHORT')").select("symbol", "rn", "signal", _r("close"), _r("fast"), _r("slow"))


# --- patterns -------------------------------------------------------------------------------


def _patterns(names: tuple[str, ...]) -> Query:
    return lambda spark, sf: P.add_patterns(numbered(spark, sf), names).select("symbol", "rn", *names)


def _pattern_sql() -> dict[str, str]:
    lags = ", ".join(f"{_lag(c, k)} AS {c[0]}{k}" for k in (1, 2) for c in ("open", "high", "low", "close"))
    geometry = f"""k AS (SELECT *, abs(c0 - o0) AS b0, h0 - l0 AS r0, h0 - greatest(o0, c0) AS u0, least(o0, c0) - l0 AS d0, abs(c1 - o1) AS b1, h1 - l1 AS r1, c0 >= o0 AS up0, c1 >= o1 AS up1, c2 >= o2 AS up2
      FROM (SELECT symbol, rn, open AS o0, high AS h0, low AS l0, close AS c0, {lags} FROM x))"""
    hammer, inverted = "b0 > 0 AND d0 >= 2 * b0 AND u0 <= 0.5 * b0", "b0 > 0 AND u0 >= 2 * b0 AND d0 <= 0.5 * b0"
    t = {
        "doji": "r0 > 0 AND b0 <= 0.1 * r0", "hammer": hammer, "hanging_man": hammer, "inverted_hammer": inverted, "shooting_star": inverted,
        "bullish_marubozu": "up0 AND r0 > 0 AND b0 >= 0.95 * r0", "bearish_marubozu": "NOT up0 AND r0 > 0 AND b0 >= 0.95 * r0",
        "bullish_engulfing": "NOT up1 AND up0 AND o0 <= c1 AND c0 >= o1", "bearish_engulfing": "up1 AND NOT up0 AND o0 >= c1 AND c0 <= o1",
        "bullish_harami": "NOT up1 AND up0 AND o0 >= c1 AND c0 <= o1 AND b0 < b1", "bearish_harami": "up1 AND NOT up0 AND c0 >= o1 AND o0 <= c1 AND b0 < b1",
        "morning_star": "NOT up2 AND up0 AND r1 > 0 AND b1 <= 0.3 * r1 AND c0 > (o2 + c2) / 2", "evening_star": "up2 AND NOT up0 AND r1 > 0 AND b1 <= 0.3 * r1 AND c0 < (o2 + c2) / 2",
        "three_white_soldiers": "up2 AND up1 AND up0 AND c1 > c2 AND c0 > c1 AND o1 BETWEEN o2 AND c2 AND o0 BETWEEN o1 AND c1",
        "three_black_crows": "NOT up2 AND NOT up1 AND NOT up0 AND c1 < c2 AND c0 < c1 AND o1 BETWEEN c2 AND o2 AND o0 BETWEEN c1 AND o1",
    }
    t = {k: f"coalesce({v}, false)" for k, v in t.items()}
    out = {n: sql(f"SELECT symbol, rn, {', '.join(f'{t[x]} AS {x}' for x in names)} FROM k", geometry) for n, names in (("patterns_single", P.SINGLE), ("patterns_double", P.DOUBLE), ("patterns_triple", P.TRIPLE))}
    rows = " UNION ALL ".join(f"SELECT symbol, rn, {i} AS place, '{n}' AS kind, '{b}' AS bias FROM k WHERE {t[n]}" for i, (n, b) in enumerate(P.SCAN))
    return out | {"pattern_scan": sql(rows, geometry)}


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    place = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in P.SCAN]), F.array(*[F.lit(i) for i in range(len(P.SCAN))]))
    return P.scan(numbered(spark, sf)).select("symbol", "rn", F.explode("patterns").alias("p")).select("symbol", "rn", place[F.col("p.kind")].alias("place"), "p.kind", "p.bias")


# --- sizing ---------------------------------------------------------------------------------

_SIZES: dict[str, tuple[Callable[[], Column], str]] = {
    "kelly": (lambda: Z.kelly(F.col("volume") / (F.col("volume") + 2), F.col("high") + 1, F.col("low") + 1),
              "greatest(0, least(1, ((high + 1) / (low + 1) * (volume / (volume + 2)) - (1 - volume / (volume + 2))) / ((high + 1) / (low + 1))))"),
    "fractional_kelly": (lambda: Z.fractional_kelly(F.col("volume") / (F.col("volume") + 2), F.col("high") + 1, F.col("low") + 1, F.lit(0.5)),
                         "0.5 * greatest(0, least(1, ((high + 1) / (low + 1) * (volume / (volume + 2)) - (1 - volume / (volume + 2))) / ((high + 1) / (low + 1))))"),
    "fixed_fractional": (lambda: Z.fixed_fractional(F.col("close") / 100 - 0.2), "CASE WHEN close / 100 - 0.2 <= 0 THEN 0 ELSE least(1, close / 100 - 0.2) END"),
    "risk_based": (lambda: Z.risk_based(F.lit(10000.0), F.lit(0.01), F.col("close"), F.col("low")), "CASE WHEN close <= 0 OR low <= 0 OR close = low THEN 0 ELSE 100.0 / abs(close - low) END"),
    "vol_targeted": (lambda: Z.volatility_targeted(F.lit(10000.0), F.lit(0.1), F.col("high") - F.col("low")), "CASE WHEN high - low <= 0 THEN 0 ELSE 1000.0 / (high - low) END"),
}


def _sized(name: str) -> Query:
    return lambda spark, sf: numbered(spark, sf).select("symbol", "rn", _r(_SIZES[name][0](), name))


# --- backtests ------------------------------------------------------------------------------

_CONFIG = B.Config(fee=0.001, slippage=0.0005)


def _acted(bars: DataFrame, g: dict) -> DataFrame:
    df = add_indicators(bars, {"fast": T.Sma(g["fast"]), "slow": T.Sma(g["slow"])})
    return df.withColumn("action", B.action_of(S.either(S.cross_up("fast", "slow"), S.cross_down("fast", "slow"))))


def _backtest(spark: SparkSession, sf: str) -> B.Result:
    return B.run(_acted(numbered(spark, sf), {"fast": 5, "slow": 20}).withColumn("seq", F.col("rn").cast("long")), config=_CONFIG)


def _equity(spark: SparkSession, sf: str) -> DataFrame:
    return _backtest(spark, sf).equity.select("symbol", (F.col("bar") + 1).cast("int").alias("rn"), _r("equity"), _r("cash"), _r("position"))


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    t = _backtest(spark, sf).trades
    return t.select("symbol", F.col("exit_seq").cast("int").alias("rn"), "side", *[_r(c) for c in ("quantity", "entry_price", "exit_price", "pnl", "fees")])


_METRICS = ("final_equity", "total_return", "max_drawdown", "sharpe", "win_rate", "profit_factor")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _backtest(spark, sf).metrics.select("symbol", "trade_count", *map(_r, _METRICS))


_GRID = [{"fast": 5, "slow": 20}, {"fast": 3, "slow": 10}]


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    bars = numbered(spark, sf).withColumn("seq", F.col("rn").cast("long"))
    periods = sorted({n for g in _GRID for n in g.values()})
    averages = lambda df: add_indicators(df, {f"sma_{n}": T.Sma(n) for n in periods})
    crossing = lambda df, g: df.withColumn("action", B.action_of(S.either(*(f(f"sma_{g['fast']}", f"sma_{g['slow']}") for f in (S.cross_up, S.cross_down)))))
    return B.sweep(bars, _GRID, crossing, prepare=averages, config=_CONFIG).select("symbol", "param_id", "trade_count", *map(_r, _METRICS))


class _Crossing(B.Strategy):
    """The crossover as a strategy object with averages of its own."""

    def on_start(self, context: B.Context) -> None:
        self.signal = S.LiveSignal("either", legs=tuple(S.LiveSignal(k, ((T.Sma(5), ""), (T.Sma(20), ""))) for k in ("cross_up", "cross_down"))).start()

    def on_candle(self, bar: dict, context: B.Context) -> B.Action:
        return B.Action({"LONG": B.ENTER_LONG, "SHORT": B.ENTER_SHORT}.get(self.signal.next(bar)[""], B.HOLD))


def _strategy(spark: SparkSession, sf: str) -> DataFrame:
    t = B.run(numbered(spark, sf).withColumn("seq", F.col("rn").cast("long")), _Crossing(), config=_CONFIG).trades
    return t.select("symbol", F.col("exit_seq").cast("int").alias("rn"), "side", *[_r(c) for c in ("quantity", "entry_price", "exit_price", "pnl", "fees")])


def _percent(spark: SparkSession, sf: str) -> DataFrame:
    r = B.run(_acted(numbered(spark, sf), {"fast": 5, "slow": 20}).withColumn("seq", F.col("rn").cast("long")), quantity=B.Quantity("percent_cash", 0.25), config=_CONFIG)
    return r.equity.select("symbol", F.col("seq").cast("int").alias("rn"), *[_r(c) for c in ("equity", "cash", "position", "entry_price")])


def _fold_sql(fast: int, slow: int, share: str = "1.0") -> tuple[str, ...]:
    """The backtest as a recursion over bars: state is cash, side, quantity and entry price."""
    fee, slip = _CONFIG.fee, _CONFIG.slippage
    buy, sell = f"(close * {1 + slip!r})", f"(close * {1 - slip!r})"
    return (
        f"av AS (SELECT *, CASE WHEN rn >= {fast} THEN avg(close) {_w(fast)} END AS fast, CASE WHEN rn >= {slow} THEN avg(close) {_w(slow)} END AS slow FROM x)",
        f"""ac AS MATERIALIZED (SELECT *, CASE WHEN {_lag('fast')} <= {_lag('slow')} AND fast > slow THEN 1 WHEN {_lag('fast')} >= {_lag('slow')} AND fast < slow THEN -1 ELSE 0 END AS act FROM av)""",
        f"""f AS (SELECT symbol, CAST(0 AS INTEGER) AS rn, CAST({_CONFIG.cash!r} AS DOUBLE) AS cash, CAST(0 AS INTEGER) AS side, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS entry,
               CAST(0 AS DOUBLE) AS close, false AS closed, CAST(0 AS INTEGER) AS was, CAST(0 AS DOUBLE) AS wq, CAST(0 AS DOUBLE) AS wentry, CAST(0 AS DOUBLE) AS exit FROM (SELECT DISTINCT symbol FROM x)
             UNION ALL
             SELECT symbol, rn, CASE WHEN opens THEN CASE WHEN act = 1 THEN c1 - units * {buy} * {1 + fee!r} ELSE c1 + units * {sell} * {1 - fee!r} END ELSE c1 END, CASE WHEN opens THEN act WHEN closes THEN 0 ELSE side END,
               CASE WHEN opens THEN units ELSE q END, CASE WHEN opens THEN CASE WHEN act = 1 THEN {buy} ELSE {sell} END ELSE entry END, close, closes, side, q, entry, ex
             FROM (SELECT *, act <> 0 AND (side = 0 OR closes) AND c1 > 0 AS opens, {share} * c1 / (CASE WHEN act = 1 THEN {buy} ELSE {sell} END * {1 + fee!r}) AS units
               FROM (SELECT *, CASE WHEN closes THEN cash + side * q * ex - q * ex * {fee!r} ELSE cash END AS c1
                 FROM (SELECT p.cash, p.side, p.q, p.entry, s.symbol, s.rn, s.close, s.act, s.act <> 0 AND p.side = -s.act AS closes, CASE WHEN p.side = 1 THEN s.close * {1 - slip!r} ELSE s.close * {1 + slip!r} END AS ex
                       FROM f p JOIN ac s ON s.symbol = p.symbol AND s.rn = p.rn + 1))))""",
        f"""eq AS (SELECT symbol, rn, cash, side * q AS position, CASE WHEN side = 0 THEN cash ELSE cash + side * q * close END AS equity, CASE WHEN side <> 0 THEN entry END AS entry_price FROM f WHERE rn > 0)""",
        f"""tr AS (SELECT symbol, rn, CASE WHEN was = 1 THEN 'LONG' ELSE 'SHORT' END AS side, wq AS quantity, wentry AS entry_price, exit AS exit_price,
               was * wq * (exit - wentry) - (wentry + exit) * wq * {fee!r} AS pnl, (wentry + exit) * wq * {fee!r} AS fees FROM f WHERE closed)""",
    )


def _metric_sql(extra: str = "") -> str:
    cash = _CONFIG.cash
    return f"""SELECT symbol, {extra} coalesce(n, 0) AS trade_count, round(final_equity, 6) AS final_equity, round((final_equity - {cash!r}) / {cash!r}, 6) AS total_return, round(greatest(dd, 0), 6) AS max_drawdown,
      round(CASE WHEN rs IS NULL OR rs = 0 THEN 0 ELSE rm / rs * sqrt(252) END, 6) AS sharpe, round(CASE WHEN n IS NULL THEN 0 ELSE wins / n END, 6) AS win_rate,
      round(CASE WHEN n IS NULL THEN 0 WHEN loss = 0 THEN CAST('Infinity' AS DOUBLE) ELSE gain / abs(loss) END, 6) AS profit_factor
      FROM (SELECT symbol, arg_max(equity, rn) AS final_equity, max((peak - equity) / peak) AS dd, avg(r) AS rm, stddev_samp(r) AS rs FROM
              (SELECT *, greatest({cash!r}, max(equity) {_ALL}) AS peak, CASE WHEN {_lag('equity')} > 0 THEN (equity - {_lag('equity')}) / {_lag('equity')} END AS r FROM eq) GROUP BY symbol)
      LEFT JOIN (SELECT symbol, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(sum(pnl) FILTER (pnl <= 0), 0) AS loss FROM tr GROUP BY symbol) USING (symbol)"""


# --- csv ------------------------------------------------------------------------------------


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    df = numbered(spark, sf).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    out = enriched(df, {"sma_5": T.Sma(5), "ema_10": T.Ema(10), "obv": U.Obv()})
    return out.select("symbol", "Date", F.date_format("ts", "HH").alias("Hour"), *[_r(x) for x in ("Open", "High", "Low", "Close", "Volume", "ema_10", "obv", "sma_5")])


_CSV = sql(
    f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS "Date", strftime(ts, '%H') AS "Hour", round(open, 6) AS "Open", round(high, 6) AS "High", round(low, 6) AS "Low", round(close, 6) AS "Close", round(volume, 6) AS "Volume",
      round(e.y, 6) AS ema_10, round(sum(f) {_ALL}, 6) AS obv, round(CASE WHEN rn >= 5 THEN avg(close) {_w(5)} END, 6) AS sma_5 FROM o JOIN e USING (symbol, rn)""",
    _rec("e", "x", "close", _ema(10)), f"o AS (SELECT *, CASE WHEN close > {_lag('close')} THEN volume WHEN close < {_lag('close')} THEN -volume ELSE 0 END AS f FROM x)",
)


def _csv_read(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of each event type as CSV files, read by position with a date format, and averaged."""
    bars, folder = hourly_bars(spark, sf).withColumn("date", F.date_format("ts", "yyyy-MM-dd HH")), shared_folder(spark, "csv")
    read = None
    for name in sorted(r["symbol"] for r in bars.select("symbol").distinct().collect()):
        write_csv(enriched(bars.where(F.col("symbol") == name), {}), f"{folder}/{name}")
        one = read_csv(spark, f"{folder}/{name}", CsvLayout(date_format="%Y-%m-%d %H"), symbol=name)
        read = one if read is None else read.unionAll(one)
    df = add_indicators(read, {"sma": T.Sma(5)})
    return df.select("symbol", "date", F.date_format("ts", "yyyy-MM-dd HH").alias("parsed"), *[_r(x) for x in ("open", "high", "low", "close", "volume", "sma")])


_CSV_READ = sql("SELECT symbol, strftime(ts, '%Y-%m-%d %H') AS date, strftime(ts, '%Y-%m-%d %H') AS parsed, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("open", "high", "low", "close", "volume")) + f", round(CASE WHEN rn >= 5 THEN avg(close) {_w(5)} END, 6) AS sma FROM x")


def _std_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(spark, sf).groupBy("symbol").agg(_r(V.standard_deviation(F.col("close")), "std"))


def _adx_flat(spark: SparkSession, sf: str) -> DataFrame:
    """Bars 1 to 9 and 40 to 52 of every symbol stand still."""
    still = F.col("rn").between(1, 9) | F.col("rn").between(40, 52)
    df = numbered(spark, sf).withColumns({x: F.when(still, F.lit(50.0)).otherwise(F.col(x)) for x in ("open", "high", "low", "close")})
    return add_indicators(df, {"adx": T.Adx(4)}).select("symbol", "rn", *map(_r, ("adx_plus_di", "adx_minus_di", "adx_adx")))


def _adx_flat_sql() -> str:
    still = "rn BETWEEN 1 AND 9 OR rn BETWEEN 40 AND 52"
    return sql(
        _out({"adx_plus_di": "CASE WHEN t = 0 THEN 0 WHEN a.y IS NOT NULL THEN p END", "adx_minus_di": "CASE WHEN t = 0 THEN 0 WHEN a.y IS NOT NULL THEN m END", "adx_adx": "CASE WHEN t = 0 THEN 0 ELSE a.y END"},
             "(SELECT w.symbol, w.rn, di.t, di.p, di.m, ks.k FROM w LEFT JOIN di USING (symbol, rn) LEFT JOIN ks USING (symbol, rn)) z LEFT JOIN (SELECT symbol, rn AS k, y FROM a) a USING (symbol, k)"),
        f"w AS MATERIALIZED (SELECT symbol, rn, " + ", ".join(f"CASE WHEN {still} THEN 50.0 ELSE {x} END AS {x}" for x in ("high", "low", "close")) + " FROM x)",
        f"""dm AS MATERIALIZED (SELECT symbol, rn, greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) AS tr,
          CASE WHEN high - {_lag('high')} > {_lag('low')} - low AND high > {_lag('high')} THEN high - {_lag('high')} ELSE 0.0 END AS pdm,
          CASE WHEN {_lag('low')} - low > high - {_lag('high')} AND low < {_lag('low')} THEN {_lag('low')} - low ELSE 0.0 END AS mdm FROM w)""",
        _wilder("st", "dm", "tr", 4, 2), _wilder("sp", "dm", "pdm", 4, 2), _wilder("sm", "dm", "mdm", 4, 2),
        "di AS MATERIALIZED (SELECT symbol, rn, st.y AS t, 100 * sp.y / nullif(st.y, 0) AS p, 100 * sm.y / nullif(st.y, 0) AS m FROM st JOIN sp USING (symbol, rn) JOIN sm USING (symbol, rn))",
        "ks AS MATERIALIZED (SELECT symbol, rn, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k, CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS dx FROM di WHERE t <> 0)",
        "kx AS MATERIALIZED (SELECT symbol, CAST(k AS INTEGER) AS rn, dx FROM ks)", _wilder("a", "kx", "dx", 4),
    )


def _bars_query(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(spark, sf).select("symbol", "rn", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), *[_r(x) for x in ("open", "high", "low", "close", "volume")])


_SIGNALS: dict[str, tuple[Query, str]] = {
    "cross_up": (_signal("cross_up", lambda: S.cross_up("fast", "slow")), "cu"), "cross_down": (_signal("cross_down", lambda: S.cross_down("fast", "slow")), "cd"),
    "threshold_above": (_signal("threshold_above", lambda: S.threshold_above("close", 100)), "ta"), "threshold_below": (_signal("threshold_below", lambda: S.threshold_below("close", 100)), "tb"),
    "breakout": (_signal("breakout", lambda: S.breakout("close", "up", "low_band")),
                 "CASE WHEN pup IS NULL OR up IS NULL THEN NULL WHEN pc BETWEEN plow AND pup AND close > up THEN 'LONG' WHEN pc BETWEEN plow AND pup AND close < low_band THEN 'SHORT' ELSE 'HOLD' END"),
    "signal_and": (_combined("signal_and", S.both), "CASE WHEN cu = 'LONG' AND ta = 'LONG' THEN 'LONG' WHEN cu IS NOT NULL AND ta IS NOT NULL THEN 'HOLD' END"),
    "signal_or": (_combined("signal_or", S.either), "CASE WHEN cu = 'LONG' OR ta = 'LONG' THEN 'LONG' WHEN cu = 'HOLD' OR ta = 'HOLD' THEN 'HOLD' END"),
    "signal_not": (_combined("signal_not", lambda a, b: S.inverse(a)), "CASE WHEN cu = 'LONG' THEN 'SHORT' ELSE cu END"),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"sma_crossover": crossover, "ohlcv_bars": _bars_query}
    out |= {n: indicator_query(n, i, skip) for n, (i, skip) in INDICATORS.items()}
    out |= {n: q for n, (q, _) in _SIGNALS.items()}
    out |= {"divergence": _divergence, "patterns_single": _patterns(P.SINGLE), "patterns_double": _patterns(P.DOUBLE), "patterns_triple": _patterns(P.TRIPLE), "pattern_scan": _scan}
    out |= {n: _sized(n) for n in _SIZES}
    return out | {"backtest_equity": _equity, "backtest_trades": _trades, "backtest_metrics": _metrics, "backtest_sweep": _sweep, "csv_enrich": _csv, "csv_read": _csv_read, "strategy_object": _strategy, "quantity_percent": _percent,
                  "ema_initial": indicator_query("ema_initial", T.Ema(10, initial=100.0)), "adx_flat": _adx_flat, "std_aggregate": _std_aggregate}


def oracle_sql() -> dict[str, str]:
    out = _sql_indicators() | _pattern_sql()
    out["ohlcv_bars"] = sql("SELECT symbol, rn, strftime(ts, '%Y-%m-%d %H') AS hour, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM x")
    out["sma_crossover"] = sql("SELECT symbol, rn, CASE WHEN cu = 'LONG' THEN 'LONG' ELSE 'SHORT' END AS signal, round(close, 6) AS close, round(fast, 6) AS fast, round(slow, 6) AS slow FROM v WHERE cu = 'LONG' OR cd = 'SHORT'", _AVERAGES)
    out |= {n: sql(f"SELECT symbol, rn, {e} AS {n} FROM v", _AVERAGES) for n, (_, e) in _SIGNALS.items()}
    out["divergence"] = _DIVERGENCE
    out |= {n: sql(_out({n: e})) for n, (_, e) in _SIZES.items()}
    fold = _fold_sql(5, 20)
    out["backtest_equity"] = sql("SELECT symbol, rn, round(equity, 6) AS equity, round(cash, 6) AS cash, round(position, 6) AS position FROM eq", *fold)
    out["backtest_trades"] = sql("SELECT symbol, rn, side, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("quantity", "entry_price", "exit_price", "pnl", "fees")) + " FROM tr", *fold)
    out["backtest_metrics"] = sql(_metric_sql(), *fold)
    out["backtest_sweep"] = " UNION ALL ".join(f"SELECT * FROM ({sql(_metric_sql(f'{i} AS param_id,'), *_fold_sql(g['fast'], g['slow']))})" for i, g in enumerate(_GRID))
    a = _ema(10)
    out["ema_initial"] = sql(_out({"ema_initial": "y"}, "e"), _rec("e", "x", "close", a).replace("close AS y", f"{a!r} * close + {(1 - a) * 100!r} AS y", 1))
    out["quantity_percent"] = sql("SELECT symbol, rn, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("equity", "cash", "position", "entry_price")) + " FROM eq", *_fold_sql(5, 20, "0.25"))
    out["std_aggregate"] = sql("SELECT symbol, round(stddev_pop(close), 6) AS std FROM x GROUP BY symbol")
    return out | {"csv_enrich": _CSV, "csv_read": _CSV_READ, "strategy_object": out["backtest_trades"], "adx_flat": _adx_flat_sql()}
