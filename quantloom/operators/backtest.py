"""Single-position backtests, one per symbol (and parameter set), with their metrics.

Orders fill at the bar's close with slippage and a proportional fee. An opposite entry closes first;
an entry in the same direction does nothing; a position open at the end stays in the equity.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.indicator import Indicator
from quantloom.operators.recurrence import whole_symbols
from quantloom.schema import Bars

ENTER_LONG, ENTER_SHORT, EXIT, HOLD = "ENTER_LONG", "ENTER_SHORT", "EXIT", "HOLD"


@dataclass(frozen=True)
class Quantity:
    """kind: 'fixed' units, 'all_cash', or 'percent_cash' (value within 0 and 1)."""

    kind: str = "all_cash"
    value: float = 1.0

    def __post_init__(self):
        if self.kind not in ("fixed", "all_cash", "percent_cash"):
            raise ValueError("kind is fixed, all_cash or percent_cash")


@dataclass(frozen=True)
class Action:
    kind: str = HOLD
    quantity: Quantity = Quantity()


@dataclass(frozen=True)
class Config:
    """``short_mtm='reference'`` values an open short as cash + q (2 entry - price), which counts
    the sale twice; ``affordability='strict'`` refuses a cost above cash by any rounding error."""

    cash: float = 10_000.0
    fee: float = 0.0
    slippage: float = 0.0
    periods_per_year: float = 252.0
    short_mtm: str = "correct"
    affordability: str = "tolerant"

    def __post_init__(self):
        if self.short_mtm not in ("correct", "reference") or self.affordability not in ("tolerant", "strict"):
            raise ValueError("short_mtm is correct or reference, affordability tolerant or strict")


@dataclass
class Portfolio:
    config: Config
    cash: float = field(init=False)
    side: int = 0  # 1 long, -1 short
    quantity: float = 0.0
    entry: float = 0.0
    entered: object = None
    trades: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.cash = self.config.cash

    def equity(self, price: float) -> float:
        if self.side == 0:
            return self.cash
        if self.side > 0:
            return self.cash + self.quantity * price
        if self.config.short_mtm == "reference":
            return self.cash + self.quantity * (2 * self.entry - price)
        return self.cash - self.quantity * price

    def _fill(self, price: float, buy: bool) -> float:
        return price * (1 + self.config.slippage) if buy else price * (1 - self.config.slippage)

    def close(self, price: float, at) -> None:
        if self.side == 0:
            return
        fill = self._fill(price, self.side < 0)
        fee = fill * self.quantity * self.config.fee
        self.cash += self.side * self.quantity * fill - fee
        fees = self.entry * self.quantity * self.config.fee + fee
        gross = self.side * self.quantity * (fill - self.entry)
        self.trades.append((("SHORT", "LONG")[self.side > 0], self.quantity, self.entry, fill, self.entered, at, gross - fees, fees))
        self.side = 0

    def open(self, side: int, q: Quantity, price: float, at) -> None:
        fill = self._fill(price, side > 0)
        if not fill > 0:
            return
        unit = fill * (1 + self.config.fee)
        if q.kind == "fixed":
            units = q.value
        elif self.cash <= 0:
            return
        else:
            units = self.cash / unit if q.kind == "all_cash" else self.cash * min(max(q.value, 0.0), 1.0) / unit
        if not units > 0:
            return
        fee = fill * units * self.config.fee
        if side > 0:
            cost = units * fill + fee
            room = self.cash if self.config.affordability == "strict" else self.cash * (1 + 1e-12)
            if cost > room:
                return
            self.cash -= cost
        else:
            self.cash += units * fill - fee
        self.side, self.quantity, self.entry, self.entered = side, units, fill, at

    def apply(self, a: Action, price: float, at) -> None:
        if a.kind == EXIT:
            self.close(price, at)
        elif a.kind in (ENTER_LONG, ENTER_SHORT):
            side = 1 if a.kind == ENTER_LONG else -1
            if self.side == -side:
                self.close(price, at)
            if self.side == 0:
                self.open(side, a.quantity, price, at)


@dataclass
class Context:
    portfolio: Portfolio
    index: int
    price: float


class Strategy:
    """Subclass for path-dependent rules; instances are copied to every symbol's task."""

    def on_start(self, context: Context) -> None: ...

    def on_candle(self, bar: dict, context: Context) -> Action:
        raise NotImplementedError

    def on_finish(self, context: Context) -> None: ...


@dataclass(frozen=True)
class Result:
    """``equity``: one row per bar, with the open position. ``trades``: closed trades. ``metrics``: one
    row per key. Each is a fold of its own over the bars, so an action on one of them runs one fold."""

    equity: DataFrame
    trades: DataFrame
    metrics: DataFrame


_EQUITY = "bar long, `{seq}` long, equity double, cash double, position double, entry_price double, entry_seq long, unrealised double"
_TRADES = "trade long, side string, quantity double, entry_price double, exit_price double, entry_seq long, exit_seq long, pnl double, fees double"
_METRICS = "final_equity double, total_return double, max_drawdown double, sharpe double, win_rate double, trade_count long, profit_factor double"
_KINDS = (HOLD, ENTER_LONG, ENTER_SHORT, EXIT)


@dataclass
class Account:
    """What a portfolio is at every bar of a symbol, and its closed trades."""

    cash: np.ndarray
    held: np.ndarray  # signed units
    entry: np.ndarray  # NaN while flat
    entered: np.ndarray
    trades: list[tuple]

    def equity(self, closes: np.ndarray, config: Config) -> np.ndarray:
        value = self.held * closes
        if config.short_mtm == "reference":
            value = np.where(self.held < 0, -self.held * (2 * self.entry - closes), value)
        return np.where(self.held == 0, self.cash, self.cash + value)


def keep_account(p: Portfolio, closes: np.ndarray, seqs: np.ndarray, act: Callable[[int], Action], at: np.ndarray) -> Account:
    """Applies ``act(i)`` at the bars ``at``; the portfolio is the same at all bars between."""
    n = len(closes)
    out = Account(np.empty(n), np.empty(n), np.empty(n), np.zeros(n, np.int64), p.trades)

    def until(begin: int, end: int) -> None:
        out.cash[begin:end], out.held[begin:end] = p.cash, p.side * p.quantity
        out.entry[begin:end], out.entered[begin:end] = (p.entry, p.entered) if p.side else (np.nan, 0)

    begin = 0
    for i in at.tolist():
        until(begin, i)
        p.apply(act(i), float(closes[i]), int(seqs[i]))
        begin = i
    until(begin, n)
    return out


def measures(equity: np.ndarray, trades: list[tuple], config: Config) -> tuple:
    """Final equity, returns, drawdown, Sharpe ratio and trade statistics of one backtest."""
    peak = np.maximum.accumulate(np.append(config.cash, equity))[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        drop = np.where(peak > 0, (peak - equity) / peak, 0.0)
        returns = ((equity[1:] - equity[:-1]) / equity[:-1])[equity[:-1] > 0]
    spread = returns.std(ddof=1) if len(returns) > 1 else 0.0
    pnl = np.array([t[6] for t in trades])
    gain, loss = pnl[pnl > 0].sum(), pnl[pnl <= 0].sum()
    return (
        float(equity[-1]), float((equity[-1] - config.cash) / config.cash) if config.cash > 0 else 0.0, float(max(0.0, np.nanmax(drop, initial=0.0))),
        float(returns.mean() / spread * math.sqrt(config.periods_per_year)) if spread > 0 else 0.0,
        float((pnl > 0).mean()) if len(pnl) else 0.0, len(pnl), (math.inf if loss == 0 else float(gain / abs(loss))) if len(pnl) else 0.0,
    )


def _codes(column: pa.Array) -> np.ndarray:
    """Actions as numbers, 0 for anything that holds."""
    out = np.zeros(len(column), np.int8)
    for i, kind in enumerate(_KINDS[1:], 1):
        out[pc.fill_null(pc.equal(column, kind), False).to_numpy(zero_copy_only=False)] = i
    return out


def run(bars: DataFrame, strategy: Strategy | None = None, *, action: str = "action", quantity: Quantity = Quantity(), config: Config = Config(), keys: tuple[str, ...] = (), c: Bars = Bars()) -> Result:
    """Backtests ``strategy``, or the declarative column ``action`` (ENTER_LONG, ENTER_SHORT, EXIT,
    anything else holds). ``keys`` are further key columns besides the symbol, e.g. a parameter id.

    The fold runs over Arrow batches that hold many symbols, on the partitioning and order that the
    window columns before it have. With an action column it steps only through bars that act."""
    key = [c.symbol, *keys]
    inputs = [*key, c.ts, c.seq, c.close] if strategy is None else [*key, *c.names[1:]]
    if strategy is None:
        inputs.append(action)
    source = bars.select(*dict.fromkeys(inputs)).withColumn("_bar", F.row_number().over(Window.partitionBy(*key).orderBy(c.ts, c.seq)))
    types = ", ".join(f"`{k}` {bars.schema[k].dataType.simpleString()}" for k in key)

    def accounts(b: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Account]]:
        closes, seqs = (b.column(x).cast(t).to_numpy(zero_copy_only=False) for x, t in ((c.close, pa.float64()), (c.seq, pa.int64())))
        codes = _codes(b.column(action)) if strategy is None else None
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            p = Portfolio(config)
            if strategy is None:
                own = codes[s:e]
                a = keep_account(p, closes[s:e], seqs[s:e], lambda i, own=own: Action(_KINDS[own[i]], quantity), np.flatnonzero(own))
            else:
                live, rows = copy.deepcopy(strategy), b.slice(s, e - s).drop_columns(["_bar"]).to_pylist()
                live.on_start(Context(p, 0, rows[0][c.close]))
                a = keep_account(p, closes[s:e], seqs[s:e], lambda i, live=live, rows=rows, p=p: live.on_candle(rows[i], Context(p, i, rows[i][c.close])), np.arange(e - s))
                live.on_finish(Context(p, e - s - 1, rows[-1][c.close]))
            yield s, e, closes[s:e], seqs[s:e], a

    def of_key(b: pa.RecordBatch, at: list[int]) -> list[pa.Array]:
        return [b.column(k).take(pa.array(at, pa.int64())) for k in key]

    def equity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_symbols(batches):
            got = list(accounts(b, starts))
            cash, held, entry, entered = (np.concatenate([getattr(a, x) for *_, a in got]) for x in ("cash", "held", "entry", "entered"))
            value, closes = np.concatenate([a.equity(x, config) for _, _, x, _, a in got]), np.concatenate([x for _, _, x, *_ in got])
            flat = held == 0
            cols = [b.column("_bar").to_numpy().astype(np.int64) - 1, np.concatenate([x for *_, x, _ in got]), value, cash, held]
            opened = [pa.array(x, mask=flat) for x in (entry, entered, held * (closes - entry))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), *map(pa.array, cols), *opened], names=[*key, "bar", c.seq, "equity", "cash", "position", "entry_price", "entry_seq", "unrealised"])

    def trades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for b, starts in whole_symbols(batches):
            rows = [(s, i, *t) for s, *_, a in accounts(b, starts) for i, t in enumerate(a.trades)]
            at, *cols = zip(*rows) if rows else [()] * 10
            yield pa.RecordBatch.from_arrays([*of_key(b, list(at)), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=[*key, *[f.split()[0] for f in _TRADES.split(", ")]])

    def metrics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_symbols(batches):
            rows = [measures(a.equity(x, config), a.trades, config) for _, _, x, _, a in accounts(b, starts)]
            yield pa.RecordBatch.from_arrays([*of_key(b, starts.tolist()), *_metric_arrays(rows)], names=[*key, *_METRIC_NAMES])

    return Result(source.mapInArrow(equity, f"{types}, {_EQUITY.format(seq=c.seq)}"), source.mapInArrow(trades, f"{types}, {_TRADES}"), source.mapInArrow(metrics, f"{types}, {_METRICS}"))


_METRIC_NAMES = [f.split()[0] for f in _METRICS.split(", ")]


def _metric_arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, pa.int64() if n == "trade_count" else pa.float64()) for x, n in zip(zip(*rows), _METRIC_NAMES)]


#: Parameter sets that share one pass over the bars.
AT_ONCE = 32


def sweep(bars: DataFrame, grid: list[dict], add_action, *, prepare=None, quantity: Quantity = Quantity(), config: Config = Config(), at_once: int = AT_ONCE, c: Bars = Bars()) -> DataFrame:
    """Metrics of every symbol and parameter set (``param_id``, its place in the grid).

    ``add_action(bars, params)`` adds the column ``action``; ``prepare(bars)`` may add columns that all
    parameter sets share, such as the averages of every period. The actions of ``at_once`` sets are
    columns side by side: one scan, exchange, sort and fold for all of them."""
    if not grid:
        raise ValueError("the grid is empty")
    df = prepare(bars) if prepare else bars
    shared, base = df, df.columns

    def part(begin: int) -> DataFrame:
        df, made = shared, []
        for i in range(begin, min(begin + at_once, len(grid))):
            df = add_action(df, grid[i]).withColumnRenamed("action", f"_action_{i}")
            made.append(f"_action_{i}")
            df = df.select(*base, *made)
        source = df.select(c.symbol, c.ts, c.seq, c.close, *made).withColumn("_bar", F.row_number().over(c.window()))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, starts in whole_symbols(batches):
                closes, seqs = (b.column(x).cast(t).to_numpy(zero_copy_only=False) for x, t in ((c.close, pa.float64()), (c.seq, pa.int64())))
                ends, rows, at, ids = [*starts[1:].tolist(), b.num_rows], [], [], []
                for i, name in enumerate(made, begin):
                    codes = _codes(b.column(name))
                    for s, e in zip(starts.tolist(), ends):
                        own = codes[s:e]
                        a = keep_account(Portfolio(config), closes[s:e], seqs[s:e], lambda j, own=own: Action(_KINDS[own[j]], quantity), np.flatnonzero(own))
                        rows.append(measures(a.equity(closes[s:e], config), a.trades, config))
                        at.append(s)
                        ids.append(i)
                yield pa.RecordBatch.from_arrays([b.column(c.symbol).take(pa.array(at, pa.int64())), pa.array(ids, pa.int32()), *_metric_arrays(rows)], names=[c.symbol, "param_id", *_METRIC_NAMES])

        return source.mapInArrow(fold, f"`{c.symbol}` {bars.schema[c.symbol].dataType.simpleString()}, param_id int, {_METRICS}")

    return reduce(DataFrame.unionAll, [part(i) for i in range(0, len(grid), at_once)])


def action_of(event: Column) -> Column:
    """LONG, SHORT and EXIT events as actions."""
    return F.when(event == "LONG", F.lit(ENTER_LONG)).when(event == "SHORT", F.lit(ENTER_SHORT)).when(event == "EXIT", F.lit(EXIT)).otherwise(F.lit(HOLD))


@dataclass(frozen=True)
class LiveBacktest(Indicator):
    """A backtest for streams: acts on the events of ``signal`` at each bar's close. Outputs follow the
    portfolio; ``realised`` is the profit of all closed trades so far."""

    signal: Indicator
    quantity: Quantity = Quantity()
    config: Config = Config()
    outputs = ("equity", "cash", "position", "trade_count", "realised")
