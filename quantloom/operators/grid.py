"""Parameter grids as arrays: one fold over the bars of a symbol carries all parameter sets at once.

Cash, position and every running measure are vectors over the grid, so a bar costs a few vector operations
whatever the number of sets. Indicators that sets share are computed once. The grid itself is a small table
that travels with the tasks; the plan is one exchange, one sort and one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import kernels
from quantloom.functions.indicator import Indicator, SeriesIndicator
from quantloom.operators.backtest import _METRICS, _METRIC_NAMES, Config, Quantity
from quantloom.operators.recurrence import whole_symbols
from quantloom.schema import Bars

#: Bars whose actions are found at a time, and bytes of indicator values that a symbol holds at a time.
STEP, HELD_BYTES = 64, 256 << 20
#: Codes of actions: nothing, enter long, enter short, exit.
NOTHING, LONG, SHORT, OUT = 0, 1, 2, 3
Rule = Callable[[tuple[np.ndarray, ...], tuple[np.ndarray, ...]], np.ndarray]


def crossing(was: tuple[np.ndarray, ...], now: tuple[np.ndarray, ...]) -> np.ndarray:
    """Long where the first leg crosses above the second, short where it crosses below."""
    return np.where((was[0] <= was[1]) & (now[0] > now[1]), LONG, np.where((was[0] >= was[1]) & (now[0] < now[1]), SHORT, NOTHING))


class Accounts:
    """Portfolios of all sets, as vectors, with their measures so far."""

    def __init__(self, sets: int, quantity: Quantity, config: Config):
        self.q, self.c = quantity, config
        self.cash = np.full(sets, config.cash)
        self.side, self.units, self.entry = (np.zeros(sets) for _ in range(3))
        self.trades, self.wins, self.gain, self.loss = (np.zeros(sets) for _ in range(4))
        self.peak, self.drop = np.full(sets, config.cash), np.zeros(sets)
        self.n, self.mean, self.spread = (np.zeros(sets) for _ in range(3))
        self.value: np.ndarray | None = None

    def act(self, at: np.ndarray, code: np.ndarray, price: float) -> None:
        """Applies the codes of the sets ``at`` at a bar's close."""
        fee, slip = self.c.fee, self.c.slippage
        wanted = np.where(code == LONG, 1.0, np.where(code == SHORT, -1.0, 0.0))
        side = self.side[at]
        out = (side != 0) & ((code == OUT) | (wanted == -side))
        i, s = at[out], side[out]
        if len(i):
            fill = np.where(s < 0, price * (1 + slip), price * (1 - slip))
            paid = fill * self.units[i] * fee
            self.cash[i] += s * self.units[i] * fill - paid
            pnl = s * self.units[i] * (fill - self.entry[i]) - (self.entry[i] * self.units[i] * fee + paid)
            self.trades[i] += 1
            self.wins[i] += pnl > 0
            self.gain[i] += np.maximum(pnl, 0.0)
            self.loss[i] += np.minimum(pnl, 0.0)
            self.side[i] = 0
        into = (wanted != 0) & (self.side[at] == 0)
        i, s = at[into], wanted[into]
        if not len(i):
            return
        fill = np.where(s > 0, price * (1 + slip), price * (1 - slip))
        cash = self.cash[i]
        if self.q.kind == "fixed":
            units = np.full(len(i), float(self.q.value))
        else:
            units = np.where(cash > 0, cash * (1.0 if self.q.kind == "all_cash" else min(max(self.q.value, 0.0), 1.0)), 0.0)
            units = np.divide(units, fill * (1 + fee), out=np.zeros(len(i)), where=fill > 0)
        paid = fill * units * fee
        room = cash if self.c.affordability == "strict" else cash * (1 + 1e-12)
        fits = (fill > 0) & (units > 0) & ((s < 0) | (units * fill + paid <= room))
        i, s, fill, units, paid = (x[fits] for x in (i, s, fill, units, paid))
        self.cash[i] -= s * units * fill + paid
        self.side[i], self.units[i], self.entry[i] = s, units, fill

    def mark(self, price: float) -> None:
        """Values all accounts at a bar's close."""
        held = np.where(self.side == 0, 0.0, self.side * self.units)
        value = self.cash + held * price
        if self.c.short_mtm == "reference":
            value = np.where(self.side < 0, self.cash + self.units * (2 * self.entry - price), value)
        np.maximum(self.peak, value, out=self.peak)
        np.maximum(self.drop, np.divide(self.peak - value, self.peak, out=np.zeros(len(value)), where=self.peak > 0), out=self.drop)
        if self.value is not None:
            up = self.value > 0
            r = np.divide(value - self.value, self.value, out=np.zeros(len(value)), where=up)
            self.n += up
            apart = np.where(up, r - self.mean, 0.0)
            self.mean += apart / np.maximum(self.n, 1)
            self.spread += apart * np.where(up, r - self.mean, 0.0)
        self.value = value

    def measures(self) -> list[np.ndarray]:
        c = self.c
        deviation = np.sqrt(np.divide(self.spread, self.n - 1, out=np.zeros(len(self.n)), where=self.n > 1))
        sharpe = np.divide(self.mean, deviation, out=np.zeros(len(self.n)), where=deviation > 0) * np.sqrt(c.periods_per_year)
        some = self.trades > 0
        factor = np.where(some, np.where(self.loss == 0, np.inf, np.divide(self.gain, -self.loss, out=np.zeros(len(some)), where=self.loss != 0)), 0.0)
        total = (self.value - c.cash) / c.cash if c.cash > 0 else np.zeros(len(some))
        return [self.value, total, self.drop, sharpe, np.divide(self.wins, self.trades, out=np.zeros(len(some)), where=some), self.trades.astype(np.int64), factor]


def _values(i: Indicator, bars: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(i, SeriesIndicator):
        return i.series(bars)[i.outputs[0]]
    v, ok = kernels.arrays(i, bars)[i.outputs[0]]
    return np.where(ok, v, np.nan)


def sweep_grid(bars: DataFrame, legs: Sequence[Sequence[Indicator]], *, rule: Rule = crossing, quantity: Quantity = Quantity(), config: Config = Config(), c: Bars = Bars()) -> DataFrame:
    """Metrics of every symbol and parameter set, ``param_id`` its place in the grid.

    ``legs`` has the indicators of every set (their first output counts): for a crossover
    ``[(Sma(f), Sma(s)) for f, s in ...]``. ``rule`` gets the legs' values at the bar before and at the bar,
    each an array over sets and bars (NaN while not known, which fails every comparison), and returns codes.
    Equal to a backtest per set. A symbol's bars are in one task; memory holds them, ``HELD_BYTES`` of
    indicator values and some vectors of the grid's length."""
    if not len(legs):
        raise ValueError("the grid is empty")
    known = list(dict.fromkeys(i for s in legs for i in s))
    if bad := [i.name for i in known if not isinstance(i, SeriesIndicator) and not kernels.has_kernel(i)]:
        raise ValueError(f"no array form: {', '.join(sorted(set(bad)))}")
    place = {i: k for k, i in enumerate(known)}
    index = np.array([[place[i] for i in s] for s in legs])
    needs = sorted({"close"} | {x for i in known for x in (i.needs if isinstance(i, SeriesIndicator) else kernels.reads(i))})
    source = {x: getattr(c, x, x) for x in needs}
    frame = bars.select(*dict.fromkeys([c.symbol, *c.session_key, c.ts, c.seq, *source.values()])).withColumn("_bar", F.row_number().over(c.window()))

    def groups(most: int) -> Iterator[np.ndarray]:
        """The sets in their order of indicators, as many at a time as ``most`` indicators allow."""
        order, own, held = np.lexsort(index.T[::-1]), [], set()
        for p in order.tolist():
            more = held | set(index[p].tolist())
            if own and len(more) > most:
                yield np.array(own)
                own, more = [], set(index[p].tolist())
            own.append(p)
            held = more
        yield np.array(own)

    def fold(b: pa.RecordBatch) -> list[np.ndarray]:
        x = {k: b.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False) for k, s in source.items()}
        closes = x["close"].tolist()
        n = len(closes)
        out = [np.empty(len(legs), np.int64 if m == "trade_count" else np.float64) for m in _METRIC_NAMES]
        for own in groups(max(2 * index.shape[1], HELD_BYTES // (8 * n))):
            used, at = np.unique(index[own], return_inverse=True)
            at = at.reshape(len(own), -1)
            table = np.stack([np.append(np.nan, _values(known[k], x)) for k in used])
            accounts = Accounts(len(own), quantity, config)
            for s in range(0, n, STEP):
                e = min(s + STEP, n)
                part = table[:, s : e + 1]
                legs_now = [part[at[:, k]] for k in range(at.shape[1])]
                codes = rule(tuple(v[:, :-1] for v in legs_now), tuple(v[:, 1:] for v in legs_now)).T
                for t in range(s, e):
                    acting = np.flatnonzero(codes[t - s])
                    if len(acting):
                        accounts.act(acting, codes[t - s][acting], closes[t])
                    accounts.mark(closes[t])
            for o, v in zip(out, accounts.measures()):
                o[own] = v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_symbols(batches):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                keys = [b.column(k).slice(s, 1).take(pa.array(np.zeros(len(legs), np.int64))) for k in (c.symbol, *c.session_key)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(legs), dtype=np.int32)), *map(pa.array, fold(b.slice(s, e - s)))], names=[c.symbol, *c.session_key, "param_id", *_METRIC_NAMES])

    types = ", ".join(f"`{k}` {bars.schema[k].dataType.simpleString()}" for k in (c.symbol, *c.session_key))
    return frame.mapInArrow(run, f"{types}, param_id int, {_METRICS}")
