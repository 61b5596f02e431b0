"""Backtests of long symbols in time blocks.

Before a block the account is flat, long or short. Whatever it holds, the first action that closes or opens
something leaves it flat for a moment, with some cash; and with quantities that are shares of the cash
everything after that is that cash times the path of an account with cash 1. So each block is folded from
the three sides with cash 1, and returns where each path begins, ends and what it earned; the true path is
picked in order of the blocks, and a second pass replays each block from the account before it.

Fixed quantities and the strict reading of affordability depend on the amount of cash: there the acting bars
of a symbol (a few per cent of its bars as a rule) go through one ordered fold, which returns the account
before each block; equity and metrics are in blocks as well.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quantloom.operators.backtest import _EQUITY, _KINDS, _METRICS, _TRADES, EXIT, Action, Config, Portfolio, Quantity, Result, _codes, _metric_arrays, _METRIC_NAMES, keep_account
from quantloom.operators.blocks import _BLOCK, _CARRY, _KIND, BLOCK_BARS, _groups, _in_order, _joined, _stream, _with_carry, with_blocks
from quantloom.operators.recurrence import whole_symbols
from quantloom.schema import Bars
from quantloom.sources.scratch import saved, shared_folder

_SIDES = (0, 1, -1)
_STATE = ("cash", "side", "quantity", "entry", "entered")


def state_of(p: Portfolio) -> tuple:
    return tuple(getattr(p, x) for x in _STATE)


def put(p: Portfolio, state: tuple) -> Portfolio:
    for x, v in zip(_STATE, state):
        setattr(p, x, v)
    return p


def first_change(side: int, codes: np.ndarray) -> int:
    """The first bar at which an account of that side does something; the number of bars if none."""
    if side == 0:
        acts = (codes == 1) | (codes == 2)
    else:
        acts = (codes == 3) | (codes == (2 if side > 0 else 1))
    at = np.flatnonzero(acts)
    return int(at[0]) if len(at) else len(codes)


def summarise(closes: np.ndarray, seqs: np.ndarray, codes: np.ndarray, quantity: Quantity, config: Config) -> dict:
    """Of every side: the bar and close of its first change, or None, and the account with cash 1 after the
    block, with the trades it closed from that bar on."""
    out = {}
    for side in _SIDES:
        i = first_change(side, codes)
        if i == len(codes):
            out[side] = None
            continue
        p = Portfolio(replace(config, cash=1.0))
        for k in (np.flatnonzero(codes[i:]) + i).tolist():
            p.apply(Action(_KINDS[codes[k]], quantity), float(closes[k]), int(seqs[k]))
        out[side] = (float(closes[i]), state_of(p), len(p.trades))
    return out


def advance(state: tuple, summary: dict, config: Config) -> tuple[tuple, int]:
    """(the account after a block, trades closed in it) from the account before it."""
    found = summary[state[1]]
    if found is None:
        return state, 0
    price, (cash, side, units, entry, entered), trades = found
    p = put(Portfolio(config), state)
    closed = int(p.side != 0)
    p.close(price, 0)
    if not p.cash > 0:  # nothing can be opened any more
        return (p.cash, 0, 0.0, 0.0, None), closed
    return (p.cash * cash, side, p.cash * units, entry, entered), closed + trades


def run_blocked(bars: DataFrame, *, action: str = "action", quantity: Quantity = Quantity(), config: Config = Config(), c: Bars = Bars(), block_bars: int = BLOCK_BARS) -> Result:
    """As ``backtest.run`` with an action column, with long symbols in time blocks.

    The bars are written once, and then read by each of the three results. Metrics take another look at the
    blocks: drawdowns need the highest equity before a block."""
    folder = shared_folder(bars.sparkSession, "backtest")
    inputs = [c.symbol, c.ts, c.seq, c.close, action, *([_BLOCK] if _BLOCK in bars.columns else [])]
    source = saved(with_blocks(bars.select(*dict.fromkeys(inputs)), folder, block_bars, c).select(*dict.fromkeys([*inputs, _BLOCK])), f"{folder}/bars")
    symbol = StructType([bars.schema[c.symbol]])
    schema = StructType([*symbol.fields, *StructType.fromDDL(f"`{_BLOCK}` int, `{_KIND}` int, `{_CARRY}` binary").fields])
    parallel = quantity.kind != "fixed" and config.affordability == "tolerant"

    def row(b: pa.RecordBatch, shift: int, kind: int, x: object, at: int = 0) -> pa.RecordBatch:
        block = b.column(_BLOCK)[at].as_py() + shift
        return pa.RecordBatch.from_arrays([b.column(c.symbol).take(pa.array([at])), pa.array([block], pa.int32()), pa.array([kind], pa.int32()), pa.array([pickle.dumps(x)], pa.binary())], names=[c.symbol, _BLOCK, _KIND, _CARRY])

    def series(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return b.column(c.close).cast(pa.float64()).to_numpy(zero_copy_only=False), b.column(c.seq).cast(pa.int64()).to_numpy(zero_copy_only=False), _codes(b.column(action))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            closes, seqs, codes = series(b)
            yield row(b, 0, 1, (b.num_rows, float(closes[-1]), summarise(closes, seqs, codes, quantity, config) if parallel else None))

    def acting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The account and the closed trades after the last acting bar of every block."""
        for b, starts in whole_symbols(batches):
            closes, seqs, codes = series(b)
            block = b.column(_BLOCK).to_numpy()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                p = Portfolio(config)
                for k in range(s, e):
                    p.apply(Action(_KINDS[codes[k]], quantity), float(closes[k]), int(seqs[k]))
                    if k + 1 == e or block[k + 1] != block[k]:
                        yield row(b, 0, 2, (state_of(p), len(p.trades)), k)

    def states(blocks: list) -> list:
        """The bars, the last close, the account and the trades before each block."""
        before, after = 0, {}
        for block, x in blocks:
            after.setdefault(block, {})[len(x)] = x
        out, was = [], (None, (config.cash, 0, 0.0, 0.0, None), 0)
        for block in sorted(after):
            n, close, summary = after[block][3]
            out.append((block, 0, {"before": (before, *was)}))
            state, trades = was[1:]
            if parallel:
                state, more = advance(state, summary, config)
                trades += more
            elif 2 in after[block]:
                state, trades = after[block][2]
            before, was = before + n, (close, state, trades)
        return out

    found = _stream(source, c).mapInArrow(look, schema)
    if not parallel:
        w = Window.partitionBy(c.symbol).orderBy(c.ts, c.seq)
        found = found.unionAll(source.where(F.col(action).isin(*_KINDS[1:])).withColumn("_bar", F.row_number().over(w)).mapInArrow(acting, schema))
    carry = saved(_in_order(saved(found, f"{folder}/blocks"), states, c), f"{folder}/states")
    rows = _stream(_with_carry(source, carry, c), c, (_KIND,))

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in _groups(batches):
            carried, own = _joined(b)
            if own.num_rows:
                closes, seqs, codes = series(own)
                before, last, state, trades = carried["before"]
                p = put(Portfolio(config), state)
                first = p.equity(last) if last is not None else None
                a = keep_account(p, closes, seqs, lambda i, codes=codes: Action(_KINDS[codes[i]], quantity), np.flatnonzero(codes))
                yield own, closes, seqs, before, first, trades, a, carried

    def equity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, closes, seqs, before, _, _, a, _ in replayed(batches):
            flat = a.held == 0
            cols = [np.arange(before, before + len(closes)), seqs, a.equity(closes, config), a.cash, a.held]
            opened = [pa.array(x, mask=flat) for x in (a.entry, a.entered, a.held * (closes - a.entry))]
            yield pa.RecordBatch.from_arrays([own.column(c.symbol), *map(pa.array, cols), *opened], names=[c.symbol, "bar", c.seq, "equity", "cash", "position", "entry_price", "entry_seq", "unrealised"])

    def trades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _TRADES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for own, *_, before, a, _ in replayed(batches):
            made = [(before + i, *t) for i, t in enumerate(a.trades)]
            cols = list(zip(*made)) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([own.column(c.symbol).take(pa.array([0] * len(made), pa.int64())), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=[c.symbol, *names])

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, closes, *_, a, _ in replayed(batches):
            yield row(own, 0, 1, float(np.nanmax(a.equity(closes, config), initial=-np.inf)))

    def peaks(blocks: list) -> list:
        out, peak = [], config.cash
        for block, x in blocks:
            out.append((block, 0, {"peak": peak}))
            peak = max(peak, x)
        return out

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, closes, _, _, first, _, a, carried in replayed(batches):
            value = a.equity(closes, config)
            peak = np.maximum.accumulate(np.append(carried["peak"], value))[1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                drop = np.where(peak > 0, (peak - value) / peak, 0.0)
                was = np.append(np.nan if first is None else first, value[:-1])
                returns = ((value - was) / was)[was > 0]
            pnl = np.array([t[6] for t in a.trades])
            moments = (len(returns), float(returns.mean()) if len(returns) else 0.0, float(((returns - returns.mean()) ** 2).sum()) if len(returns) else 0.0)
            yield row(own, 0, 1, (float(value[-1]), float(max(0.0, np.nanmax(drop, initial=0.0))), moments, (len(pnl), int((pnl > 0).sum()), float(pnl[pnl > 0].sum()), float(pnl[pnl <= 0].sum()))))

    def measured(t: pa.Table) -> pa.Table:
        """Metrics of a symbol from those of its blocks."""
        n, mean, spread, drop, counts, last = 0, 0.0, 0.0, 0.0, np.zeros(4), 0.0
        for _, raw in sorted(zip(t.column(_BLOCK).to_pylist(), t.column(_CARRY).to_pylist())):
            last, d, (k, m, s), own = pickle.loads(raw)
            drop, counts = max(drop, d), counts + np.array(own)
            if k:
                apart = m - mean
                spread += s + apart * apart * n * k / (n + k)
                mean, n = mean + apart * k / (n + k), n + k
        deviation = float(np.sqrt(spread / (n - 1))) if n > 1 else 0.0
        many, won, gain, loss = counts.tolist()
        values = (last, (last - config.cash) / config.cash if config.cash > 0 else 0.0, drop, mean / deviation * float(np.sqrt(config.periods_per_year)) if deviation > 0 else 0.0,
                  won / many if many else 0.0, int(many), (float("inf") if loss == 0 else gain / abs(loss)) if many else 0.0)
        return pa.table([t.column(c.symbol).combine_chunks().slice(0, 1), *_metric_arrays([values])], names=[c.symbol, *_METRIC_NAMES])

    def with_types(ddl: str) -> StructType:
        return StructType([*symbol.fields, *StructType.fromDDL(ddl).fields])

    top = _in_order(rows.mapInArrow(highest, schema), peaks, c)
    again = _stream(_with_carry(source, carry.unionAll(top), c), c, (_KIND,)).mapInArrow(partial, schema)
    metrics = again.groupBy(c.symbol).applyInArrow(lambda t: measured(t), with_types(_METRICS))
    return Result(rows.mapInArrow(equity, with_types(_EQUITY.format(seq=c.seq))), rows.mapInArrow(trades, with_types(_TRADES)), metrics)
