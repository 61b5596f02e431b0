"""Long series in time blocks, so that one symbol uses many tasks.

A symbol with many bars is cut into blocks of consecutive times. Each block gets what it needs of the
blocks before it:

* finite lookback: the last bars of the block before (a halo), and the number of bars before it, since sums
  are added from the same bars on wherever a block begins;
* exponential and Wilder smoothing, running sums: the smoothed values at its first bar. A block's effect on
  them is an affine map, which it returns from a start at zero; the maps of a symbol are composed in order,
  and a second pass starts from the values so found;
* the directional index, whose last smoothing skips flat bars and may be seeded in any block: one more round
  of the same kind, with the number of bars fed so far;
* stop and reverse: paths from different states meet after a few reversals, so each block is folded from the
  state that the halo alone leads to; a block whose true entry state turns out to differ is folded again,
  until none differs.

Results are those of the undivided form. Bars move twice, block summaries are a few numbers per block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quantloom.functions import kernels
from quantloom.functions import momentum as M
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.functions.indicator import Indicator
from quantloom.functions.signals import EXIT, HOLD, LONG, SHORT, LiveSignal
from quantloom.operators.recurrence import ema, linear, whole_symbols, wilder_mean
from quantloom.schema import Bars
from quantloom.sources.scratch import saved, shared_folder

#: Bars of a block, time buckets per block from which blocks are made, and tables that may be broadcast.
BLOCK_BARS, BUCKETS, BROADCAST_ROWS = 100_000, 32, 1_000_000
#: Bars before a block from which the state of stop and reverse is guessed.
RUN_IN = 2_000
_BLOCK, _KIND, _CARRY = "__block", "__kind", "__carry"


def _clock(df: DataFrame, c: Bars) -> Column:
    kind = df.schema[c.ts].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c.ts).cast("timestamp")).cast("double")
    return (F.unix_date(F.col(c.ts)) if kind == "date" else F.col(c.ts)).cast("double")


def with_blocks(bars: DataFrame, folder: str, block_bars: int = BLOCK_BARS, c: Bars = Bars()) -> DataFrame:
    """Adds the block of every bar, see ``cut``."""
    return cut(bars, folder, block_bars, c)[0]


def cut(bars: DataFrame, folder: str, block_bars: int = BLOCK_BARS, c: Bars = Bars()) -> tuple[DataFrame, bool]:
    """(the bars with their block, 0 for symbols of up to one and a half blocks; whether any symbol is longer).

    Counts per time bucket (``BUCKETS`` a block) are summed up to blocks of at least ``block_bars``; times that
    crowd into one bucket stay one block. Bars of one time stay together."""
    if c.session:
        raise ValueError("sessions are keys of their own; blocks are for symbols without them")
    if _BLOCK in bars.columns:
        return bars, True
    key, at = c.symbol, _clock(bars, c)
    least = 3 * block_bars // 2
    long = bars.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__low"), F.max(at).alias("__high")).where(F.col("__n") > least)
    long = saved(long, f"{folder}/long")
    many = long.count()
    if not many:
        return bars.withColumn(_BLOCK, F.lit(0)), False
    hint = F.broadcast if many <= BROADCAST_ROWS else lambda x: x
    long = long.withColumn("__m", (F.ceil(F.col("__n") / block_bars) * BUCKETS).cast("int"))
    low, high, m = (F.col(x) for x in ("__low", "__high", "__m"))
    bucket = F.when(high > low, F.least(F.floor((F.coalesce(at, low) - low) / (high - low) * m).cast("int"), m - 1)).otherwise(F.lit(0))
    counts = bars.join(hint(long), key).groupBy(key, "__m", bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(int(pdf["__m"].iloc[0]), np.int64)
        held[pdf["__b"]] = pdf["__n"]
        blocks, block, size = np.zeros(len(held), np.int32), 0, 0
        for i, n in enumerate(held.tolist()):
            blocks[i], size = block, size + n
            if size >= block_bars:
                block, size = block + 1, 0
        if size < block_bars // 2:  # a short end joins the block before
            blocks[blocks == block] = max(block - 1, 0)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "__blocks": [blocks]})

    cuts = counts.groupBy(key).applyInPandas(grouped, StructType([bars.schema[key], *StructType.fromDDL("`__blocks` array<int>").fields]))
    table = saved(long.join(cuts, key).select(key, "__low", "__high", "__m", "__blocks"), f"{folder}/cuts")
    joined = bars.join(hint(table), key, "left").withColumn(_BLOCK, F.coalesce(F.element_at("__blocks", bucket + 1), F.lit(0)))
    return joined.select(*bars.columns, _BLOCK), True


# --- recurrences ----------------------------------------------------------------------------


def _smooth(x: np.ndarray, alpha: float, s: float) -> np.ndarray:
    return linear(np.append(s, x), alpha)[1:]


@dataclass(frozen=True)
class Chain:
    """A recurrence with a linear state. ``inputs`` (bars, the bar before them or None) are its driving
    series, ``first`` its smoothed series on a symbol's first block, ``run`` those from a given state;
    states are their last values. ``shown`` makes the outputs of them."""

    needs: tuple[str, ...]
    size: int
    inputs: Callable
    first: Callable
    run: Callable
    shown: Callable

    def step(self) -> np.ndarray:
        """The matrix of one bar without input."""
        zero = [np.zeros(1)] * len(self.inputs({x: np.zeros(1) for x in self.needs}, {x: 0.0 for x in self.needs}))
        return np.array([[t[-1] for t in self.run(zero, e)] for e in np.eye(self.size)]).T


def _before(x: np.ndarray, first: float | None) -> np.ndarray:
    return np.append(x[0] if first is None else first, x[:-1])


def _ranges(b, was) -> np.ndarray:
    if was is None:
        return V.true_range(b["high"], b["low"], b["close"])
    c = _before(b["close"], was["close"])
    return np.maximum(b["high"] - b["low"], np.maximum(np.abs(b["high"] - c), np.abs(b["low"] - c)))


def _late(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder means of all but the first value."""
    return np.append(np.nan, wilder_mean(x[1:], n))


def _chain(i: Indicator) -> Chain | None:
    """The recurrence of an indicator, if its state is linear."""
    a = lambda n: 2 / (n + 1)
    if isinstance(i, T.Ema):
        begin = (lambda x: ema(x, i.n)) if i.initial is None else (lambda x: _smooth(x, a(i.n), i.initial))
        return Chain((i.price,), 1, lambda b, w: [b[i.price]], lambda u: [begin(u[0])], lambda u, s: [_smooth(u[0], a(i.n), s[0])], lambda b, t: {"": t[0]})
    if isinstance(i, (T.Dema, T.Tema)):
        depth = 2 if isinstance(i, T.Dema) else 3

        def several(u, s=None):
            out, x = [], u[0]
            for k in range(depth):
                x = ema(x, i.n) if s is None else _smooth(x, a(i.n), s[k])
                out.append(x)
            return out

        return Chain((i.price,), depth, lambda b, w: [b[i.price]], several, several, lambda b, t: {"": 2 * t[0] - t[1] if depth == 2 else 3 * t[0] - 3 * t[1] + t[2]})
    if isinstance(i, T.Macd):

        def lines(u, s=None):
            f, g = (ema(u[0], n) if s is None else _smooth(u[0], a(n), s[k]) for k, n in enumerate((i.fast, i.slow)))
            return [f, g, ema(f - g, i.signal) if s is None else _smooth(f - g, a(i.signal), s[2])]

        return Chain((i.price,), 3, lambda b, w: [b[i.price]], lines, lines, lambda b, t: {"macd": t[0] - t[1], "signal": t[2], "histogram": t[0] - t[1] - t[2]})
    if isinstance(i, M.Rsi):

        def moves(b, w):
            d = b[i.price] - _before(b[i.price], None if w is None else w[i.price])
            return [np.where(d > 0, d, 0.0), np.where(d < 0, -d, 0.0)]

        def strength(b, t):
            g, l = t
            return {"": np.where(np.isnan(g), np.nan, np.where(l == 0, np.where(g == 0, 50.0, 100.0), 100 - 100 / (1 + g / np.where(l == 0, 1.0, l))))}

        return Chain((i.price,), 2, moves, lambda u: [_late(x, i.n) for x in u], lambda u, s: [_smooth(x, 1 / i.n, y) for x, y in zip(u, s)], strength)
    hlc = ("high", "low", "close")
    if isinstance(i, V.Atr):
        return Chain(hlc, 1, lambda b, w: [_ranges(b, w)], lambda u: [wilder_mean(u[0], i.n)], lambda u, s: [_smooth(u[0], 1 / i.n, s[0])], lambda b, t: {"": t[0]})
    if isinstance(i, V.Keltner) and i.atr_mode == "recursive":

        def bands(b, t):
            up, low = t[0] + i.mult * t[1], t[0] - i.mult * t[1]
            with np.errstate(divide="ignore", invalid="ignore"):
                return {"middle": t[0], "upper": up, "lower": low, "bandwidth": (up - low) / t[0]}

        return Chain(hlc, 2, lambda b, w: [b["close"], _ranges(b, w)], lambda u: [ema(u[0], i.ema_n), wilder_mean(u[1], i.atr_n)],
                     lambda u, s: [_smooth(u[0], a(i.ema_n), s[0]), _smooth(u[1], 1 / i.atr_n, s[1])], bands)
    if isinstance(i, V.KeltnerPrice):
        return Chain((i.price,), 1, lambda b, w: [b[i.price]], lambda u: [ema(u[0], i.ema_n)], lambda u, s: [_smooth(u[0], a(i.ema_n), s[0])], lambda b, t: {"": t[0]})
    if isinstance(i, T.HeikinAshi):
        needs = ("open", "high", "low", "close")
        middle = lambda b: (b["open"] + b["high"] + b["low"] + b["close"]) / 4

        def candles(b, t):
            return {"open": t[0], "high": np.maximum(b["high"], np.maximum(t[0], middle(b))), "low": np.minimum(b["low"], np.minimum(t[0], middle(b))), "close": middle(b)}

        def opens(b, w):  # on the first block the first open is the first bar's own middle
            return [np.append((b["open"][0] + b["close"][0]) / 2 if w is None else middle(w), middle(b)[:-1])]

        return Chain(needs, 1, opens, lambda u: [linear(u[0], 0.5)], lambda u, s: [_smooth(u[0], 0.5, s[0])], candles)
    sums = lambda u, s: [y + np.cumsum(x) for x, y in zip(u, s)]
    if isinstance(i, U.Obv):
        flow = lambda b, w: [np.nan_to_num(np.sign(b["close"] - _before(b["close"], None if w is None else w["close"]))) * b["volume"]]
        return Chain(("close", "volume"), 1, flow, lambda u: sums(u, [0.0]), sums, lambda b, t: {"": t[0]})
    if isinstance(i, U.Adl) and i.on_invalid != "null":
        return Chain((*hlc, "volume"), 1, lambda b, w: [kernels.money_flow(b, i.on_invalid)[0]], lambda u: sums(u, [0.0]), sums, lambda b, t: {"": t[0]})
    if type(i) is U.Vwap:

        def price(b, t):
            with np.errstate(divide="ignore", invalid="ignore"):
                return {"": np.where(t[1] == 0, kernels.typical(b), t[0] / t[1])}

        return Chain((*hlc, "volume"), 2, lambda b, w: [kernels.typical(b) * b["volume"], b["volume"]], lambda u: sums(u, [0.0, 0.0]), sums, price)
    if isinstance(i, T.Adx):  # its three sums; the index over them is a round of its own

        def movements(b, w):
            if w is None:
                return [np.append(0.0, x) for x in i.movement(b["high"], b["low"], b["close"])]
            return list(i.movement(*(np.append(w[x], b[x]) for x in hlc)))

        return Chain(hlc, 3, movements, lambda u: [_late(x, i.n) for x in u], lambda u, s: [_smooth(x, 1 / i.n, y) for x, y in zip(u, s)], lambda b, t: {})
    return None


def _fed(i: T.Adx, traces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bars with sums, flat, both lines, the index) on those bars."""
    at = np.flatnonzero(~np.isnan(traces[0]))
    return (at, *i.index(*(t[at] for t in traces)))


def _zero_wilder(x: np.ndarray, n: int) -> float:
    return float(_smooth(x, 1 / n, 0.0)[-1]) if len(x) else 0.0


def index_summary(i: T.Adx, traces: list[np.ndarray]) -> tuple:
    """(bars fed, the first n of them, the smoothing of all from zero)."""
    at, flat, p, m, dx = _fed(i, traces)
    x = dx[~flat]
    return len(x), x[: i.n].copy(), _zero_wilder(x, i.n)


def index_step(i: T.Adx, state: tuple[int, float], summary: tuple) -> tuple[int, float]:
    """State after a block: bars fed, up to n, and their sum, then their smoothed mean."""
    (k, y), (many, head, zero) = state, summary
    r = 1 - 1 / i.n
    if k >= i.n:
        return k, r**many * y + zero
    need = i.n - k
    if many < need:
        return k + many, y + float(head[:many].sum())
    rest = many - need
    return i.n, r**rest * (y + float(head[:need].sum())) / i.n + zero - r**rest * _zero_wilder(head[:need], i.n)


def index_lines(i: T.Adx, size: int, traces: list[np.ndarray], state: tuple[int, float]) -> dict[str, np.ndarray]:
    k, y = state
    at, flat, p, m, dx = _fed(i, traces)
    fed = np.flatnonzero(~flat)
    x, smooth = dx[fed], np.full(len(fed), np.nan)
    if k >= i.n:
        smooth = _smooth(x, 1 / i.n, y)
    elif len(x) >= i.n - k:
        need = i.n - k
        smooth[need - 1 :] = linear(x[need - 1 :], 1 / i.n, 0, (y + float(x[:need].sum())) / i.n)
    index = np.full(len(at), np.nan)
    index[fed] = smooth
    out = {}
    for name, v in (("plus_di", p), ("minus_di", m), ("adx", index)):
        out[name] = np.full(size, np.nan)
        out[name][at] = np.where(flat, 0.0, np.where(flat | ~np.isnan(index), v, np.nan))
    return out


def sar_fold(i: T.ParabolicSar, b: dict[str, np.ndarray], state: dict | None) -> tuple[np.ndarray, dict]:
    """(stops shown, state after the last bar), from a frozen state or the beginning."""
    live = i.start()
    if state is not None:
        live.__dict__.update(state)
    out = np.full(len(b["close"]), np.nan)
    for k, (h, l, c) in enumerate(zip(b["high"].tolist(), b["low"].tolist(), b["close"].tolist())):
        got = live.next({"high": h, "low": l, "close": c})
        if got is not None:
            out[k] = got[""]
    live.bars = min(live.bars, 3)  # beyond two bars their number does not matter, and states can be compared
    return out, {k: v for k, v in live.__dict__.items() if k != "spec"}


_EVENTS = np.array([None, HOLD, LONG, SHORT, EXIT], object)


def signal_events(s: LiveSignal, values: Callable) -> np.ndarray:
    """Events as numbers (0 while there is not enough data, then HOLD, LONG, SHORT, EXIT) of a signal
    whose ``values(source)`` are (at the bar before, at the bar), NaN where null."""
    if s.legs:
        legs = [signal_events(x, values) for x in s.legs]
        if s.kind == "inverse":
            return np.array([0, 1, 3, 2, 4])[legs[0]]
        a, b = legs
        if s.kind == "either":
            out = np.zeros(len(a), np.int64)
            for event in (1, 4, 3, 2):
                out[(a == event) | (b == event)] = event
            return out
        out = np.where((a > 0) & (b > 0), 1, 0)
        out[(a == 4) | (b == 4)] = 4
        for event in (3, 2):
            out[(a == event) & (b == event)] = event
        return out
    was, now = zip(*map(values, s.sources))
    ready = ~np.isnan(np.array([*was, *now])).any(0)
    if s.kind == "breakout":
        inside = (was[0] >= was[2]) & (was[0] <= was[1])
        return np.where(ready, np.where(inside & (now[0] > now[1]), 2, np.where(inside & (now[0] < now[2]), 3, 1)), 0)
    if s.kind.startswith("threshold"):
        was, now = (was[0], np.full(len(was[0]), s.level)), (now[0], np.full(len(now[0]), s.level))
    if s.kind in ("cross_up", "threshold_above"):
        return np.where(ready, np.where((was[0] <= was[1]) & (now[0] > now[1]), 2, 1), 0)
    return np.where(ready, np.where((was[0] >= was[1]) & (now[0] < now[1]), 3, 1), 0)


def _parts(i: Indicator) -> list[tuple[Indicator, int]]:
    """The indicators that a signal looks at and how many bars of each before the block."""
    if not isinstance(i, LiveSignal):
        return [(i, 0)]
    own = [(x[0], 1 + (x[2] if len(x) > 2 else 0)) for x in i.sources if not isinstance(x, str)]
    return own + [p for leg in i.legs for p in _parts(leg)]


def _fields_of(i: Indicator) -> set[str]:
    if not isinstance(i, LiveSignal):
        return set()
    return {x for x in i.sources if isinstance(x, str)} | {f for leg in i.legs for f in _fields_of(leg)}


# --- passes ---------------------------------------------------------------------------------


def _stream(df: DataFrame, c: Bars, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a block in order, numbered from 1 in the last column. Blocks are dealt to a number of tasks
    that Spark does not lower: a few long symbols are few bytes, but much work."""
    spark, by = df.sparkSession, [c.symbol, _BLOCK]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    w = Window.partitionBy(*by).orderBy(*[F.col(x) for x in (*extra, c.ts, c.seq)])
    return df.repartition(tasks, *by).withColumn("_bar", F.row_number().over(w))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, starts in whole_symbols(batches):
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            yield b.slice(s, e - s)


def _numbers(b: pa.RecordBatch, source: dict[str, str]) -> dict[str, np.ndarray]:
    return {x: b.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False) for x, s in source.items()}


def _joined(b: pa.RecordBatch) -> tuple[dict, pa.RecordBatch]:
    """(what was carried to a block, its bars)."""
    kind = b.column(_KIND).to_numpy()
    n = int((kind == 0).sum())
    carry: dict = {}
    for raw in b.column(_CARRY).slice(0, n).to_pylist():
        carry |= pickle.loads(raw)
    return carry, b.slice(n)


def _with_carry(bars: DataFrame, carry: DataFrame, c: Bars) -> DataFrame:
    rows = bars.withColumns({_KIND: F.lit(1), _CARRY: F.lit(None).cast("binary")})
    given = {c.symbol, _BLOCK, _CARRY}
    front = carry.select(*[F.lit(0).alias(x) if x == _KIND else F.col(x) if x in given else F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in rows.columns])
    return rows.unionAll(front)


def _in_order(summaries: DataFrame, each: Callable[[list[tuple[int, object]]], list[tuple[int, int, object]]], c: Bars) -> DataFrame:
    """``each`` over the summaries of a symbol's blocks in order: what to carry to which block."""
    symbol = summaries.schema[c.symbol].name

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column(_BLOCK).to_pylist(), t.column(_CARRY).to_pylist()))
        out = each([(b, pickle.loads(raw)) for b, raw in rows])
        name = t.column(symbol).combine_chunks().take(pa.array([0] * len(out), pa.int64()))
        return pa.table([name, pa.array([b for b, *_ in out], pa.int32()), pa.array([k for _, k, _ in out], pa.int32()), pa.array([pickle.dumps(x) for *_, x in out], pa.binary())], names=[symbol, _BLOCK, _KIND, _CARRY])

    return summaries.groupBy(symbol).applyInArrow(lambda t: run(t), summaries.schema)


def add_indicators_blocked(df: DataFrame, wanted: dict[str, Indicator], *, c: Bars = Bars(), block_bars: int = BLOCK_BARS, keep_blocks: bool = False) -> DataFrame:
    """As ``add_indicators``, with long symbols in time blocks; ``LiveSignal`` makes columns of events.

    Everything works this way but displaced lines, smoothing that restarts at every bar (windowed Keltner
    bands), flows that skip bars (``on_invalid='null'`` of a running sum) and delayed recurrences within
    signals, which are refused. Missing prices are left out of windows and carried on by recurrences.
    ``keep_blocks`` leaves the block column for a later call or ``run_blocked``.
    """
    c.check(df)
    new = [n for alias, i in wanted.items() for n in i.names(alias)]
    if len(set(new)) != len(new) or set(new) & set(c.names):
        raise ValueError("output names must differ from each other and from the bar columns")
    if not wanted:
        return df
    parts: dict[Indicator, int] = {}
    for i in wanted.values():
        for p, before in _parts(i):
            parts[p] = max(before, parts.get(p, 0))
    rolling = [i for i in parts if kernels.has_kernel(i)]
    chains = {i: _chain(i) for i in parts if i not in rolling and _chain(i)}
    stops = [i for i in parts if isinstance(i, T.ParabolicSar) and not parts[i]]
    indexes = [i for i in chains if isinstance(i, T.Adx)]
    if other := [i.name for i in parts if i not in rolling and i not in stops and (i not in chains or parts[i] > (0 if i in indexes else 1))]:
        raise ValueError(f"not known in time blocks: {', '.join(other)}")
    fields = set().union(*map(_fields_of, wanted.values()))
    halo = max([1, *(kernels.lookback(i) + parts[i] for i in rolling), *(RUN_IN for _ in stops)])
    block_bars = max(block_bars, 4 * max(halo, *(i.least_bars for i in [*parts, *wanted.values()])))
    halo = max([halo, *(kernels.lookback(i) + parts[i] + kernels.grid(i) - 1 for i in rolling)])
    block_bars = max(block_bars, halo)
    needs = sorted(fields | {x for i in rolling for x in kernels.reads(i)} | {x for k in chains.values() for x in k.needs} | ({"high", "low", "close"} if stops else set()))
    source = {x: getattr(c, x, x) for x in needs}
    folder = shared_folder(df.sparkSession, "blocks")
    base = df.drop(*new)
    bars = with_blocks(base, folder, block_bars, c)
    key = StructType([df.schema[c.symbol], *StructType.fromDDL(f"`{_BLOCK}` int").fields])
    summary_schema = StructType([*key.fields, *StructType.fromDDL(f"`{_KIND}` int, `{_CARRY}` binary").fields])
    thin = bars.select(*dict.fromkeys([c.symbol, c.ts, c.seq, *source.values()]), _BLOCK)
    steps = {a: k.step() for a, k in chains.items()}
    number = {i: k for k, i in enumerate(parts)}  # states travel by number

    def row(b: pa.RecordBatch, items: list[tuple[int, int, object]]) -> pa.RecordBatch:
        n = len(items)
        symbol = b.column(c.symbol).take(pa.array([0] * n))
        block = b.column(_BLOCK)[0].as_py()
        return pa.RecordBatch.from_arrays([symbol, pa.array([block + d for d, *_ in items], pa.int32()), pa.array([k for _, k, _ in items], pa.int32()), pa.array([pickle.dumps(x) for *_, x in items], pa.binary())], names=[c.symbol, _BLOCK, _KIND, _CARRY])

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The halo of the next block, and the block's map of every recurrence."""
        for b in _groups(batches):
            x = _numbers(b, source)
            first, last = {k: float(v[0]) for k, v in x.items()}, {k: float(v[-1]) for k, v in x.items()}
            maps = {}
            for a, k in chains.items():
                if b.column(_BLOCK)[0].as_py() == 0:
                    maps[number[a]] = [float(t[-1]) for t in k.first(k.inputs(x, None))]
                else:
                    rest = {y: v[1:] for y, v in x.items()}
                    maps[number[a]] = [float(t[-1]) for t in k.run(k.inputs(rest, first), [0.0] * k.size)] if b.num_rows > 1 else [0.0] * k.size
            yield row(b, [(1, 0, {"halo": {k: v[-halo:].copy() for k, v in x.items()}}), (0, 1, (b.num_rows, first, last, maps))])

    def compose(blocks: list) -> list:
        """How many bars and which values of every recurrence are before each block."""
        out, state, was, bars_before = [], {}, None, 0
        for block, (n, first, last, maps) in blocks:
            if block == 0:
                state = {a: np.array(m) for a, m in maps.items()}
            else:
                out.append((block, 0, {"state": {a: s.tolist() for a, s in state.items()}, "bars": bars_before}))
                for a, k in chains.items():
                    one = k.run(k.inputs({x: np.array([v]) for x, v in first.items()}, was), state[number[a]])
                    state[number[a]] = np.linalg.matrix_power(steps[a], n - 1) @ np.array([t[-1] for t in one]) + np.array(maps[number[a]])
            was, bars_before = last, bars_before + n
        return out

    looked = saved(_stream(thin, c).mapInArrow(first_look, summary_schema), f"{folder}/looked")
    carry = looked.where(F.col(_KIND) == 0)
    if chains or any(kernels.grid(i) > 1 for i in rolling):
        carry = carry.unionAll(_in_order(looked.where(F.col(_KIND) == 1), compose, c))

    def traces(x: dict, carried: dict, a: Indicator) -> list[np.ndarray]:
        k = chains[a]
        if "state" not in carried:
            return k.first(k.inputs(x, None))
        return k.run(k.inputs(x, {y: float(v[-1]) for y, v in carried["halo"].items()}), carried["state"][number[a]])

    if indexes:

        def second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _groups(batches):
                carried, own = _joined(b)
                if own.num_rows:
                    x = _numbers(own, source)
                    yield row(own, [(0, 1, {number[i]: index_summary(i, traces(x, carried, i)) for i in indexes})])

        def compose_index(blocks: list) -> list:
            out, state = [], {number[i]: (0, 0.0) for i in indexes}
            for block, summary in blocks:
                out.append((block, 0, {"index": dict(state)}))
                state = {number[i]: index_step(i, state[number[i]], summary[number[i]]) for i in indexes}
            return out

        carry = saved(carry, f"{folder}/carried")
        again = saved(_stream(_with_carry(thin, carry, c), c, (_KIND,)).mapInArrow(second_look, summary_schema), f"{folder}/indexed")
        carry = carry.unionAll(_in_order(again, compose_index, c))
    if stops:
        carry = carry.unionAll(_stop_states(thin, carry.where(F.col(_KIND) == 0), {number[i]: i for i in stops}, source, summary_schema, folder, row, c))
    carry = saved(carry, f"{folder}/carry")
    kept = [*base.columns, *([_BLOCK] if keep_blocks and _BLOCK not in base.columns else [])]
    kinds = [(n, pa.string() if isinstance(i, LiveSignal) else pa.float64()) for a, i in wanted.items() for n in i.names(a)]
    schema = StructType([*[bars.schema[x] for x in kept], *[StructField(n, StringType() if k == pa.string() else DoubleType()) for n, k in kinds]])

    def results(x: dict, size: int, carried: dict) -> dict:
        """Of every indicator: its outputs (values, not null) over the block, after as many bars before it
        as a signal looks at."""
        before = carried.get("halo", {})
        ahead = len(next(iter(before.values()))) if before else 0
        whole = {k: np.append(before[k], v) for k, v in x.items()} if ahead else x
        out = {}
        for i, back in parts.items():
            if i in rolling:
                skip = (ahead - carried.get("bars", 0)) % kernels.grid(i)  # sums begin where those of the whole symbol do
                held = ahead - skip
                if held < min(ahead, kernels.lookback(i) + back):
                    skip, held = 0, ahead
                pad, late = max(0, back - held), max(0, held - back)
                got = {o: (np.append(np.full(pad, np.nan), v[late:]), np.append(np.zeros(pad, bool), ok[late:])) for o, (v, ok) in kernels.arrays(i, {k: v[skip:] for k, v in whole.items()}).items()}
            else:
                if i in stops:
                    values = {"": sar_fold(i, x, carried.get("stop", {}).get(number[i]))[0]}
                elif i in indexes:
                    values = index_lines(i, size, traces(x, carried, i), carried["index"][number[i]])
                else:
                    values = chains[i].shown(x, traces(x, carried, i))
                    if "state" not in carried:  # warm-up of the first block
                        values = {o: np.where(np.arange(size) >= _shown_from(i), v, np.nan) for o, v in values.items()}
                    if back:  # the bar before the block, from the state there
                        last = chains[i].shown({k: v[-1:] for k, v in before.items()}, [np.array([y]) for y in carried["state"][number[i]]]) if "state" in carried else {o: [np.nan] for o in values}
                        values = {o: np.append(last[o], v) for o, v in values.items()}
                got = {o: (v, ~np.isnan(v)) for o, v in values.items()}
            out[i] = got
        return out

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            carried, own = _joined(b)
            if not own.num_rows:
                continue
            x, size = _numbers(own, source), own.num_rows
            got = results(x, size, carried)

            def values(at, x=x, size=size, got=got, carried=carried) -> tuple[np.ndarray, np.ndarray]:
                if isinstance(at, str):
                    return np.append(carried["halo"][at][-1] if "halo" in carried else np.nan, x[at][:-1]), x[at]
                late = at[2] if len(at) > 2 else 0
                v, ok = got[at[0]][at[1]]
                v = np.where(ok, v, np.nan)
                return v[len(v) - size - late - 1 : len(v) - late - 1], v[len(v) - size - late : len(v) - late]

            made = []
            for i in wanted.values():
                if isinstance(i, LiveSignal):
                    made.append(pa.array(_EVENTS[signal_events(i, values)], pa.string()))
                else:
                    made.extend(pa.array(v[len(v) - size :], pa.float64(), mask=~ok[len(v) - size :]) for v, ok in (got[i][o] for o in i.outputs))
            yield pa.RecordBatch.from_arrays([*(own.column(n) for n in kept), *made], names=[*kept, *[n for n, _ in kinds]])

    return _stream(_with_carry(bars, carry, c), c, (_KIND,)).mapInArrow(outputs, schema).select(*kept, *new)


def _shown_from(i: Indicator) -> int:
    """The first bar at which a recurrence shows its value, where its series do not say."""
    return i.least_bars - 1 if isinstance(i, (T.Dema, T.Tema, V.Keltner, V.KeltnerPrice)) else 0


def _stop_states(thin: DataFrame, carry: DataFrame, stops: dict[int, T.ParabolicSar], source: dict[str, str], schema: StructType, folder: str, row, c: Bars) -> DataFrame:
    """The state of every stop and reverse before each block: guessed from the halo, then repeated for
    blocks that began from another state than the one the block before ended in, until there are none."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            carried, own = _joined(b)
            if not own.num_rows:
                continue
            x, began, ended = _numbers(own, source), {}, {}
            for k, i in stops.items():
                if "true" in carried:
                    began[k] = carried["true"][k]
                else:
                    began[k] = sar_fold(i, carried["halo"], None)[1] if "halo" in carried else None
                ended[k] = sar_fold(i, x, began[k])[1]
            yield row(own, [(0, 1, (began, ended))])

    def check(blocks: list) -> list:
        """States before the blocks; kind 1 where a block has to be folded again."""
        out, was = [], None
        for block, (began, ended) in blocks:
            true = was if block else began
            out.append((block, int(repr(true) != repr(began)), {"true": true}))
            was = ended
        return out

    halos = carry
    folded = saved(_stream(_with_carry(thin, halos, c), c, (_KIND,)).mapInArrow(fold, schema), f"{folder}/stops-0")
    turn = 0
    while True:
        turn += 1
        checked = saved(_in_order(folded, check, c), f"{folder}/checked-{turn}")
        wrong = checked.where(F.col(_KIND) == 1)
        if wrong.isEmpty():
            break
        on = [c.symbol, _BLOCK]
        part = thin.join(wrong.select(*on), on, "left_semi")
        again = _stream(_with_carry(part, wrong, c), c, (_KIND,)).mapInArrow(fold, schema)
        folded = saved(folded.join(wrong.select(*on), on, "left_anti").unionByName(again), f"{folder}/stops-{turn}")

    def stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [pickle.dumps({"stop": pickle.loads(r)["true"]}) for r in b.column(_CARRY).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c.symbol), b.column(_BLOCK), pa.array([0] * b.num_rows, pa.int32()), pa.array(raw, pa.binary())], names=[c.symbol, _BLOCK, _KIND, _CARRY])

    return checked.mapInArrow(stated, schema)
