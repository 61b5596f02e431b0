"""Indicators, signals, divergence, pattern scans and backtests on Structured Streaming, with the results
of the batch form."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from quantloom.functions.indicator import Indicator
from quantloom.functions.sessions import Calendar, Gap
from quantloom.schema import Bars
from quantloom.streaming.steppers import freeze, thaw


def live_bars(ticks: DataFrame, *, symbol: Column, ts: str, width: str, price: Column, volume: Column, order: list[Column], lateness: str = "10 minutes", c: Bars = Bars()) -> DataFrame:
    """Tumbling bars from a tick stream; a bar is final once the watermark has passed its end."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    t = ticks.withWatermark(ts, lateness).select(F.col(ts), symbol.alias(c.symbol), price.cast("double").alias("_p"), volume.cast("double").alias("_v"), at.alias("_at"))
    bars = t.groupBy(F.window(ts, width).alias("_w"), c.symbol).agg(
        F.min_by("_p", "_at").alias(c.open), F.max("_p").alias(c.high), F.min("_p").alias(c.low), F.max_by("_p", "_at").alias(c.close), F.sum("_v").alias(c.volume))
    return bars.select(c.symbol, F.col("_w.start").alias(c.ts), F.lit(0).cast("long").alias(c.seq), c.open, c.high, c.low, c.close, c.volume)


def _kinds(i: Indicator) -> tuple[str, ...]:
    return i.types if len(i.types) == len(i.outputs) else i.types * len(i.outputs)


def _ms(at) -> float:
    """A time as milliseconds: of timestamps, or of numbers that are seconds."""
    return pd.Timestamp(at).value / 1e6 if not isinstance(at, (int, float)) else at * 1000.0


class _Bundle(StatefulProcessor):
    """Keeps the steppers of one symbol and the place of its last bar; bars before it are dropped
    and counted in ``late``. Where a session begins, the steppers start afresh.

    With ``ordered``, bars wait until the watermark has passed their time: a timer per symbol fires at the
    earliest of them, and what is due is fed in order of time, however it arrived."""

    def __init__(self, wanted: dict[str, Indicator], c: Bars, columns: list[str], ttl_ms: int | None, sessions=None, ordered: bool = False):
        self.wanted, self.c, self.columns, self.ttl_ms, self.sessions, self.ordered = wanted, c, columns, ttl_ms, sessions, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bundle", StructType([StructField("data", BinaryType())]), self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Feeds a symbol's history to the steppers without output."""
        for _ in self.handleInputRows(key, iter([initialState]), timerValues):
            pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._fed([r for pdf in rows for r in pdf.to_dict("records")], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fed([], timerValues)

    def _fed(self, new: list[dict], timerValues) -> Iterator[pd.DataFrame]:
        c = self.c
        if self.state.exists():
            frozen, last, late, waiting = pickle.loads(self.state.get()[0])
            steppers = {a: thaw(i.start(), frozen[a]) for a, i in self.wanted.items()}
        else:
            steppers, last, late, waiting = {a: i.start() for a, i in self.wanted.items()}, None, 0, []
        rows = sorted([*waiting, *new], key=lambda r: (r[c.ts], r[c.seq]))
        if self.ordered:
            mark = timerValues.getCurrentWatermarkInMs()
            waiting = [r for r in rows if _ms(r[c.ts]) >= mark]
            rows = [r for r in rows if _ms(r[c.ts]) < mark]
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            if waiting:
                self.handle.registerTimer(int(_ms(waiting[0][c.ts])) + 1)
        out = []
        for r in rows:
            at = (r[c.ts], r[c.seq])
            if last is not None and at <= last:
                late += 1
                continue
            if self.sessions and last is not None and self.sessions.begins(_ms(last[0]), _ms(at[0])):
                for s in steppers.values():
                    s.reset()
            last = at
            bar = {x: r[getattr(c, x)] for x in ("open", "high", "low", "close", "volume")}
            row = [r[x] for x in self.columns]
            for alias, s in steppers.items():
                got = s.next(bar)
                for o in self.wanted[alias].outputs:
                    y = None if got is None else got[o]
                    row.append(None if y is None or (isinstance(y, float) and math.isnan(y)) else y)
            out.append((*row, late))
        self.state.update((pickle.dumps(({a: freeze(s) for a, s in steppers.items()}, last, late, waiting)),))
        names = [*self.columns, *[n for a, i in self.wanted.items() for n in i.names(a)], "late"]
        frame = pd.DataFrame(out, columns=names)
        for a, i in self.wanted.items():
            for n, kind in zip(i.names(a), _kinds(i)):
                frame[n] = frame[n].astype("Float64" if kind == "double" else "object")
        if len(frame):
            yield frame

    def close(self) -> None: ...


def live_indicators(bars: DataFrame, wanted: dict[str, Indicator], *, history: DataFrame | None = None, ttl_ms: int | None = None, lateness: str | None = None, sessions: Calendar | Gap | None = None, c: Bars = Bars()) -> DataFrame:
    """Indicators over a stream of bars, state per symbol. ``late`` counts the symbol's dropped bars.

    Without ``lateness`` a bar is processed as it comes, and dropped if a later one came before it. With it
    (``"10 minutes"``) bars wait until the watermark has passed them and are released in order, so any input
    whose disorder is within the watermark gives the results of the batch form; what is later still is
    dropped by the watermark. The bars of the last stretch wait until later bars move the watermark on.
    ``sessions`` starts everything afresh in each session (of UTC, as far as calendars go).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). ``ttl_ms`` forgets
    symbols that stopped. ``history`` (a batch frame of bars) warms the state up before the first bar.
    """
    if lateness and (ttl_ms or history is not None):
        raise ValueError("lateness goes with neither ttl_ms nor history")
    columns = list(c.names)
    schema = StructType([*[bars.schema[x] for x in columns], *[StructField(n, DoubleType() if kind == "double" else StringType()) for a, i in wanted.items() for n, kind in zip(i.names(a), _kinds(i))], StructField("late", LongType())])
    before = None if history is None else history.select(*columns).groupBy(c.symbol)
    rows = bars.select(*columns)
    if lateness:
        rows = rows.withWatermark(c.ts, lateness)
    mode = "EventTime" if lateness else "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy(c.symbol).transformWithStateInPandas(_Bundle(wanted, c, columns, ttl_ms, sessions, bool(lateness)), schema, outputMode="append", timeMode=mode, initialState=before)
