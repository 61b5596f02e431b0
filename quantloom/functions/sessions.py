"""Sessions: stretches of a symbol's bars, by the calendar or by gaps in time.

A session is a second key: with ``Bars(session=...)`` every indicator, signal and backtest key starts afresh
in it (the session's volume-weighted price, for one), and hot symbols spread over their sessions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.trend import pivots
from quantloom.schema import Bars


@dataclass(frozen=True)
class Calendar:
    """Sessions of ``hours`` from ``offset_hours`` after midnight of the session time zone on."""

    hours: float = 24
    offset_hours: float = 0

    def __post_init__(self):
        if not self.hours > 0:
            raise ValueError("hours must be positive")

    def begins(self, was_ms: float, at_ms: float) -> bool:
        """Whether a bar opens a session, given the time of the bar before (milliseconds)."""
        width, offset = self.hours * 3_600_000, self.offset_hours * 3_600_000
        return (at_ms - offset) // width != (was_ms - offset) // width


@dataclass(frozen=True)
class Gap:
    """A session ends where the next bar comes more than ``minutes`` later."""

    minutes: float

    def __post_init__(self):
        if not self.minutes > 0:
            raise ValueError("minutes must be positive")

    def begins(self, was_ms: float, at_ms: float) -> bool:
        return at_ms - was_ms > self.minutes * 60_000


def with_sessions(bars: DataFrame, rule: Calendar | Gap, *, name: str = "session", c: Bars = Bars()) -> DataFrame:
    """Adds the first time of each bar's session: the calendar's start, or the session's first bar.

    A calendar needs no shuffle. Gaps are found on the window that all operators share."""
    if name in bars.columns:
        raise ValueError(f"the table has {name} already")
    if isinstance(rule, Calendar):
        # of wall-clock times, so that days of any time zone and with a changed hour begin at their midnight
        wall = F.unix_micros(F.from_utc_timestamp(F.col(c.ts).cast("timestamp"), F.current_timezone()))
        width, offset = int(rule.hours * 3_600_000_000), int(rule.offset_hours * 3_600_000_000)
        start = F.floor((wall - offset) / F.lit(width)) * width + offset
        return bars.withColumn(name, F.to_utc_timestamp(F.timestamp_micros(start.cast("long")), F.current_timezone()))
    w = c.window()
    late = F.unix_micros(F.col(c.ts).cast("timestamp")) - F.unix_micros(F.lag(c.ts).over(w).cast("timestamp")) > int(rule.minutes * 60_000_000)
    opened = bars.withColumn("__opened", F.when(F.coalesce(late, F.lit(True)), F.col(c.ts)))
    return opened.withColumn(name, F.last("__opened", ignorenulls=True).over(c.so_far())).drop("__opened")


def session_bars(bars: DataFrame, *, name: str = "session", c: Bars = Bars()) -> DataFrame:
    """One bar per session, by partial aggregation."""
    at = F.struct(c.ts, c.seq)
    return bars.groupBy(c.symbol, name).agg(
        F.min_by(c.open, at).alias(c.open), F.max(c.high).alias(c.high), F.min(c.low).alias(c.low), F.max_by(c.close, at).alias(c.close), F.sum(c.volume).alias(c.volume), F.count(F.lit(1)).alias("bars"))


def gap_session_bars(bars: DataFrame, rule: Gap, *, c: Bars = Bars()) -> DataFrame:
    """One bar per gap-defined session without numbering bars first: Spark merges sessions as it aggregates,
    in batches and on watermarked streams. ``session`` is the first bar's time, ``until`` the end of the gap."""
    at = F.struct(c.ts, c.seq)
    held = F.session_window(F.col(c.ts), F.lit(f"{int(rule.minutes * 60_000_000) + 1} microseconds"))
    got = bars.groupBy(c.symbol, held.alias("w")).agg(
        F.min_by(c.open, at).alias(c.open), F.max(c.high).alias(c.high), F.min(c.low).alias(c.low), F.max_by(c.close, at).alias(c.close), F.sum(c.volume).alias(c.volume), F.count(F.lit(1)).alias("bars"))
    return got.select(c.symbol, F.col("w.start").alias("session"), F.col("w.end").alias("until"), c.open, c.high, c.low, c.close, c.volume, "bars")


def session_pivots(bars: DataFrame, kind: str = "classic", *, name: str = "session", alias: str = "pivot", c: Bars = Bars()) -> DataFrame:
    """Adds the pivot levels of the session before to every bar; null in a symbol's first session."""
    before = Window.partitionBy(c.symbol).orderBy(name)
    was = session_bars(bars, name=name, c=c).select(c.symbol, name, *[F.lag(x).over(before).alias(f"__{x}") for x in (c.high, c.low, c.close)])
    h, l, p = (F.col(f"__{x}") for x in (c.high, c.low, c.close))
    levels = {f"{alias}_{k}": F.when(p.isNotNull(), v) for k, v in pivots(kind, h, l, p).items()}
    return bars.join(was, [c.symbol, name]).select(*bars.columns, *[v.alias(k) for k, v in levels.items()])


def in_session(x: Column, *, name: str = "session", c: Bars = Bars()) -> Column:
    """``x`` of the bar before, null where a session begins."""
    return F.lag(x).over(Window.partitionBy(c.symbol, name).orderBy(c.ts, c.seq))
