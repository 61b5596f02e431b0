"""Volatility indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.indicator import ColumnIndicator, SeriesIndicator
from quantloom.functions.trend import sma
from quantloom.numeric import check_period, ieee_div, warm
from quantloom.operators.recurrence import ema, wilder_mean
from quantloom.schema import Bars


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first bar's range is high - low."""
    tr = h - l
    if len(c) > 1:
        tr = tr.copy()
        tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])))
    return tr


def true_range_column(c: Bars = Bars()) -> Column:
    """The true range as a column; the first bar's is high - low."""
    h, l, was = c.col("high"), c.col("low"), F.lag(c.col("close")).over(c.window())
    return F.greatest(h - l, F.abs(h - was), F.abs(l - was))


def standard_deviation(x: Column, mean: Column | None = None) -> Column:
    """Population deviation as an aggregate, around the mean or around a given one."""
    return F.stddev_pop(x) if mean is None else F.sqrt(F.avg((x - mean) * (x - mean)))


@dataclass(frozen=True)
class Atr(SeriesIndicator):
    n: int = 14
    needs = ("high", "low", "close")

    def __post_init__(self):
        check_period(self.n)

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return self.n

    def series(self, bars):
        return {"": wilder_mean(true_range(bars["high"], bars["low"], bars["close"]), self.n)}


@dataclass(frozen=True)
class Std(ColumnIndicator):
    """Population standard deviation."""

    n: int = 20
    price: str = "close"

    def __post_init__(self):
        check_period(self.n)

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return self.n

    def stages(self, c):
        yield {"": warm(self.n - 1, F.stddev_pop(c.col(self.price)).over(c.last(self.n)), c.window())}


@dataclass(frozen=True)
class Bollinger(ColumnIndicator):
    n: int = 20
    k: float = 2.0
    price: str = "close"
    outputs = ("middle", "upper", "lower", "bandwidth")

    def __post_init__(self):
        check_period(self.n)
        if not self.k > 0:
            raise ValueError("k must be positive")

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return self.n

    def stages(self, c):
        x = c.col(self.price)
        yield {"_mid": sma(x, self.n, c), "_dev": self.k * F.stddev_pop(x).over(c.last(self.n))}
        m, d = F.col("_mid"), F.col("_dev")
        yield {"middle": m, "upper": m + d, "lower": m - d, "bandwidth": ieee_div((m + d) - (m - d), m)}


@dataclass(frozen=True)
class Keltner(SeriesIndicator):
    """EMA of closes plus and minus ``mult`` ATRs, aligned bar by bar. ``atr_mode='windowed'``
    takes the range mean afresh over the last max(ema_n, atr_n) bars instead of recursively."""

    ema_n: int = 20
    atr_n: int = 10
    mult: float = 2.0
    atr_mode: str = "recursive"
    needs = ("high", "low", "close")
    outputs = ("middle", "upper", "lower", "bandwidth")

    def __post_init__(self):
        check_period(self.ema_n)
        check_period(self.atr_n)
        if not self.mult > 0 or self.atr_mode not in ("recursive", "windowed"):
            raise ValueError("mult must be positive, atr_mode recursive or windowed")

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return max(self.ema_n, self.atr_n)

    def series(self, bars):
        h, l, c = bars["high"], bars["low"], bars["close"]
        first = self.least_bars - 1
        mid = ema(c, self.ema_n)
        if self.atr_mode == "recursive":
            width = wilder_mean(true_range(h, l, c), self.atr_n)
        else:
            width = np.full(len(c), np.nan)
            for i in range(first, len(c)):
                s = slice(i - first, i + 1)
                width[i] = wilder_mean(true_range(h[s], l[s], c[s]), self.atr_n)[-1]
        mid = np.where(np.arange(len(c)) >= first, mid, np.nan)
        up, low = mid + self.mult * width, mid - self.mult * width
        with np.errstate(divide="ignore", invalid="ignore"):
            return {"middle": mid, "upper": up, "lower": low, "bandwidth": (up - low) / mid}


@dataclass(frozen=True)
class KeltnerPrice(SeriesIndicator):
    """The middle line from prices alone, shown from bar max(ema_n - 1, atr_n) on."""

    ema_n: int = 20
    atr_n: int = 10
    price: str = "close"

    def __post_init__(self):
        check_period(self.ema_n)
        check_period(self.atr_n)

    @property
    def needs(self):
        return (self.price,)

    @property
    def least_bars(self):
        return max(self.ema_n - 1, self.atr_n) + 1

    def series(self, bars):
        y = ema(bars[self.price], self.ema_n)
        y[: self.least_bars - 1] = np.nan
        return {"": y}


@dataclass(frozen=True)
class Donchian(ColumnIndicator):
    """The window includes the current bar."""

    n: int = 20
    outputs = ("upper", "middle", "lower")

    def __post_init__(self):
        check_period(self.n)

    @property
    def least_bars(self):
        return self.n

    def stages(self, c):
        up, low = F.max(c.col("high")).over(c.last(self.n)), F.min(c.col("low")).over(c.last(self.n))
        yield {k: warm(self.n - 1, v, c.window()) for k, v in (("upper", up), ("middle", (up + low) / 2), ("lower", low))}
