"""Momentum indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from quantloom.functions.indicator import ColumnIndicator, SeriesIndicator
from quantloom.numeric import check_period, ieee_div, warm
from quantloom.operators.recurrence import wilder_mean


@dataclass(frozen=True)
class Rsi(SeriesIndicator):
    n: int = 14
    price: str = "close"

    def __post_init__(self):
        check_period(self.n)

    @property
    def needs(self):
        return (self.price,)

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return self.n + 1

    def series(self, bars):
        x = bars[self.price]
        out = np.full(len(x), np.nan)
        if len(x) > self.n:
            d = np.diff(x)
            g, l = wilder_mean(np.where(d > 0, d, 0.0), self.n), wilder_mean(np.where(d < 0, -d, 0.0), self.n)
            some = np.where(l == 0, 1.0, l)
            out[1:] = np.where(np.isnan(g), np.nan, np.where(l == 0, np.where(g == 0, 50.0, 100.0), 100 - 100 / (1 + g / some)))
        return {"": out}


@dataclass(frozen=True)
class Stochastic(ColumnIndicator):
    k: int = 14
    d: int = 3
    outputs = ("k", "d")

    def __post_init__(self):
        check_period(self.k)
        check_period(self.d)

    @property
    def least_bars(self):
        return self.k + self.d - 1

    def stages(self, c):
        high, low = F.max(c.col("high")).over(c.last(self.k)), F.min(c.col("low")).over(c.last(self.k))
        yield {"_k": warm(self.k - 1, F.when(high == low, F.lit(50.0)).otherwise(F.try_divide(100 * (c.col("close") - low), high - low)), c.window())}
        first = self.k + self.d - 2
        yield {"k": warm(first, F.col("_k"), c.window()), "d": warm(first, F.avg("_k").over(c.last(self.d)), c.window())}


@dataclass(frozen=True)
class WilliamsR(ColumnIndicator):
    n: int = 14

    def __post_init__(self):
        check_period(self.n)

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return self.n

    def stages(self, c):
        high, low = F.max(c.col("high")).over(c.last(self.n)), F.min(c.col("low")).over(c.last(self.n))
        yield {"": warm(self.n - 1, F.when(high == low, F.lit(-50.0)).otherwise(F.try_divide(-100 * (high - c.col("close")), high - low)), c.window())}


@dataclass(frozen=True)
class Cci(ColumnIndicator):
    """The mean deviation is taken around the current window's mean, so the window is an array."""

    n: int = 20

    def __post_init__(self):
        check_period(self.n)

    @property
    def least_bars(self):
        return self.n

    def stages(self, c):
        yield {"_tp": c.typical()}
        yield {"_tps": F.collect_list("_tp").over(c.last(self.n)), "_mean": F.avg("_tp").over(c.last(self.n))}
        mad = F.aggregate("_tps", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("_mean"))) / self.n
        yield {"": warm(self.n - 1, F.when(mad == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("_tp") - F.col("_mean"), 0.015 * mad)), c.window())}


@dataclass(frozen=True)
class Roc(ColumnIndicator):
    """Percent change over n bars; a zero divisor gives infinities or NaN."""

    n: int = 10
    price: str = "close"

    def __post_init__(self):
        check_period(self.n)

    @property
    def least_bars(self):
        return self.n + 1

    def stages(self, c):
        old = F.lag(c.col(self.price), self.n).over(c.window())
        yield {"": 100 * ieee_div(c.col(self.price) - old, old)}
