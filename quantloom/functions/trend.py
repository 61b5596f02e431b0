"""Trend indicators."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.indicator import ColumnIndicator, SeriesIndicator
from quantloom.numeric import check_period, warm
from quantloom.operators.recurrence import ema, wilder_mean
from quantloom.schema import Bars

#: Above this period a weighted mean runs over an array instead of lag columns.
WIDEST_LAG = 64


def sma(x: Column, n: int, c: Bars) -> Column:
    return warm(n - 1, F.avg(x).over(c.last(n)), c.window())


def wma(x: Column, n: int, c: Bars) -> Column:
    """Weights 1 to n, the newest n; null while any of the n values is missing."""
    if n <= WIDEST_LAG:
        total = sum((F.lag(x, k).over(c.window()) if k else x) * (n - k) for k in range(n))
        return total / (n * (n + 1) / 2)
    values = F.collect_list(x).over(c.last(n))
    total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) == n, total / (n * (n + 1) / 2))


@dataclass(frozen=True)
class Sma(ColumnIndicator):
    n: int
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
        yield {"": sma(c.col(self.price), self.n, c)}


@dataclass(frozen=True)
class Wma(ColumnIndicator):
    n: int
    price: str = "close"

    def __post_init__(self):
        check_period(self.n)

    @property
    def least_bars(self):
        return self.n

    def stages(self, c):
        yield {"": wma(c.col(self.price), self.n, c)}


@dataclass(frozen=True)
class Hma(ColumnIndicator):
    n: int
    price: str = "close"

    def __post_init__(self):
        check_period(self.n, 2)

    @property
    def smooth(self) -> int:
        return max(1, math.floor(math.sqrt(self.n) + 0.5))

    @property
    def least_bars(self):
        return self.n + self.smooth - 1

    def stages(self, c):
        x = c.col(self.price)
        yield {"_hma_raw": 2 * wma(x, self.n // 2, c) - wma(x, self.n, c)}
        yield {"": warm(self.n + self.smooth - 2, wma(F.col("_hma_raw"), self.smooth, c), c.window())}


@dataclass(frozen=True)
class Ema(SeriesIndicator):
    """Seeded with the first value, or with ``initial`` before it."""

    n: int
    price: str = "close"
    initial: float | None = None

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
        return self.n

    def series(self, bars):
        x = bars[self.price]
        if self.initial is not None:
            return {"": ema(np.append(self.initial, x), self.n)[1:]}
        return {"": ema(x, self.n)}


def _cut(y: np.ndarray, first: int) -> np.ndarray:
    y = y.copy()
    y[:first] = np.nan
    return y


@dataclass(frozen=True)
class Dema(SeriesIndicator):
    n: int
    price: str = "close"

    def __post_init__(self):
        check_period(self.n)

    @property
    def needs(self):
        return (self.price,)

    @property
    def least_bars(self):
        return 2 * self.n - 1

    def series(self, bars):
        e1 = ema(bars[self.price], self.n)
        return {"": _cut(2 * e1 - ema(e1, self.n), 2 * self.n - 2)}


@dataclass(frozen=True)
class Tema(SeriesIndicator):
    n: int
    price: str = "close"

    def __post_init__(self):
        check_period(self.n)

    @property
    def needs(self):
        return (self.price,)

    @property
    def least_bars(self):
        return 3 * self.n - 2

    def series(self, bars):
        e1 = ema(bars[self.price], self.n)
        e2 = ema(e1, self.n)
        return {"": _cut(3 * e1 - 3 * e2 + ema(e2, self.n), 3 * self.n - 3)}


@dataclass(frozen=True)
class Macd(SeriesIndicator):
    fast: int = 12
    slow: int = 26
    signal: int = 9
    price: str = "close"
    outputs = ("macd", "signal", "histogram")

    def __post_init__(self):
        for x in (self.fast, self.slow, self.signal):
            check_period(x)
        if self.fast >= self.slow:
            raise ValueError("fast must be below slow")

    @property
    def needs(self):
        return (self.price,)

    def series(self, bars):
        line = ema(bars[self.price], self.fast) - ema(bars[self.price], self.slow)
        signal = ema(line, self.signal)
        return {"macd": line, "signal": signal, "histogram": line - signal}


@dataclass(frozen=True)
class Adx(SeriesIndicator):
    """Directional movement with Wilder sums. While the smoothed range is 0 all three lines are 0
    and the bar does not feed the directional index."""

    n: int = 14
    needs = ("high", "low", "close")
    outputs = ("plus_di", "minus_di", "adx")

    def __post_init__(self):
        check_period(self.n)

    @property
    def least_bars(self):
        return 2 * self.n

    @staticmethod
    def movement(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """True range and directional movements of all bars but the first."""
        up, down = h[1:] - h[:-1], l[:-1] - l[1:]
        plus = np.where((up > down) & (up > 0), up, 0.0)
        minus = np.where((down > up) & (down > 0), down, 0.0)
        return np.maximum(h[1:] - l[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1]))), plus, minus

    @staticmethod
    def index(tr: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(flat, plus line, minus line, directional index) of smoothed ranges and movements."""
        flat = tr == 0
        some = np.where(flat, 1.0, tr)
        p, m = 100 * plus / some, 100 * minus / some
        total = p + m
        return flat, p, m, np.where(total == 0, 0.0, 100 * np.abs(p - m) / np.where(total == 0, 1.0, total))

    def series(self, bars):
        h, l, c = bars["high"], bars["low"], bars["close"]
        n, size = self.n, len(c)
        out = {k: np.full(size, np.nan) for k in self.outputs}
        if size <= n:
            return out
        tr, plus, minus = self.movement(h, l, c)
        s = {k: wilder_mean(x, n)[n - 1 :] for k, x in (("tr", tr), ("p", plus), ("m", minus))}  # sums are n times these means
        flat, p, m, dx = self.index(s["tr"], s["p"], s["m"])
        fed = np.flatnonzero(~flat)
        adx = np.full(len(p), np.nan)
        if len(fed) >= n:
            adx[fed] = wilder_mean(dx[fed], n)
        shown = flat | ~np.isnan(adx)
        for k, v in (("plus_di", p), ("minus_di", m), ("adx", adx)):
            out[k][n:] = np.where(flat, 0.0, np.where(shown, v, np.nan))
        return out


@dataclass(frozen=True)
class Ichimoku(ColumnIndicator):
    """All five lines start with the longest window and are not displaced, unless ``displace``:
    then both spans are shown kijun bars later and the lagging line kijun bars earlier."""

    tenkan: int = 9
    kijun: int = 26
    senkou_b: int = 52
    displace: bool = False
    outputs = ("tenkan", "kijun", "senkou_a", "senkou_b", "chikou")

    def __post_init__(self):
        check_period(self.tenkan)
        if not self.tenkan <= self.kijun <= self.senkou_b:
            raise ValueError("tenkan <= kijun <= senkou_b is required")

    @property
    def least_bars(self):
        return self.senkou_b

    def stages(self, c):
        mid = lambda n: (F.max(c.col("high")).over(c.last(n)) + F.min(c.col("low")).over(c.last(n))) / 2
        t, k, b = mid(self.tenkan), mid(self.kijun), mid(self.senkou_b)
        lines = {"tenkan": t, "kijun": k, "senkou_a": (t + k) / 2, "senkou_b": b, "chikou": c.col("close")}
        lines = {x: warm(self.senkou_b - 1, v, c.window()) for x, v in lines.items()}
        if not self.displace:
            yield lines
            return
        yield {f"_ichi_{x}": v for x, v in lines.items()}
        moved = {x: F.col(f"_ichi_{x}") for x in lines}
        for x in ("senkou_a", "senkou_b"):
            moved[x] = F.lag(moved[x], self.kijun).over(c.window())
        moved["chikou"] = F.lead(moved["chikou"], self.kijun).over(c.window())
        yield moved


def pivots(kind: str, h: Column, l: Column, c: Column) -> dict[str, Column]:
    """Pivot levels of a finished bar or session: pp, r1 to r4, s1 to s4 (r4, s4 are NaN but for camarilla)."""
    pp, span, none = (h + l + c) / 3, h - l, F.lit(float("nan"))
    if kind == "classic":
        r, s = [2 * pp - l, pp + span, h + 2 * (pp - l), none], [2 * pp - h, pp - span, l - 2 * (h - pp), none]
    elif kind == "fibonacci":
        r, s = [pp + span * f for f in (0.382, 0.618, 1.0)] + [none], [pp - span * f for f in (0.382, 0.618, 1.0)] + [none]
    elif kind == "camarilla":
        r, s = [c + span * 1.1 / d for d in (12, 6, 4, 2)], [c - span * 1.1 / d for d in (12, 6, 4, 2)]
    else:
        raise ValueError("kind is classic, fibonacci or camarilla")
    return {"pp": pp} | {f"r{i + 1}": x for i, x in enumerate(r)} | {f"s{i + 1}": x for i, x in enumerate(s)}


@dataclass(frozen=True)
class Pivots(ColumnIndicator):
    """Levels from the previous bar of the symbol."""

    kind: str = "classic"
    outputs = ("pp", "r1", "r2", "r3", "r4", "s1", "s2", "s3", "s4")

    def __post_init__(self):
        if self.kind not in ("classic", "fibonacci", "camarilla"):
            raise ValueError("kind is classic, fibonacci or camarilla")

    @property
    def least_bars(self):
        return 2

    def stages(self, c):
        yield {f"_prev_{x}": F.lag(c.col(x)).over(c.window()) for x in ("high", "low", "close")}
        h, l, p = (F.col(f"_prev_{x}") for x in ("high", "low", "close"))
        yield {k: F.when(p.isNotNull(), v) for k, v in pivots(self.kind, h, l, p).items()}


@dataclass(frozen=True)
class ParabolicSar(SeriesIndicator):
    """Stop and reverse. The first direction is long if the second close reaches the first bar's middle."""

    begin: float = 0.02
    step: float = 0.02
    most: float = 0.20
    needs = ("high", "low", "close")
    outputs = ("",)

    def __post_init__(self):
        if min(self.begin, self.step, self.most) <= 0 or self.begin > self.most or self.step > self.most:
            raise ValueError("0 < begin, step <= most is required")

    @property
    def least_bars(self):
        return 2

    def series(self, bars):
        state = self.start()
        out = np.full(len(bars["close"]), np.nan)
        for i, (h, l, c) in enumerate(zip(bars["high"].tolist(), bars["low"].tolist(), bars["close"].tolist())):
            y = state.next({"high": h, "low": l, "close": c})
            if y is not None:
                out[i] = y[""]
        return {"": out}


@dataclass(frozen=True)
class HeikinAshi(SeriesIndicator):
    needs = ("open", "high", "low", "close")
    outputs = ("open", "high", "low", "close")

    def series(self, bars):
        o, h, l, c = (bars[x] for x in ("open", "high", "low", "close"))
        hc = (o + h + l + c) / 4
        ho = np.empty_like(hc)
        if len(hc):  # each open is the middle of the bar before: smoothing with 1/2, seeded by the first middle
            import pandas as pd

            ho[:] = pd.Series(np.append((o[0] + c[0]) / 2, hc[:-1])).ewm(alpha=0.5, adjust=False).mean()
        return {"open": ho, "high": np.maximum(h, np.maximum(ho, hc)), "low": np.minimum(l, np.minimum(ho, hc)), "close": hc}
