"""Bar-by-bar form of every indicator, signal, pattern scan and backtest: ``next(bar)`` returns the outputs or None during warm-up.

State is plain Python data, so it pickles into the state store. Results equal the batch form.
"""

from __future__ import annotations

import math
from collections import deque

from quantloom.functions import momentum as M
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.functions.indicator import STEPPER
from quantloom.functions.patterns import DOUBLE, SCAN, SINGLE, Candle, LivePatterns, rules
from quantloom.functions.signals import LiveDivergence, LiveSignal
from quantloom.operators.backtest import Action, LiveBacktest, Portfolio


class Stepper:
    def __init__(self, spec):
        self.spec = spec
        self.reset()

    def reset(self) -> None:
        self.bars = 0
        self.clear()

    def next(self, bar: dict) -> dict | None:
        self.bars += 1
        return self.step(bar)

    def clear(self) -> None: ...

    def step(self, bar: dict) -> dict | None:
        raise NotImplementedError


class Rolling(Stepper):
    """Finite lookback: a function of the last ``size`` bars."""

    def __init__(self, spec, size: int, first: int, of):
        self.size, self.first, self.of = size, first, of
        super().__init__(spec)

    def clear(self):
        self.kept: deque = deque(maxlen=self.size)

    def step(self, bar):
        self.kept.append(bar)
        return self.of(self.spec, list(self.kept)) if self.bars > self.first else None


def _mean(x):
    return sum(x) / len(x)


def _pstd(x):
    m = _mean(x)
    return math.sqrt(sum((v - m) ** 2 for v in x) / len(x))


def _price(s, k):
    return [b[s.price] for b in k]


def _wma(x):
    n = len(x)
    return sum((i + 1) * v for i, v in enumerate(x)) / (n * (n + 1) / 2)


def _div(a, b):
    if b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
    return a / b


def _sma(s, k):
    return {"": _mean(_price(s, k)[-s.n :])}


def _hma(s, k):
    x = _price(s, k)
    half, full = s.n // 2, s.n
    raw = [2 * _wma(x[i - half + 1 : i + 1]) - _wma(x[i - full + 1 : i + 1]) for i in range(full - 1, len(x))]
    return {"": _wma(raw[-s.smooth :])}


def _bollinger(s, k):
    x = _price(s, k)
    m, d = _mean(x), s.k * _pstd(x)
    return {"middle": m, "upper": m + d, "lower": m - d, "bandwidth": _div((m + d) - (m - d), m)}


def _ends(k):
    return max(b["high"] for b in k), min(b["low"] for b in k)


def _donchian(s, k):
    u, l = _ends(k)
    return {"upper": u, "middle": (u + l) / 2, "lower": l}


def _ichimoku(s, k):
    mid = lambda n: sum(_ends(k[-n:])) / 2
    t, j, b = mid(s.tenkan), mid(s.kijun), mid(s.senkou_b)
    return {"tenkan": t, "kijun": j, "senkou_a": (t + j) / 2, "senkou_b": b, "chikou": k[-1]["close"]}


def _williams(s, k):
    u, l = _ends(k)
    return {"": -50.0 if u == l else -100 * (u - k[-1]["close"]) / (u - l)}


def _stochastic(s, k):
    ks = []
    for i in range(s.k - 1, len(k)):
        u, l = _ends(k[i - s.k + 1 : i + 1])
        ks.append(50.0 if u == l else 100 * (k[i]["close"] - l) / (u - l))
    return {"k": ks[-1], "d": _mean(ks[-s.d :])}


def _tp(b):
    return (b["high"] + b["low"] + b["close"]) / 3


def _cci(s, k):
    x = [_tp(b) for b in k]
    m = _mean(x)
    mad = sum(abs(v - m) for v in x) / len(x)
    return {"": 0.0 if mad == 0 else (x[-1] - m) / (0.015 * mad)}


def _roc(s, k):
    x = _price(s, k)
    return {"": 100 * _div(x[-1] - x[0], x[0])}


def _bad(s, default, message):
    if s.on_invalid == "raise":
        raise ValueError(message)
    return None if s.on_invalid == "null" else default


def _flow(s, b):
    if b["high"] == b["low"]:
        m = _bad(s, 0.0, "a bar has no range")
        return None if m is None else m * b["volume"]
    return (2 * b["close"] - b["high"] - b["low"]) / (b["high"] - b["low"]) * b["volume"]


def _vroc(s, k):
    old = k[0]["volume"]
    return {"": _bad(s, None, "past volume is 0") if old == 0 else (k[-1]["volume"] - old) / old * 100}


def _cmf(s, k):
    v = sum(b["volume"] for b in k)
    flows = [f for f in (_flow(s, b) for b in k) if f is not None]
    if v == 0:
        return {"": _bad(s, None, "volume is 0")}
    return {"": sum(flows) / v if flows else None}


def _mfi(s, k):
    up = down = 0.0
    for a, b in zip(k, k[1:]):
        if _tp(b) > _tp(a):
            up += _tp(b) * b["volume"]
        elif _tp(b) < _tp(a):
            down += _tp(b) * b["volume"]
    return {"": (50.0 if up == 0 else 100.0) if down == 0 else 100 - 100 / (1 + up / down)}


def _pivots(s, k):
    h, l, c = k[0]["high"], k[0]["low"], k[0]["close"]
    pp, span, none = (h + l + c) / 3, h - l, math.nan
    if s.kind == "classic":
        r, d = [2 * pp - l, pp + span, h + 2 * (pp - l), none], [2 * pp - h, pp - span, l - 2 * (h - pp), none]
    elif s.kind == "fibonacci":
        r, d = [pp + span * f for f in (0.382, 0.618, 1.0)] + [none], [pp - span * f for f in (0.382, 0.618, 1.0)] + [none]
    else:
        r, d = [c + span * 1.1 / x for x in (12, 6, 4, 2)], [c - span * 1.1 / x for x in (12, 6, 4, 2)]
    return {"pp": pp} | {f"r{i + 1}": x for i, x in enumerate(r)} | {f"s{i + 1}": x for i, x in enumerate(d)}


class Smooth:
    """Exponential smoothing seeded by its first value."""

    def __init__(self, n: int, value: float | None = None):
        self.a, self.y = 2 / (n + 1), value

    def add(self, x: float) -> float:
        self.y = x if self.y is None else self.a * x + (1 - self.a) * self.y
        return self.y


class Wilder:
    """The mean of the first n values, then Wilder's recurrence."""

    def __init__(self, n: int):
        self.n, self.seen, self.y = n, 0, 0.0

    def add(self, x: float) -> float | None:
        self.seen += 1
        if self.seen <= self.n:
            self.y += x
            if self.seen < self.n:
                return None
            self.y /= self.n
        else:
            self.y = (self.y * (self.n - 1) + x) / self.n
        return self.y


class EmaStep(Stepper):
    def clear(self):
        self.e = Smooth(self.spec.n, self.spec.initial)

    def step(self, bar):
        return {"": self.e.add(bar[self.spec.price])}


class ChainStep(Stepper):
    """Double and triple smoothing."""

    def clear(self):
        self.depth = 2 if isinstance(self.spec, T.Dema) else 3
        self.e = [Smooth(self.spec.n) for _ in range(self.depth)]

    def step(self, bar):
        x, ys = bar[self.spec.price], []
        for e in self.e:
            x = e.add(x)
            ys.append(x)
        if self.bars < self.spec.least_bars:
            return None
        return {"": 2 * ys[0] - ys[1] if self.depth == 2 else 3 * ys[0] - 3 * ys[1] + ys[2]}


class MacdStep(Stepper):
    def clear(self):
        self.f, self.s, self.g = Smooth(self.spec.fast), Smooth(self.spec.slow), Smooth(self.spec.signal)

    def step(self, bar):
        x = bar[self.spec.price]
        line = self.f.add(x) - self.s.add(x)
        signal = self.g.add(line)
        return {"macd": line, "signal": signal, "histogram": line - signal}


class RsiStep(Stepper):
    def clear(self):
        self.was, self.g, self.l = None, Wilder(self.spec.n), Wilder(self.spec.n)

    def step(self, bar):
        x, was = bar[self.spec.price], self.was
        self.was = x
        if was is None:
            return None
        g, l = self.g.add(max(x - was, 0.0)), self.l.add(max(was - x, 0.0))
        if g is None:
            return None
        return {"": (50.0 if g == 0 else 100.0) if l == 0 else 100 - 100 / (1 + g / l)}


def _range(bar, was):
    r = bar["high"] - bar["low"]
    return r if was is None else max(r, abs(bar["high"] - was["close"]), abs(bar["low"] - was["close"]))


class AtrStep(Stepper):
    def clear(self):
        self.was, self.a = None, Wilder(self.spec.n)

    def step(self, bar):
        y = self.a.add(_range(bar, self.was))
        self.was = bar
        return None if y is None else {"": y}


class AdxStep(Stepper):
    def clear(self):
        n = self.spec.n
        self.was, self.t, self.p, self.m, self.d = None, Wilder(n), Wilder(n), Wilder(n), Wilder(n)

    def step(self, bar):
        was, self.was = self.was, bar
        if was is None:
            return None
        up, down = bar["high"] - was["high"], was["low"] - bar["low"]
        t = self.t.add(_range(bar, was))
        p = self.p.add(up if up > down and up > 0 else 0.0)
        m = self.m.add(down if down > up and down > 0 else 0.0)
        if t is None:
            return None
        if t == 0:
            return {"plus_di": 0.0, "minus_di": 0.0, "adx": 0.0}
        p, m = 100 * p / t, 100 * m / t
        a = self.d.add(0.0 if p + m == 0 else 100 * abs(p - m) / (p + m))
        return None if a is None else {"plus_di": p, "minus_di": m, "adx": a}


class KeltnerStep(Stepper):
    def clear(self):
        self.e, self.a, self.was = Smooth(self.spec.ema_n), Wilder(self.spec.atr_n), None
        self.kept: deque = deque(maxlen=self.spec.least_bars)

    def step(self, bar):
        mid, width = self.e.add(bar["close"]), self.a.add(_range(bar, self.was))
        self.was = bar
        self.kept.append(bar)
        if self.bars < self.spec.least_bars:
            return None
        if self.spec.atr_mode == "windowed":
            again, was = Wilder(self.spec.atr_n), None
            for b in self.kept:
                width, was = again.add(_range(b, was)), b
        up, low = mid + self.spec.mult * width, mid - self.spec.mult * width
        return {"middle": mid, "upper": up, "lower": low, "bandwidth": _div(up - low, mid)}


class KeltnerPriceStep(Stepper):
    def clear(self):
        self.e = Smooth(self.spec.ema_n)

    def step(self, bar):
        y = self.e.add(bar[self.spec.price])
        return {"": y} if self.bars >= self.spec.least_bars else None


class HeikinAshiStep(Stepper):
    def clear(self):
        self.was = None

    def step(self, bar):
        o, h, l, c = (bar[x] for x in ("open", "high", "low", "close"))
        hc = (o + h + l + c) / 4
        ho = (o + c) / 2 if self.was is None else (self.was[0] + self.was[1]) / 2
        self.was = (ho, hc)
        return {"open": ho, "high": max(h, ho, hc), "low": min(l, ho, hc), "close": hc}


class SarStep(Stepper):
    def clear(self):
        self.prev = None

    def step(self, bar):
        h, l, c = bar["high"], bar["low"], bar["close"]
        s = self.spec
        if self.bars == 1:
            self.prev = (h, l)
            return None
        ph, pl = self.prev
        if self.bars == 2:
            self.long = c >= (ph + pl) / 2
            self.sar, self.ep = (pl, max(h, ph)) if self.long else (ph, min(l, pl))
            self.af = s.begin
            shown = self.sar
        else:
            shown = self.sar
            if (l < shown) if self.long else (h > shown):
                self.long = not self.long
                self.sar, self.af, self.ep = self.ep, s.begin, h if self.long else l
                self.prev = (h, l)
                return {"": self.sar}
        best = max(self.ep, h) if self.long else min(self.ep, l)
        if best != self.ep:
            self.ep, self.af = best, min(self.af + s.step, s.most)
        ahead = shown + self.af * (self.ep - shown)
        self.sar = min(ahead, pl, l) if self.long else max(ahead, ph, h)
        self.prev = (h, l)
        return {"": shown}


class ObvStep(Stepper):
    def clear(self):
        self.was, self.y = None, 0.0

    def step(self, bar):
        c = bar["close"]
        if self.was is not None and c != self.was:
            self.y += bar["volume"] if c > self.was else -bar["volume"]
        self.was = c
        return {"": self.y}


class AdlStep(Stepper):
    def clear(self):
        self.y = None

    def step(self, bar):
        f = _flow(self.spec, bar)
        if f is not None:
            self.y = f + (self.y or 0.0)
        return {"": self.y}


class VwapStep(Stepper):
    def clear(self):
        self.pv = self.v = 0.0

    def step(self, bar):
        self.pv += _tp(bar) * bar["volume"]
        self.v += bar["volume"]
        return {"": _tp(bar) if self.v == 0 else self.pv / self.v}


class SignalStep(Stepper):
    """Signals: None until two bars have all inputs, then an event."""

    def clear(self):
        self.inner = [x[0].start() for x in self.spec.sources if not isinstance(x, str)]
        self.legs = [x.start() for x in self.spec.legs]
        self.delayed: dict = {}
        self.was = None

    def _value(self, at: int, source, got):
        y = None if got is None else got[source[1]]
        if len(source) > 2 and source[2]:
            line = self.delayed.setdefault(at, [])
            line.append(y)
            return line.pop(0) if len(line) > source[2] else None
        return y

    def step(self, bar):
        s = self.spec
        if s.legs:
            return {"": self._combined([x.next(bar) for x in self.legs])}
        inner = iter([x.next(bar) for x in self.inner])
        now = [bar[x] if isinstance(x, str) else self._value(i, x, next(inner)) for i, x in enumerate(s.sources)]
        was, self.was = self.was, now
        if was is None or None in was or None in now:
            return {"": None}
        return {"": self._event(s, was, now)}

    @staticmethod
    def _event(s, was, now):
        if s.kind == "breakout":
            inside = was[2] <= was[0] <= was[1]
            return "LONG" if inside and now[0] > now[1] else "SHORT" if inside and now[0] < now[2] else "HOLD"
        level = s.level if len(now) == 1 else None
        (a, b), (x, y) = (was[0], level if level is not None else was[1]), (now[0], level if level is not None else now[1])
        if s.kind in ("cross_up", "threshold_above"):
            return "LONG" if a <= b and x > y else "HOLD"
        return "SHORT" if a >= b and x < y else "HOLD"

    def _combined(self, got):
        e = [None if g is None else g[""] for g in got]
        if self.spec.kind == "inverse":
            return {"LONG": "SHORT", "SHORT": "LONG"}.get(e[0], e[0])
        if self.spec.kind == "either":
            return next((x for x in ("LONG", "SHORT", "EXIT", "HOLD") if x in e), None)
        if e[0] == e[1] and e[0] in ("LONG", "SHORT"):
            return e[0]
        return "EXIT" if "EXIT" in e else None if None in e else "HOLD"


class DivergenceStep(Stepper):
    """Keeps 2 L + 1 pairs and the last swing of either kind; None until a swing can be known."""

    def clear(self):
        self.inner = [x[0].start() for x in (self.spec.price, self.spec.osc) if not isinstance(x, str)]
        self.kept: deque = deque(maxlen=2 * self.spec.rule.lookback + 1)
        self.seen, self.high, self.low = 0, None, None

    def step(self, bar):
        inner, pair, s = iter(self.inner), [], self.spec
        for source in (s.price, s.osc):
            if isinstance(source, str):
                pair.append(bar[source])
            else:
                got = next(inner).next(bar)
                pair.append(None if got is None else got[source[1]])
        if None in pair:
            return None
        self.kept.append(pair)
        self.seen += 1
        n = s.rule.lookback
        if self.seen <= 2 * n:
            return None
        x, o = self.kept[n]
        others = [p for i, (p, _) in enumerate(self.kept) if i != n]
        at, event = self.seen - 1 - n, "HOLD"
        if x > max(others):
            old, self.high = self.high, (x, o, at)
            if old and at - old[2] >= s.rule.least_distance and x > old[0] and o < old[1]:
                event = "SHORT"
        if x < min(others):
            old, self.low = self.low, (x, o, at)
            if old and at - old[2] >= s.rule.least_distance and x < old[0] and o > old[1]:
                event = "LONG"
        place = lambda swing: None if swing is None else float(swing[2])
        return {"": event, "high_bar": place(self.high), "low_bar": place(self.low)}


class PatternStep(Stepper):
    def clear(self):
        self.kept: deque = deque(maxlen=3)

    def step(self, bar):
        self.kept.append([bar[x] for x in ("open", "high", "low", "close")])
        x, p, q = (Candle(*b) for b in [*reversed(self.kept), *[self.kept[0]] * 2][:3])  # what is missing is not asked
        hit = rules(x, p, q, self.spec.config)
        known = {1: SINGLE, 2: SINGLE + DOUBLE}.get(len(self.kept), tuple(hit))
        return {"": ",".join(k for k, _ in SCAN if k in known and hit[k])}


class BacktestStep(Stepper):
    def clear(self):
        self.inner = [self.spec.signal.start()]
        self.cash, self.side, self.quantity, self.entry, self.entered = self.spec.config.cash, 0, 0.0, 0.0, None
        self.trades, self.realised = 0, 0.0

    def step(self, bar):
        s, got = self.spec, self.inner[0].next(bar)
        p = Portfolio(s.config)
        p.cash, p.side, p.quantity, p.entry, p.entered = self.cash, self.side, self.quantity, self.entry, self.entered
        event = None if got is None else got[""]
        p.apply(Action({"LONG": "ENTER_LONG", "SHORT": "ENTER_SHORT", "EXIT": "EXIT"}.get(event, "HOLD"), s.quantity), bar["close"], self.bars - 1)
        self.cash, self.side, self.quantity, self.entry, self.entered = p.cash, p.side, p.quantity, p.entry, p.entered
        self.trades += len(p.trades)
        self.realised += sum(t[6] for t in p.trades)
        return {"equity": p.equity(bar["close"]), "cash": p.cash, "position": p.side * p.quantity, "trade_count": float(self.trades), "realised": self.realised}


def stepper(spec) -> Stepper:
    n = getattr(spec, "n", 0)
    rolling = {
        T.Sma: (n, n - 1, _sma), T.Wma: (n, n - 1, lambda s, k: {"": _wma(_price(s, k))}), V.Std: (n, n - 1, lambda s, k: {"": _pstd(_price(s, k))}),
        V.Bollinger: (n, n - 1, _bollinger), V.Donchian: (n, n - 1, _donchian), M.WilliamsR: (n, n - 1, _williams), M.Cci: (n, n - 1, _cci),
        M.Roc: (n + 1, n, _roc), U.Vroc: (n + 1, n, _vroc), U.Cmf: (n, n - 1, _cmf), U.Mfi: (n + 1, n, _mfi), T.Pivots: (2, 1, _pivots),
    }
    kind = type(spec)
    if kind in rolling:
        return Rolling(spec, *rolling[kind])
    if kind is T.Hma:
        return Rolling(spec, spec.least_bars, spec.least_bars - 1, _hma)
    if kind is T.Ichimoku:
        if spec.displace:
            raise ValueError("a displaced line looks ahead and cannot be streamed")
        return Rolling(spec, spec.senkou_b, spec.senkou_b - 1, _ichimoku)
    if kind is M.Stochastic:
        return Rolling(spec, spec.least_bars, spec.least_bars - 1, _stochastic)
    single = {
        T.Ema: EmaStep, T.Dema: ChainStep, T.Tema: ChainStep, T.Macd: MacdStep, T.Adx: AdxStep, T.ParabolicSar: SarStep, T.HeikinAshi: HeikinAshiStep,
        M.Rsi: RsiStep, V.Atr: AtrStep, V.Keltner: KeltnerStep, V.KeltnerPrice: KeltnerPriceStep, U.Obv: ObvStep, U.Adl: AdlStep, U.Vwap: VwapStep, LiveSignal: SignalStep,
        LiveDivergence: DivergenceStep, LivePatterns: PatternStep, LiveBacktest: BacktestStep,
    }
    if kind in single:
        return single[kind](spec)
    raise TypeError(f"{kind.__name__} has no bar-by-bar form; give it a start() of its own")


def freeze(s: Stepper) -> dict:
    """The state as plain data, without classes of this package."""
    plain = lambda v: v.__dict__ if isinstance(v, (Smooth, Wilder)) else freeze(v) if isinstance(v, Stepper) else v
    return {k: [plain(x) for x in v] if isinstance(v, list) else plain(v) for k, v in s.__dict__.items() if k not in ("spec", "of")}


def thaw(s: Stepper, data: dict) -> Stepper:
    """Puts a frozen state into a fresh stepper."""
    for k, v in data.items():
        own = getattr(s, k, None)
        if isinstance(own, list):
            for x, d in zip(own, v):
                thaw(x, d) if isinstance(x, Stepper) else x.__dict__.update(d)
        elif isinstance(own, (Smooth, Wilder)):
            own.__dict__.update(v)
        else:
            setattr(s, k, v)
    return s


STEPPER[:] = [stepper]
