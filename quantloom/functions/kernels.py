"""Rolling kernels over arrays, at a cost per bar that does not grow with the period.

A series is cut into tiles as long as the window. Every window is the end of one tile and the beginning of
the next, so two running results per tile (from its left and from its right) give all windows; sums never
run further than a tile, which keeps their error that of one window. Sums of up to ``NARROW`` bars are added
in the order of the bars, whole stretches of ``STRETCH`` as one number. ``arrays`` is the batch form of every
column indicator over the bars of one symbol: the values of each output and where they are not null.
Missing prices are NaN here; windows leave them out, as the column form does with nulls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quantloom.functions import momentum as M
from quantloom.functions import trend as T
from quantloom.functions import volatility as V
from quantloom.functions import volume as U
from quantloom.functions.indicator import ColumnIndicator

Bars = dict[str, np.ndarray]
Values = tuple[np.ndarray, np.ndarray]  # numbers, whether they are not null

#: Up to this period the mean deviation and sums look at every value of a window.
NARROW = 48
#: Bars that a narrow sum takes as one number where it holds them all, counted from the first bar of a symbol.
#: Averages that are equal by their decimals differ in the last bit by the order of addition, and crossings with
#: them; this is the order that the queries' SQL has, and it does not depend on where a series is cut.
STRETCH = 16


def _tiled(x: np.ndarray, n: int, fill: float = 0.0) -> np.ndarray:
    tiles = -(-len(x) // n)
    return np.append(x, np.full(tiles * n - len(x), fill)).reshape(tiles, n)


def _from_left(t: np.ndarray, op) -> np.ndarray:
    return op.accumulate(t, axis=1).ravel()


def _from_right(t: np.ndarray, op) -> np.ndarray:
    return op.accumulate(t[:, ::-1], axis=1)[:, ::-1].ravel()


def rolling_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the last n values, of fewer at the beginning."""
    if n == 1 or not len(x):
        return np.array(x, np.float64)
    if n <= NARROW:
        return _narrow_sum(x, n)
    t = _tiled(x, n)
    left, right = _from_left(t, np.add), _from_right(t, np.add)
    out = left[: len(x)].copy()
    at = np.arange(n, len(x))
    at = at[(at + 1) % n != 0]
    out[at] += right[at - n + 1]
    return out


def _narrow_sum(x: np.ndarray, n: int) -> np.ndarray:
    out = np.cumsum(x, dtype=np.float64)
    whole = _from_left(_tiled(x, STRETCH), np.add)[STRETCH - 1 :: STRETCH]
    for s in range(min(STRETCH, len(x) - n + 1)):  # windows that begin at s, s + STRETCH, ...
        total = np.zeros(len(range(s, len(x) - n + 1, STRETCH)))
        k, stop = s, s + n  # the place in the first of these windows
        while k < stop:
            if k % STRETCH == 0 and k + STRETCH <= stop:
                total += whole[k // STRETCH :][: len(total)]
                k += STRETCH
            else:
                total += x[k::STRETCH][: len(total)]
                k += 1
        out[s + n - 1 :: STRETCH] = total
    return out


def rolling_extreme(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` (np.maximum or np.minimum) over the last n values, over fewer at the beginning."""
    if n == 1 or not len(x):
        return np.array(x, np.float64)
    t = _tiled(x, n, -np.inf if op is np.maximum else np.inf)
    out = _from_left(t, op)[: len(x)].copy()
    if len(x) > n:
        out[n:] = op(out[n:], _from_right(t, op)[1 : len(x) - n + 1])
    return out


def rolling_moments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population deviation) of the last n values. Both parts of a window are centred at the mean of
    their tile and joined by their means, so a large level does not drown a small deviation."""
    size = len(x)
    if not size:
        return np.zeros(0), np.zeros(0)
    t = _tiled(x, n, x[-1])
    centre = t.mean(1, keepdims=True)
    d = t - centre
    at = np.arange(size)
    k = at % n + 1  # values of the window in its last tile
    c = np.repeat(centre.ravel(), n)
    s1, q1 = _from_left(d, np.add)[:size], _from_left(d * d, np.add)[:size]
    mean, spread = c[:size] + s1 / k, q1 - s1 * s1 / k
    both = at[(at >= n) & (k < n)]
    s2, q2 = _from_right(d, np.add)[both - n + 1], _from_right(d * d, np.add)[both - n + 1]
    k1, k2 = k[both], n - k[both]
    mean2 = c[both - n + 1] + s2 / k2
    apart = mean2 - mean[both]
    spread[both] += q2 - s2 * s2 / k2 + apart * apart * k1 * k2 / n
    mean[both] += apart * k2 / n
    spread[rolling_extreme(x, n, np.maximum) == rolling_extreme(x, n, np.minimum)] = 0.0
    return mean, np.sqrt(np.maximum(spread, 0.0) / np.minimum(at + 1, n).clip(max=n))


def rolling_wma(x: np.ndarray, n: int) -> np.ndarray:
    """Means weighted 1 to n, the newest n; NaN before bar n - 1."""
    size = len(x)
    out = np.full(size, np.nan)
    if size < n:
        return out
    t = _tiled(x, n)
    p = np.arange(n)
    at = np.arange(n - 1, size)
    k = at % n
    total = _from_left(t * p, np.add)[at] + (n - k) * _from_left(t, np.add)[at]
    tail = np.minimum(at - n + 1, t.size - 1)
    total += np.where(k < n - 1, _from_right(t * p, np.add)[tail] - k * _from_right(t, np.add)[tail], 0.0)
    out[at] = total / (n * (n + 1) / 2)
    return out


def _above(x: np.ndarray, low: np.ndarray, high: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many, sum) of the x[low:high] that are greater than ``bar``, by a tree over the ranks of x:
    each level splits the values in two halves by rank and keeps running counts and sums of the upper one."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    least = np.searchsorted(x[order], bar, "right")  # the first rank above the bar
    bits = max(1, int(len(x)).bit_length())
    count, total = np.zeros(len(low), np.int64), np.zeros(len(low))
    values = x
    for b in range(bits - 1, -1, -1):
        one = (rank >> b & 1).astype(bool)
        ones, sums = np.append(0, np.cumsum(one)), np.append(0.0, np.cumsum(np.where(one, values, 0.0)))
        up = (least >> b & 1).astype(bool)
        count += np.where(up, 0, ones[high] - ones[low])
        total += np.where(up, 0.0, sums[high] - sums[low])
        zeros = len(x) - ones[-1]
        low, high = np.where(up, zeros + ones[low], low - ones[low]), np.where(up, zeros + ones[high], high - ones[high])
        rank, values = np.concatenate([rank[~one], rank[one]]), np.concatenate([values[~one], values[one]])
    sums = np.append(0.0, np.cumsum(values))
    return count + high - low, total + sums[high] - sums[low]


def _gaps(x: np.ndarray) -> bool:
    return bool(np.isnan(x).any())


def window_sum(x: np.ndarray, n: int) -> np.ndarray:
    """As ``rolling_sum`` over the values that are there; NaN where none is."""
    if not _gaps(x):
        return rolling_sum(x, n)
    there = ~np.isnan(x)
    return np.where(rolling_sum(there.astype(np.float64), n) > 0, rolling_sum(np.where(there, x, 0.0), n), np.nan)


def window_mean(x: np.ndarray, n: int) -> np.ndarray:
    if not _gaps(x):
        return rolling_sum(x, n) / np.minimum(np.arange(len(x)) + 1, n)
    many = rolling_sum((~np.isnan(x)).astype(np.float64), n)
    return window_sum(x, n) / np.where(many > 0, many, np.nan)


def window_extreme(x: np.ndarray, n: int, op) -> np.ndarray:
    if not _gaps(x):
        return rolling_extreme(x, n, op)
    none = -np.inf if op is np.maximum else np.inf
    out = rolling_extreme(np.where(np.isnan(x), none, x), n, op)
    return np.where(rolling_sum((~np.isnan(x)).astype(np.float64), n) > 0, out, np.nan)


def window_moments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``rolling_moments`` over the values that are there; a series with gaps is centred once."""
    if not _gaps(x):
        return rolling_moments(x, n)
    mean = window_mean(x, n)
    d = x - np.nanmean(x) if not np.isnan(x).all() else x
    return mean, np.sqrt(np.maximum(window_mean(d * d, n) - window_mean(d, n) ** 2, 0.0))


def mean_deviation(x: np.ndarray, mean: np.ndarray, n: int) -> np.ndarray:
    """Mean distance of the last n values from ``mean``; exactly 0 where they are equal; NaN before bar n - 1.
    Wide windows take logarithmic time a bar: the distances above and below a mean are equal in sum."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    if n <= NARROW or _gaps(x):
        view = np.lib.stride_tricks.sliding_window_view(x, n)
        for s in range(0, len(view), 65536):
            out[n - 1 + s : n - 1 + s + 65536] = np.nansum(np.abs(view[s : s + 65536] - mean[n - 1 + s : n - 1 + s + 65536, None]), 1) / n
    else:
        step = max(7 * n, 4096)
        for s in range(n - 1, len(x), step):
            e = min(s + step, len(x))
            part = x[s - n + 1 : e]
            centre = part.mean()
            m = mean[s:e] - centre
            many, total = _above(part - centre, np.arange(e - s), np.arange(n, e - s + n), m)
            out[s:e] = np.maximum(2 * (total - m * many) / n, 0.0)
    flat = window_extreme(x, n, np.maximum) == window_extreme(x, n, np.minimum)
    out[n - 1 :] = np.where(flat[n - 1 :], 0.0, out[n - 1 :])
    return out


def lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.append(np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)])


def _from(first: int, x: np.ndarray, ok: np.ndarray | None = None) -> Values:
    good = np.arange(len(x)) >= first
    return x, good if ok is None else good & ok


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / b


def typical(b: Bars) -> np.ndarray:
    return (b["high"] + b["low"] + b["close"]) / 3


def money_flow(b: Bars, policy: str) -> Values:
    """Money flow volume; of a bar without range as the policy says."""
    flat = b["high"] == b["low"]
    if policy == "raise" and flat.any():
        raise ValueError("a bar has no range")
    flow = np.where(flat, 0.0, _ratio(2 * b["close"] - b["high"] - b["low"], np.where(flat, 1.0, b["high"] - b["low"]))) * b["volume"]
    return flow, ~flat if policy == "null" else np.ones(len(flat), bool)


def _sma(i: T.Sma, b: Bars) -> dict[str, Values]:
    return {"": _from(i.n - 1, window_mean(b[i.price], i.n))}


def _wma(i: T.Wma, b: Bars) -> dict[str, Values]:
    return {"": _from(i.n - 1, rolling_wma(b[i.price], i.n))}


def _hma(i: T.Hma, b: Bars) -> dict[str, Values]:
    raw = 2 * rolling_wma(b[i.price], i.n // 2) - rolling_wma(b[i.price], i.n)
    out = np.full(len(raw), np.nan)
    out[i.n - 1 :] = rolling_wma(raw[i.n - 1 :], i.smooth)
    return {"": _from(i.n + i.smooth - 2, out)}


def _std(i: V.Std, b: Bars) -> dict[str, Values]:
    return {"": _from(i.n - 1, window_moments(b[i.price], i.n)[1])}


def _bollinger(i: V.Bollinger, b: Bars) -> dict[str, Values]:
    m, d = window_moments(b[i.price], i.n)
    up, low = m + i.k * d, m - i.k * d
    return {k: _from(i.n - 1, x) for k, x in (("middle", m), ("upper", up), ("lower", low), ("bandwidth", _ratio(up - low, m)))}


def _ends(b: Bars, n: int) -> tuple[np.ndarray, np.ndarray]:
    return window_extreme(b["high"], n, np.maximum), window_extreme(b["low"], n, np.minimum)


def _donchian(i: V.Donchian, b: Bars) -> dict[str, Values]:
    up, low = _ends(b, i.n)
    return {k: _from(i.n - 1, x) for k, x in (("upper", up), ("middle", (up + low) / 2), ("lower", low))}


def _ichimoku(i: T.Ichimoku, b: Bars) -> dict[str, Values]:
    t, k, s = (sum(_ends(b, n)) / 2 for n in (i.tenkan, i.kijun, i.senkou_b))
    lines = {"tenkan": t, "kijun": k, "senkou_a": (t + k) / 2, "senkou_b": s, "chikou": b["close"]}
    return {x: _from(i.senkou_b - 1, v) for x, v in lines.items()}


def _williams(i: M.WilliamsR, b: Bars) -> dict[str, Values]:
    up, low = _ends(b, i.n)
    return {"": _from(i.n - 1, np.where(up == low, -50.0, _ratio(-100 * (up - b["close"]), up - low)))}


def _stochastic(i: M.Stochastic, b: Bars) -> dict[str, Values]:
    up, low = _ends(b, i.k)
    k = np.where(up == low, 50.0, _ratio(100 * (b["close"] - low), up - low))
    d = np.full(len(k), np.nan)
    d[i.k - 1 :] = window_mean(k[i.k - 1 :], i.d)
    return {"k": _from(i.k + i.d - 2, k), "d": _from(i.k + i.d - 2, d)}


def _cci(i: M.Cci, b: Bars) -> dict[str, Values]:
    tp = typical(b)
    mean = window_mean(tp, i.n)
    mad = mean_deviation(tp, mean, i.n)
    return {"": _from(i.n - 1, np.where(mad == 0, 0.0, _ratio(tp - mean, 0.015 * mad)))}


def _roc(i: M.Roc, b: Bars) -> dict[str, Values]:
    old = lag(b[i.price], i.n)
    return {"": _from(i.n, 100 * _ratio(b[i.price] - old, old))}


def _vroc(i: U.Vroc, b: Bars) -> dict[str, Values]:
    old = lag(b["volume"], i.n)
    none = old == 0
    if i.on_invalid == "raise" and none.any():
        raise ValueError("past volume is 0")
    return {"": _from(i.n, _ratio(b["volume"] - old, old) * 100, ~none)}


def _cmf(i: U.Cmf, b: Bars) -> dict[str, Values]:
    flow, ok = money_flow(b, i.on_invalid)
    volume = window_sum(b["volume"], i.n)
    none = volume == 0
    if i.on_invalid == "raise" and none[i.n - 1 :].any():
        raise ValueError("volume is 0")
    some = rolling_sum((ok & ~np.isnan(flow)).astype(np.float64), i.n) > 0
    return {"": _from(i.n - 1, _ratio(rolling_sum(np.where(ok & ~np.isnan(flow), flow, 0.0), i.n), volume), ~none & some)}


def _mfi(i: U.Mfi, b: Bars) -> dict[str, Values]:
    tp = typical(b)
    was, flow = lag(tp), tp * b["volume"]
    up, down = rolling_sum(np.where(tp > was, flow, 0.0), i.n), rolling_sum(np.where(tp < was, flow, 0.0), i.n)
    return {"": _from(i.n, np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + _ratio(up, np.where(down == 0, 1.0, down)))))}


def _pivots(i: T.Pivots, b: Bars) -> dict[str, Values]:
    h, l, c = (lag(b[x]) for x in ("high", "low", "close"))
    pp, span, none = (h + l + c) / 3, h - l, np.full(len(h), np.nan)
    if i.kind == "classic":
        r, s = [2 * pp - l, pp + span, h + 2 * (pp - l), none], [2 * pp - h, pp - span, l - 2 * (h - pp), none]
    elif i.kind == "fibonacci":
        r, s = [pp + span * f for f in (0.382, 0.618, 1.0)] + [none], [pp - span * f for f in (0.382, 0.618, 1.0)] + [none]
    else:
        r, s = [c + span * 1.1 / d for d in (12, 6, 4, 2)], [c - span * 1.1 / d for d in (12, 6, 4, 2)]
    lines = {"pp": pp} | {f"r{j + 1}": x for j, x in enumerate(r)} | {f"s{j + 1}": x for j, x in enumerate(s)}
    return {k: _from(1, v) for k, v in lines.items()}


def _tr(b: Bars) -> np.ndarray:
    return V.true_range(b["high"], b["low"], b["close"])


#: Indicators of finite lookback: their form over arrays and the bars before that it needs.
KERNELS: dict[type, tuple[Callable[..., dict[str, Values]], Callable[[ColumnIndicator], int]]] = {
    T.Sma: (_sma, lambda i: i.n - 1), T.Wma: (_wma, lambda i: i.n - 1), T.Hma: (_hma, lambda i: i.n + i.smooth - 2), V.Std: (_std, lambda i: i.n - 1),
    V.Bollinger: (_bollinger, lambda i: i.n - 1), V.Donchian: (_donchian, lambda i: i.n - 1), T.Ichimoku: (_ichimoku, lambda i: i.senkou_b - 1),
    M.WilliamsR: (_williams, lambda i: i.n - 1), M.Stochastic: (_stochastic, lambda i: i.k + i.d - 2), M.Cci: (_cci, lambda i: i.n - 1), M.Roc: (_roc, lambda i: i.n),
    U.Vroc: (_vroc, lambda i: i.n), U.Cmf: (_cmf, lambda i: i.n - 1), U.Mfi: (_mfi, lambda i: i.n), T.Pivots: (_pivots, lambda i: 1),
}

#: Columns a kernel reads, besides ``price``.
_READS = {
    V.Donchian: ("high", "low"), T.Ichimoku: ("high", "low", "close"), M.WilliamsR: ("high", "low", "close"), M.Stochastic: ("high", "low", "close"), M.Cci: ("high", "low", "close"),
    U.Vroc: ("volume",), U.Cmf: ("high", "low", "close", "volume"), U.Mfi: ("high", "low", "close", "volume"), T.Pivots: ("high", "low", "close"),
}


def reads(i: ColumnIndicator) -> tuple[str, ...]:
    return _READS.get(type(i), ()) or (i.price,)


def has_kernel(i) -> bool:
    return type(i) in KERNELS and not getattr(i, "displace", False)


def lookback(i: ColumnIndicator) -> int:
    return KERNELS[type(i)][1](i)


def grid(i: ColumnIndicator) -> int:
    """Sums over a series cut at a multiple of so many bars are those over the whole series to the last bit; 1 if that is not
    promised (deviations are centred at tiles, which end with the series)."""
    if isinstance(i, (T.Sma, M.Stochastic, U.Cmf, U.Mfi)):
        n = i.d if isinstance(i, M.Stochastic) else i.n
        return STRETCH if n <= NARROW else n
    return i.n if isinstance(i, T.Wma) else 1


def arrays(i: ColumnIndicator, bars: Bars) -> dict[str, Values]:
    return KERNELS[type(i)][0](i, bars)
