"""Trading signals: LONG, SHORT, EXIT, HOLD, or null while there is not enough data.

Inputs are column names; warm-up nulls are a prefix, so the first pair of values counts as the
first bar. Comparisons with NaN are false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.indicator import Indicator
from quantloom.numeric import ge, gt, le, lt
from quantloom.schema import Bars

LONG, SHORT, EXIT, HOLD = "LONG", "SHORT", "EXIT", "HOLD"


def _before(x: str, c: Bars) -> Column:
    return F.lag(F.col(x)).over(c.window())


def _fire(ready: Column, hits: list[tuple[Column, str]]) -> Column:
    out = F.when(~ready, F.lit(None).cast("string"))
    for test, event in hits:
        out = out.when(test, F.lit(event))
    return out.otherwise(F.lit(HOLD))


def _known(*cols: Column) -> Column:
    out = cols[0].isNotNull()
    for x in cols[1:]:
        out = out & x.isNotNull()
    return out


def cross_up(a: str, b: str, c: Bars = Bars()) -> Column:
    pa, pb = _before(a, c), _before(b, c)
    return _fire(_known(pa, pb, F.col(a), F.col(b)), [(le(pa, pb) & gt(F.col(a), F.col(b)), LONG)])


def cross_down(a: str, b: str, c: Bars = Bars()) -> Column:
    pa, pb = _before(a, c), _before(b, c)
    return _fire(_known(pa, pb, F.col(a), F.col(b)), [(ge(pa, pb) & lt(F.col(a), F.col(b)), SHORT)])


def threshold_above(x: str, level: float, c: Bars = Bars()) -> Column:
    p, at = _before(x, c), F.lit(float(level))
    return _fire(_known(p, F.col(x)), [(le(p, at) & gt(F.col(x), at), LONG)])


def threshold_below(x: str, level: float, c: Bars = Bars()) -> Column:
    p, at = _before(x, c), F.lit(float(level))
    return _fire(_known(p, F.col(x)), [(ge(p, at) & lt(F.col(x), at), SHORT)])


def breakout(v: str, upper: str, lower: str, c: Bars = Bars()) -> Column:
    """Fires when the value leaves a band inside which the previous value was; it must come back first."""
    x, up, low = F.col(v), F.col(upper), F.col(lower)
    pv, pu, pl = _before(v, c), _before(upper, c), _before(lower, c)
    inside = ge(pv, pl) & le(pv, pu)
    return _fire(_known(pv, pu, pl, x, up, low), [(inside & gt(x, up), LONG), (inside & lt(x, low), SHORT)])


def both(a: Column, b: Column) -> Column:
    """LONG or SHORT if both say so; EXIT if either does; null if a leg is null otherwise."""
    return (
        F.when((a == LONG) & (b == LONG), F.lit(LONG)).when((a == SHORT) & (b == SHORT), F.lit(SHORT))
        .when(a.eqNullSafe(EXIT) | b.eqNullSafe(EXIT), F.lit(EXIT)).when(a.isNotNull() & b.isNotNull(), F.lit(HOLD))
    )


def either(a: Column, b: Column) -> Column:
    """The event of highest priority of the two legs: LONG, SHORT, EXIT, HOLD; null if both are null."""
    out = None
    for event in (LONG, SHORT, EXIT, HOLD):
        test = a.eqNullSafe(event) | b.eqNullSafe(event)
        out = F.when(test, F.lit(event)) if out is None else out.when(test, F.lit(event))
    return out


def inverse(a: Column) -> Column:
    return F.when(a == LONG, F.lit(SHORT)).when(a == SHORT, F.lit(LONG)).otherwise(a)


@dataclass(frozen=True)
class Divergence:
    """Price makes a higher high while the oscillator makes a lower one (SHORT), or the mirror (LONG).

    A swing is a bar strictly beyond the ``lookback`` bars on either side, known ``lookback`` bars
    later. It is compared with the swing before, and replaces it whatever the outcome.
    """

    lookback: int
    min_distance: int | None = None

    def __post_init__(self):
        if self.lookback < 1:
            raise ValueError("lookback must be at least 1")

    @property
    def least_distance(self) -> int:
        return self.lookback + 1 if self.min_distance is None else self.min_distance

    def apply(self, df: DataFrame, price: str, osc: str, alias: str = "divergence", *, swings: bool = False, c: Bars = Bars()) -> DataFrame:
        """Adds the event; with ``swings`` also ``alias_high_bar`` and ``alias_low_bar``, the numbers (from
        0) of the last swing bars known at each bar."""
        n, w, least = self.lookback, c.window(), self.least_distance
        keep = [x for x in df.columns if x not in (alias, *([f"{alias}_high_bar", f"{alias}_low_bar"] if swings else []))]
        df = df.withColumns({"_c": F.lag(price, n).over(w), "_o": F.lag(osc, n).over(w), "_rn": F.row_number().over(w)})
        old, new = w.rowsBetween(-2 * n, -n - 1), w.rowsBetween(-n + 1, 0)
        x, full = F.col("_c"), F.col("_rn") > 2 * n
        df = df.withColumns({
            "_hi": full & (x > F.max(price).over(old)) & (x > F.max(price).over(new)),
            "_lo": full & (x < F.min(price).over(old)) & (x < F.min(price).over(new)),
        })
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        here = F.struct(F.col("_c").alias("p"), F.col("_o").alias("o"), F.col("_rn").alias("at"))
        df = df.withColumns({"_ph": F.last(F.when(F.col("_hi"), here), ignorenulls=True).over(past), "_pl": F.last(F.when(F.col("_lo"), here), ignorenulls=True).over(past)})
        h, l = F.col("_ph"), F.col("_pl")
        far = lambda p: F.col("_rn") - p["at"] >= least
        short = F.coalesce(F.col("_hi") & far(h) & (x > h["p"]) & (F.col("_o") < h["o"]), F.lit(False))
        long = F.coalesce(F.col("_lo") & far(l) & (x < l["p"]) & (F.col("_o") > l["o"]), F.lit(False))
        df = df.withColumn("_event", F.when(full, F.when(short, F.lit(SHORT)).when(long, F.lit(LONG)).otherwise(F.lit(HOLD))))
        bar = lambda now, before: F.when(F.col(now), F.col("_rn")).otherwise(F.col(before)["at"]) - n - 1
        more = [bar("_hi", "_ph").cast("long").alias(f"{alias}_high_bar"), bar("_lo", "_pl").cast("long").alias(f"{alias}_low_bar")] if swings else []
        return df.select(*keep, F.col("_event").alias(alias), *more)


@dataclass(frozen=True)
class LiveDivergence(Indicator):
    """``Divergence`` for streams. ``price`` and ``osc`` are bar fields or (indicator, output suffix);
    bars before both have values do not count, as in a batch that starts there. Outputs are the event
    and the numbers of the last swing bars."""

    rule: Divergence
    price: object = "close"
    osc: object = None
    outputs = ("", "high_bar", "low_bar")
    types = ("string", "double", "double")


@dataclass(frozen=True)
class LiveSignal(Indicator):
    """A signal for streams, where a window cannot look back: its state holds the bar before.

    ``kind`` is cross_up, cross_down, threshold_above, threshold_below, breakout, both, either or
    inverse. ``sources`` are bar fields ("close") or (indicator, output suffix[, bars of delay]);
    the three combinators take signals in ``legs`` instead.
    """

    kind: str
    sources: tuple = ()
    level: float = 0.0
    legs: tuple = ()
    types = ("string",)

    def __post_init__(self):
        need = {"cross_up": (2, 0), "cross_down": (2, 0), "threshold_above": (1, 0), "threshold_below": (1, 0), "breakout": (3, 0), "both": (0, 2), "either": (0, 2), "inverse": (0, 1)}
        if need.get(self.kind) != (len(self.sources), len(self.legs)):
            raise ValueError(f"{self.kind} does not take {len(self.sources)} sources and {len(self.legs)} legs")
