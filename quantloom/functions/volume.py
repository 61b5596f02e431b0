"""Volume indicators. ``on_invalid`` says what a bar without range or volume means: 'default'
(0 for accumulated flows, null for ratios), 'null' or 'raise'."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.indicator import ColumnIndicator
from quantloom.numeric import check_period, warm
from quantloom.schema import Bars

POLICIES = ("default", "null", "raise")


def _invalid(policy: str, default: Column, message: str) -> Column:
    if policy == "raise":
        return F.raise_error(F.lit(message)).cast("double")
    return F.lit(None).cast("double") if policy == "null" else default


def _check(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"on_invalid is one of {POLICIES}")


def money_flow_multiplier(c: Bars, policy: str = "default") -> Column:
    h, l, x = c.col("high"), c.col("low"), c.col("close")
    return F.when(h == l, _invalid(policy, F.lit(0.0), "a bar has no range")).otherwise(F.try_divide(2 * x - h - l, h - l))


@dataclass(frozen=True)
class Obv(ColumnIndicator):
    """Starts at 0."""

    def stages(self, c):
        yield {"_flow": F.coalesce(F.signum(c.col("close") - F.lag(c.col("close")).over(c.window())), F.lit(0.0)) * c.col("volume")}
        yield {"": F.sum("_flow").over(c.so_far())}


@dataclass(frozen=True)
class Vroc(ColumnIndicator):
    n: int = 14
    on_invalid: str = "default"

    def __post_init__(self):
        check_period(self.n)
        _check(self.on_invalid)

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return self.n + 1

    def stages(self, c):
        yield {"_old": F.lag(c.col("volume"), self.n).over(c.window())}
        old = F.col("_old")
        yield {"": F.when(old == 0, _invalid(self.on_invalid, F.lit(None).cast("double"), "past volume is 0")).otherwise(F.try_divide(c.col("volume") - old, old) * 100)}


@dataclass(frozen=True)
class Adl(ColumnIndicator):
    on_invalid: str = "default"

    def __post_init__(self):
        _check(self.on_invalid)

    def stages(self, c):
        yield {"_mfv": money_flow_multiplier(c, self.on_invalid) * c.col("volume")}
        yield {"": F.sum("_mfv").over(c.so_far())}


@dataclass(frozen=True)
class Cmf(ColumnIndicator):
    n: int = 20
    on_invalid: str = "default"

    def __post_init__(self):
        check_period(self.n)
        _check(self.on_invalid)

    @property
    def period(self):
        return None

    @property
    def least_bars(self):
        return self.n

    def stages(self, c):
        yield {"_mfv": money_flow_multiplier(c, self.on_invalid) * c.col("volume")}
        flow, volume = F.sum("_mfv").over(c.last(self.n)), F.sum(c.col("volume")).over(c.last(self.n))
        yield {"": warm(self.n - 1, F.when(volume == 0, _invalid(self.on_invalid, F.lit(None).cast("double"), "volume is 0")).otherwise(F.try_divide(flow, volume)), c.window())}


@dataclass(frozen=True)
class Mfi(ColumnIndicator):
    n: int = 14

    def __post_init__(self):
        check_period(self.n)

    @property
    def least_bars(self):
        return self.n + 1

    def stages(self, c):
        yield {"_tp": c.typical()}
        yield {"_was": F.lag("_tp").over(c.window())}
        flow = F.col("_tp") * c.col("volume")
        up = F.sum(F.when(F.col("_tp") > F.col("_was"), flow).otherwise(0.0)).over(c.last(self.n))
        down = F.sum(F.when(F.col("_tp") < F.col("_was"), flow).otherwise(0.0)).over(c.last(self.n))
        yield {"_up": up, "_down": down}
        p, q = F.col("_up"), F.col("_down")
        yield {"": warm(self.n, F.when(q == 0, F.when(p == 0, F.lit(50.0)).otherwise(F.lit(100.0))).otherwise(100 - 100 / (1 + F.try_divide(p, q))), c.window())}


@dataclass(frozen=True)
class Vwap(ColumnIndicator):
    """Cumulative from the symbol's first bar, or the session's with ``Bars(session=...)``."""

    def stages(self, c):
        yield {"_pv": F.sum(c.typical() * c.col("volume")).over(c.so_far()), "_v": F.sum(c.col("volume")).over(c.so_far())}
        yield {"": F.when(F.col("_v") == 0, c.typical()).otherwise(F.try_divide(F.col("_pv"), F.col("_v")))}
