"""Position sizing as columns. Bad input sizes to 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(*xs: Column) -> Column:
    ok = F.lit(True)
    for x in xs:
        ok = ok & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return ok


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def kelly(win_rate: Column, avg_win: Column, avg_loss: Column) -> Column:
    """(b p - q) / b with b = win / loss, within 0 and 1."""
    ok = _finite(win_rate, avg_win, avg_loss) & win_rate.between(0, 1) & (avg_win > 0) & (avg_loss > 0)
    b = F.try_divide(avg_win, avg_loss)
    return F.when(ok, _clamp(F.try_divide(b * win_rate - (1 - win_rate), b))).otherwise(F.lit(0.0))


def fractional_kelly(win_rate: Column, avg_win: Column, avg_loss: Column, fraction: Column) -> Column:
    return F.when(_finite(fraction), kelly(win_rate, avg_win, avg_loss) * _clamp(fraction)).otherwise(F.lit(0.0))


def fixed_fractional(fraction: Column) -> Column:
    return F.when(_finite(fraction) & (fraction > 0), _clamp(fraction)).otherwise(F.lit(0.0))


def risk_based(equity: Column, risk: Column, entry: Column, stop: Column) -> Column:
    """Units that lose ``risk`` of the equity if the stop is hit."""
    d = F.abs(entry - stop)
    return F.when(_finite(equity, risk, entry, stop) & (equity > 0) & (risk > 0) & (entry > 0) & (stop > 0) & (d > 0), F.try_divide(equity * _clamp(risk), d)).otherwise(F.lit(0.0))


def volatility_targeted(equity: Column, target: Column, volatility: Column) -> Column:
    return F.when(_finite(equity, target, volatility) & (equity > 0) & (target > 0) & (volatility > 0), F.try_divide(equity * target, volatility)).otherwise(F.lit(0.0))
