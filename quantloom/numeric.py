"""Arithmetic and comparisons with one meaning for zero divisors and NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN for a zero divisor."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def gt(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a > b)


def ge(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a >= b)


def lt(a: Column, b: Column) -> Column:
    return gt(b, a)


def le(a: Column, b: Column) -> Column:
    return ge(b, a)


def warm(first: int, value: Column, w: WindowSpec) -> Column:
    """The value from bar ``first`` (0-based) on, null before."""
    return F.when(F.row_number().over(w) > first, value)


def check_period(n: int, least: int = 1, what: str = "period") -> int:
    if not isinstance(n, int) or n < least:
        raise ValueError(f"{what} must be an integer of at least {least}")
    return n
