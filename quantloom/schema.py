"""The bar schema and the one window specification that every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Bars:
    """Names of the bar columns; bars of a symbol are ordered by (ts, seq). With ``session``, a further
    column, everything starts afresh in every session of a symbol."""

    symbol: str = "symbol"
    ts: str = "ts"
    seq: str = "seq"
    open: str = "open"
    high: str = "high"
    low: str = "low"
    close: str = "close"
    volume: str = "volume"
    session: str | None = None

    def __post_init__(self):
        if len(set(self.names)) != len(self.names):
            raise ValueError("column names must differ")

    @property
    def names(self) -> tuple[str, ...]:
        return (self.symbol, self.ts, self.seq, self.open, self.high, self.low, self.close, self.volume)

    def check(self, df: DataFrame) -> None:
        missing = [c for c in (*self.names, *self.session_key) if c not in df.columns]
        if missing:
            raise ValueError(f"bar columns are missing: {', '.join(missing)}")

    @property
    def session_key(self) -> tuple[str, ...]:
        return (self.session,) if self.session else ()

    def window(self) -> WindowSpec:
        """All operators use this partitioning and order, so Spark plans one exchange and one sort."""
        return Window.partitionBy(self.symbol, *self.session_key).orderBy(self.ts, self.seq)

    def last(self, n: int) -> WindowSpec:
        return self.window().rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def col(self, name: str) -> Column:
        return F.col(getattr(self, name))

    def typical(self) -> Column:
        return (self.col("high") + self.col("low") + self.col("close")) / 3


BARS = Bars()
