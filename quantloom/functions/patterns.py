"""Candlestick patterns over the last one to three bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.indicator import Indicator
from quantloom.schema import Bars

BULLISH, BEARISH, NEUTRAL = "Bullish", "Bearish", "Neutral"


@dataclass(frozen=True)
class PatternConfig:
    doji_body: float = 0.1
    marubozu_body: float = 0.95
    hammer_wick: float = 2.0
    hammer_upper: float = 0.5
    star_middle: float = 0.3


class Candle:
    """Geometry of one bar, of columns or of numbers."""

    def __init__(self, o, h, l, c, size=abs, high=max, low=min):
        self.o, self.h, self.l, self.c = o, h, l, c
        self.body = size(c - o)
        self.span = h - l
        self.upper = h - high(o, c)
        self.lower = low(o, c) - l
        self.bull = c >= o
        self.bear = c < o


def _lagged(c: Bars, back: int) -> Candle:
    get = lambda name: F.lag(c.col(name), back).over(c.window()) if back else c.col(name)
    return Candle(*(get(x) for x in ("open", "high", "low", "close")), F.abs, F.greatest, F.least)


def tests(c: Bars = Bars(), cfg: PatternConfig = PatternConfig()) -> dict[str, Column]:
    """A boolean column per pattern; false where earlier bars are missing."""
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules(*(_lagged(c, i) for i in range(3)), cfg).items()}


def rules(x: Candle, p: Candle, q: Candle, cfg: PatternConfig) -> dict:
    """What each pattern asks of a bar, the one before and the one before that."""
    hammer = (x.body > 0) & (x.lower >= cfg.hammer_wick * x.body) & (x.upper <= cfg.hammer_upper * x.body)
    inverted = (x.body > 0) & (x.upper >= cfg.hammer_wick * x.body) & (x.lower <= cfg.hammer_upper * x.body)
    full = (x.span > 0) & (x.body >= cfg.marubozu_body * x.span)
    star = (p.span > 0) & (p.body <= cfg.star_middle * p.span)
    middle = (q.o + q.c) / 2
    return {
        "doji": (x.span > 0) & (x.body <= cfg.doji_body * x.span),
        "hammer": hammer,
        "hanging_man": hammer,
        "inverted_hammer": inverted,
        "shooting_star": inverted,
        "bullish_marubozu": x.bull & full,
        "bearish_marubozu": x.bear & full,
        "bullish_engulfing": p.bear & x.bull & (x.o <= p.c) & (x.c >= p.o),
        "bearish_engulfing": p.bull & x.bear & (x.o >= p.c) & (x.c <= p.o),
        "bullish_harami": p.bear & x.bull & (x.o >= p.c) & (x.c <= p.o) & (x.body < p.body),
        "bearish_harami": p.bull & x.bear & (x.c >= p.o) & (x.o <= p.c) & (x.body < p.body),
        "morning_star": q.bear & x.bull & star & (x.c > middle),
        "evening_star": q.bull & x.bear & star & (x.c < middle),
        "three_white_soldiers": q.bull & p.bull & x.bull & (p.c > q.c) & (x.c > p.c) & (p.o >= q.o) & (p.o <= q.c) & (x.o >= p.o) & (x.o <= p.c),
        "three_black_crows": q.bear & p.bear & x.bear & (p.c < q.c) & (x.c < p.c) & (p.o <= q.o) & (p.o >= q.c) & (x.o <= p.o) & (x.o >= p.c),
    }


SINGLE = ("doji", "hammer", "hanging_man", "inverted_hammer", "shooting_star", "bullish_marubozu", "bearish_marubozu")
DOUBLE = ("bullish_engulfing", "bearish_engulfing", "bullish_harami", "bearish_harami")
TRIPLE = ("morning_star", "evening_star", "three_white_soldiers", "three_black_crows")
#: What the scan reports, in its order; the two patterns that need a trend to be told apart are left out.
SCAN = (
    ("doji", NEUTRAL), ("hammer", BULLISH), ("inverted_hammer", BULLISH), ("bullish_marubozu", BULLISH), ("bearish_marubozu", BEARISH),
    ("bullish_engulfing", BULLISH), ("bearish_engulfing", BEARISH), ("bullish_harami", BULLISH), ("bearish_harami", BEARISH),
    ("morning_star", BULLISH), ("evening_star", BEARISH), ("three_white_soldiers", BULLISH), ("three_black_crows", BEARISH),
)


def add_patterns(df: DataFrame, names: tuple[str, ...], c: Bars = Bars(), cfg: PatternConfig = PatternConfig()) -> DataFrame:
    t = tests(c, cfg)
    return df.withColumns({n: t[n] for n in names})


def scan(df: DataFrame, alias: str = "patterns", c: Bars = Bars(), cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """Adds an array of (kind, bias), every pattern that ends at the bar."""
    t = tests(c, cfg)
    hits = F.array(*[F.when(t[n], F.struct(F.lit(n).alias("kind"), F.lit(b).alias("bias"))) for n, b in SCAN])
    return df.withColumn(alias, F.filter(hits, lambda x: x.isNotNull()))


@dataclass(frozen=True)
class LivePatterns(Indicator):
    """The scan for streams: the kinds that end at the bar, in the scan's order, joined by commas."""

    config: PatternConfig = PatternConfig()
    types = ("string",)
