"""As-of alignment: every row of one series with the last row of another at or before its time.

Both series are one union, sorted once by key and time; the last right row is carried forward. There is no
range join, so no pair is ever formed that is not in the result. Keys with very many rows are cut into time
blocks, and each block starts from the last right row of the blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.blocks import _BLOCK, cut
from quantloom.schema import Bars
from quantloom.sources.scratch import shared_folder

#: Rows of a key from which it is cut into blocks of about this size.
BLOCK_ROWS = 1_000_000


def asof(left: DataFrame, right: DataFrame, *, on: str = "ts", by: tuple[str, ...] = ("symbol",), seq: str | None = "seq", tolerance: float | None = None, exact: bool = True,
         prefix: str = "right_", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``left`` with all columns of ``right`` (but the keys) under ``prefix``; null without a match.

    A right row matches from its time on: of several the latest, at equal times the one of the largest
    ``seq`` (a column of ``right``; None if times are unique). ``exact`` also matches at the very time.
    ``tolerance`` (seconds for timestamps, days for dates, else the unit of ``on``) leaves matches null that
    are older. Null keys match null keys, and rows without a time match nothing. Rows that agree in
    everything come out as often as they are in ``left``.
    """
    taken = [x for x in right.columns if x not in by]
    if clash := {prefix + x for x in taken} & set(left.columns):
        raise ValueError(f"the table has {', '.join(sorted(clash))} already; use another prefix")
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    order = [F.col(seq)] if seq else []
    none = F.lit(None)
    l = left.select(key.alias("__key"), F.col(on).alias("__ts"), F.lit(1 if exact else -1).alias("__side"), F.struct(*left.columns).alias("__left"), none.cast(right.select(F.struct(*taken)).schema[0].dataType).alias("__right"),
                    (none.cast(right.schema[seq].dataType) if seq else F.lit(0)).alias("__seq"))
    r = right.where(F.col(on).isNotNull()).select(key.alias("__key"), F.col(on).alias("__ts"), F.lit(0).alias("__side"), none.cast(l.schema["__left"].dataType).alias("__left"), F.struct(*taken).alias("__right"), *[x.alias("__seq") for x in order or [F.lit(0)]])
    both = l.unionAll(r)
    c = Bars(symbol="__key", ts="__ts", seq="__seq")
    rows, hot = cut(both, shared_folder(left.sparkSession, "asof"), block_rows, c)
    keys = ["__key", _BLOCK] if hot else ["__key"]
    w = Window.partitionBy(*keys).orderBy("__ts", "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("__match", F.last("__right", ignorenulls=True).over(w))
    if hot:
        last = rows.where(F.col("__left").isNull()).groupBy(*keys).agg(F.max_by("__right", F.struct("__ts", "__seq")).alias("__last"))
        blocks = rows.select(*keys).distinct().join(last, keys, "left")
        before = Window.partitionBy("__key").orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(*keys, F.last("__last", ignorenulls=True).over(before).alias("__carried"))
        filled = filled.join(F.broadcast(carried) if carried.count() <= 100_000 else carried, keys, "left").withColumn("__match", F.coalesce("__match", "__carried"))
    match: Column = F.col("__match")
    good = F.col("__ts").isNotNull()
    if tolerance is not None:
        kind = left.schema[on].dataType.simpleString()
        stamp = kind.startswith("timestamp")
        clock = lambda x: F.unix_micros(x.cast("timestamp")) if stamp else F.unix_date(x) if kind == "date" else x
        good = good & (clock(F.col("__ts")) - clock(match[on]) <= F.lit(tolerance * (1e6 if stamp else 1)))
    out = filled.where(F.col("__left").isNotNull())
    return out.select(*[F.col(f"__left.`{x}`").alias(x) for x in left.columns], *[F.when(good, match[x]).alias(prefix + x) for x in taken])
