"""Planning of many indicators over one table: one shuffle on the symbol.

Column indicators become window expressions over the shared specification, which Spark runs on one
exchange and one sort. All recurrences and state machines go into a single Arrow pass that follows on the
same partitioning and order. Only the columns that something needs reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from quantloom.functions import kernels
from quantloom.functions.indicator import ColumnIndicator, Indicator, SeriesIndicator
from quantloom.operators.recurrence import whole_symbols
from quantloom.schema import Bars
from quantloom.streaming import steppers  # noqa: F401  registers the bar-by-bar forms


def _require_bars(df: DataFrame, c: Bars, wanted: dict[str, Indicator]) -> DataFrame:
    """Fails the query for symbols that are too short for some indicator."""
    least = max(i.least_bars for i in wanted.values())
    n = F.count(F.lit(1)).over(Window.partitionBy(c.symbol, *c.session_key))
    message = F.concat(F.lit("a symbol has fewer than "), F.lit(str(least)), F.lit(" bars: "), F.col(c.symbol).cast("string"))
    return df.withColumn(c.close, F.when(n < least, F.raise_error(message).cast("double")).otherwise(F.col(c.close)))


#: Rolling indicators of at least this lookback run as array kernels, whose cost does not grow with it.
WIDE = 48


def add_indicators(df: DataFrame, wanted: dict[str, Indicator], *, c: Bars = Bars(), on_short: str = "null", wide: int = WIDE) -> DataFrame:
    """Adds the outputs of every indicator under its alias (``alias`` or ``alias_suffix``).

    Rolling indicators that look back ``wide`` bars or more join the recurrences in their Arrow pass; the
    others are columns. One row per bar, null during warm-up. Symbols shorter than an indicator needs have nulls, or
    fail the query with ``on_short='raise'``. Null prices are NaN to a recurrence and carried on.
    """
    c.check(df)
    if on_short not in ("null", "raise"):
        raise ValueError("on_short is null or raise")
    new = [n for alias, i in wanted.items() for n in i.names(alias)]
    if len(set(new)) != len(new) or set(new) & set(c.names):
        raise ValueError("output names must differ from each other and from the bar columns")
    if not wanted:
        return df
    base = df.drop(*new)
    if on_short == "raise":
        base = _require_bars(base, c, wanted)
    out = base
    arrays = [a for a, i in wanted.items() if isinstance(i, SeriesIndicator) or (kernels.has_kernel(i) and kernels.lookback(i) >= wide)]
    for alias, i in wanted.items():
        if isinstance(i, ColumnIndicator) and alias not in arrays:
            out = i.apply(out, alias, c)
    series = {a: wanted[a] for a in arrays}
    if series:
        out = _grouped(out, series, c)
    return out.select(*base.columns, *new)


def _grouped(df: DataFrame, wanted: dict[str, Indicator], c: Bars) -> DataFrame:
    """All recurrences and kernels in one pass over Arrow batches that hold many symbols.

    The bar number is a window over the shared specification: it makes Spark cluster and sort the
    rows (or reuse what column indicators already need), it marks where symbols begin, and it
    proves the order, which is checked. Memory holds the bars of one symbol at a time.
    """
    added = [n for a, i in wanted.items() for n in i.names(a)]
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in added]])
    source = {x: getattr(c, x, x) for x in sorted({x for i in wanted.values() for x in (i.needs if isinstance(i, SeriesIndicator) else kernels.reads(i))})}

    def extended(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        columns = {x: b.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False) for x, s in source.items()}
        new: dict[str, list[np.ndarray]] = {n: [] for n in added}
        known: dict[str, list[np.ndarray]] = {n: [] for n in added}
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            bars = {x: v[s:e] for x, v in columns.items()}
            for alias, i in wanted.items():
                got = {o: (y, ~np.isnan(y)) for o, y in i.series(bars).items()} if isinstance(i, SeriesIndicator) else kernels.arrays(i, bars)
                for suffix, name in zip(i.outputs, i.names(alias)):
                    new[name].append(got[suffix][0])
                    known[name].append(got[suffix][1])
        arrays = [pa.array(np.concatenate(new[n]), pa.float64(), mask=~np.concatenate(known[n])) for n in added]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_symbols(batches):
            yield extended(b, starts)

    return df.withColumn("_bar", F.row_number().over(c.window())).mapInArrow(run, schema)
