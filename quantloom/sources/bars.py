"""Sources and sinks of bars: ticks, CSV and Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.indicator import Indicator
from quantloom.plans.pipeline import add_indicators
from quantloom.schema import Bars


def resample(ticks: DataFrame, *, symbol: Column, bucket: Column, price: Column, volume: Column, order: list[Column], c: Bars = Bars()) -> DataFrame:
    """Bars from ticks: first, largest, smallest and last price and the volume of every bucket.

    ``order`` must order the ticks of a bucket totally. Partial aggregates run before the shuffle.
    Buckets without ticks make no bar. ``seq`` is 0: a symbol has one bar per bucket.
    """
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    t = ticks.select(symbol.alias(c.symbol), bucket.alias(c.ts), price.cast("double").alias("_p"), volume.cast("double").alias("_v"), at.alias("_at"))
    return t.groupBy(c.symbol, c.ts).agg(
        F.min_by("_p", "_at").alias(c.open), F.max("_p").alias(c.high), F.min("_p").alias(c.low), F.max_by("_p", "_at").alias(c.close), F.sum("_v").alias(c.volume),
    ).select(c.symbol, c.ts, F.lit(0).cast("long").alias(c.seq), c.open, c.high, c.low, c.close, c.volume)


def java_date_format(form: str) -> str:
    """A strftime date format as Spark writes it."""
    table = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%H": "HH", "%M": "mm", "%S": "ss", "%e": "d"}
    out, i, quoted = "", 0, ""
    while i < len(form):
        if form[i : i + 2] in table:
            out += (f"'{quoted}'" if quoted.isalpha() else quoted) + table[form[i : i + 2]]
            quoted, i = "", i + 2
        elif form[i] == "%":
            raise ValueError(f"date format {form[i:i + 2]} is not supported")
        else:
            quoted, i = quoted + form[i], i + 1
    return out + (f"'{quoted}'" if quoted.isalpha() else quoted)


@dataclass(frozen=True)
class CsvLayout:
    """Columns are found by position; header names are ignored."""

    date: int = 0
    open: int = 1
    high: int = 2
    low: int = 3
    close: int = 4
    volume: int = 5
    delimiter: str = ","
    has_header: bool = True
    date_format: str = "%Y-%m-%d"
    unix_seconds: bool = False


#: The headerless exchange layout: unix seconds, prices, volume; a trade count at the end is dropped.
EXCHANGE = CsvLayout(has_header=False, unix_seconds=True)


def read_csv(spark: SparkSession, path: str, layout: CsvLayout = CsvLayout(), *, symbol: str = "", width: int | None = None, mode: str = "FAILFAST", c: Bars = Bars()) -> DataFrame:
    """Bars plus the original ``date`` string. ``width`` is the number of columns in the file
    (default: up to the last one used). An empty date is the epoch; a malformed number fails the
    query, or is null with ``mode='PERMISSIVE'``. ``seq`` follows the order of the file.
    """
    fields = ("date", "open", "high", "low", "close", "volume")
    n = max(max(getattr(layout, f) for f in fields) + 1, width or 0)
    raw = spark.read.csv(path, sep=layout.delimiter, header=layout.has_header, schema=", ".join(f"_c{i} string" for i in range(n)), mode=mode, enforceSchema=True)
    col = lambda f: F.col(f"_c{getattr(layout, f)}")
    date = col("date")
    if layout.unix_seconds:
        ts = F.timestamp_seconds(date.cast("long"))
    else:
        ts = F.when(F.coalesce(date, F.lit("")) == "", F.timestamp_seconds(F.lit(0))).otherwise(F.to_timestamp(date, java_date_format(layout.date_format)))
    number = lambda f: col(f).try_cast("double") if mode == "PERMISSIVE" else F.coalesce(col(f), F.raise_error(F.lit(f"{f} is empty"))).cast("double")
    return raw.select(F.lit(symbol).alias(c.symbol), ts.alias(c.ts), F.monotonically_increasing_id().alias(c.seq), F.coalesce(date, F.lit("")).alias("date"),
                      *[number(f).alias(getattr(c, f)) for f in fields[1:]])


def csv_number(x: Column) -> Column:
    """Whole numbers without a decimal part, other numbers at full precision, null as empty."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), F.lit("")).when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def enriched(df: DataFrame, wanted: dict[str, Indicator], *, date: str = "date", c: Bars = Bars()) -> DataFrame:
    """The table that a CSV sink writes: Date, Open, High, Low, Close, Volume, then indicators by name."""
    out = add_indicators(df, wanted, c=c)
    names = sorted(n for a, i in wanted.items() for n in i.names(a))
    head = {"Date": F.col(date), **{x.title(): F.col(getattr(c, x)) for x in ("open", "high", "low", "close", "volume")}}
    return out.select(c.symbol, c.ts, c.seq, *[v.alias(k) for k, v in head.items()], *names)


def write_csv(df: DataFrame, path: str, *, single_file: bool = False, mode: str = "errorifexists", c: Bars = Bars()) -> None:
    """Writes an enriched table; files follow one another in (symbol, ts, seq) order.

    ``single_file`` gathers the rows in one task; leave it off beyond what one task can write.
    """
    values = [x for x in df.columns if x not in (c.symbol, c.ts, c.seq)]
    rows = df.coalesce(1).sortWithinPartitions(c.symbol, c.ts, c.seq) if single_file else df.repartitionByRange(c.symbol, c.ts, c.seq).sortWithinPartitions(c.symbol, c.ts, c.seq)
    rows.select(*[F.col(v) if v == "Date" else csv_number(F.col(v).cast("double")).alias(v) for v in values]).write.mode(mode).csv(path, header=True, emptyValue="")


def read_parquet(spark: SparkSession, path: str, c: Bars = Bars()) -> DataFrame:
    df = spark.read.parquet(path)
    c.check(df)
    return df


def write_parquet(df: DataFrame, path: str, *, mode: str = "errorifexists", c: Bars = Bars()) -> None:
    """Partitioned by symbol, so that later filters on the symbol prune files."""
    df.repartition(c.symbol).sortWithinPartitions(c.ts, c.seq).write.mode(mode).partitionBy(c.symbol).parquet(path)
