"""Indicators over growing tables: every run reads the new bars only and goes on where the last one ended.

A folder holds one table of states per run: for every symbol the state of each indicator and the place
(ts, seq) of its last bar. A run reads the bars from the latest time of the last run on, gives each symbol its
state in front of its bars, and writes outputs and new states as one table. Day by day equals all at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quantloom.functions.indicator import Indicator
from quantloom.operators.recurrence import whole_symbols
from quantloom.schema import Bars
from quantloom.streaming.steppers import freeze, thaw

_STATE = "__state"


def runs(spark: SparkSession, folder: str) -> list[str]:
    """The finished runs of a folder, oldest first."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(p))
    return [n for n in names if n.startswith("run-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]


def _kinds(i: Indicator) -> tuple[str, ...]:
    return i.types if len(i.types) == len(i.outputs) else i.types * len(i.outputs)


def signature(wanted: dict[str, Indicator]) -> str:
    """Names the indicators and their parameters: states fit no others."""
    return repr(sorted((a, repr(i)) for a, i in wanted.items()))


def advance(bars: DataFrame, wanted: dict[str, Indicator], folder: str, *, c: Bars = Bars()) -> DataFrame:
    """The outputs of the bars that are new since the last run of ``folder`` (all bars in the first run).

    ``bars`` is the whole table; only bars from the last run's latest time on are read, so files (and row
    groups) before it are skipped. Of these a bar is new if it comes after its symbol's last one. A bar that
    arrives later with an older time than the whole table had reached is not seen any more; streams have
    watermarks for that. A run that fails leaves no run: the next one repeats it. Symbols without new bars
    keep their state. The result is a table that is written already.
    """
    c.check(bars)
    if c.session:
        raise ValueError("states go on across sessions; put the session into the symbol to start afresh")
    spark, done = bars.sparkSession, runs(bars.sparkSession, folder)
    mark = signature(wanted)
    source = bars.select(*c.names)
    kinds = [(n, k) for a, i in wanted.items() for n, k in zip(i.names(a), _kinds(i))]
    schema = StructType([*source.schema.fields, *[StructField(n, DoubleType() if k == "double" else StringType()) for n, k in kinds], StructField(_STATE, BinaryType())])
    rows = source.withColumns({"__kind": F.lit(1), _STATE: F.lit(None).cast("binary")})
    if done:
        last = spark.read.schema(schema).parquet(f"{folder}/{done[-1]}").where(F.col(_STATE).isNotNull())
        if (stored := spark.read.text(f"{folder}/of-{done[-1][4:]}").first()) is None or stored[0] != mark:
            raise ValueError("the folder holds states of other indicators")
        reached = last.agg(F.max(c.ts)).first()[0]
        if reached is not None:
            rows = rows.where(F.col(c.ts) >= F.lit(reached))
        rows = rows.unionAll(last.select(*[F.lit(0).alias(x) if x == "__kind" else F.col(x) for x in rows.columns]))
    w = Window.partitionBy(c.symbol).orderBy("__kind", c.ts, c.seq)
    given = [x for x in c.names if x != c.symbol]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in whole_symbols(batches):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                part = b.slice(s, e - s).to_pylist()
                steppers, at = {a: i.start() for a, i in wanted.items()}, None
                if part[0]["__kind"] == 0:
                    frozen, at = pickle.loads(part[0][_STATE]), (part[0][c.ts], part[0][c.seq])
                    steppers = {a: thaw(x, frozen[a]) for a, x in steppers.items()}
                out: list[list] = []
                for r in part:
                    if r["__kind"] == 0 or (at is not None and (r[c.ts], r[c.seq]) <= at):
                        continue
                    at = (r[c.ts], r[c.seq])
                    bar = {x: r[getattr(c, x)] for x in ("open", "high", "low", "close", "volume")}
                    row = [r[x] for x in c.names]
                    for a, i in wanted.items():
                        got = steppers[a].next(bar)
                        row += [None if got is None or (isinstance(got[o], float) and np.isnan(got[o])) else got[o] for o in i.outputs]
                    out.append([*row, None])
                state = pickle.dumps({a: freeze(x) for a, x in steppers.items()})
                end = {c.symbol: part[0][c.symbol], c.ts: at[0], c.seq: at[1]}
                out.append([*[end.get(x) for x in c.names], *[None] * len(kinds), state])
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [*(b.schema.field(x).type for x in c.names), *[pa.float64() if k == "double" else pa.string() for _, k in kinds], pa.binary()])], names=schema.names)

    name = f"run-{int(done[-1][4:]) + 1 if done else 1:08d}"
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/of-{name[4:]}")
    ordered = rows.select(c.symbol, *given, "__kind", _STATE).withColumn("_bar", F.row_number().over(w))
    ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col(_STATE).isNull()).drop(_STATE)
