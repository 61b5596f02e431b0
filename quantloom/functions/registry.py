"""Indicators by name, also from SQL.

``register(spark)`` adds a table function that computes any registered indicator over a partitioned table:

    SELECT * FROM indicator(TABLE(bars) PARTITION BY symbol ORDER BY (ts, seq), 'sma', '{"n": 5}')

and ``define`` makes an indicator of one's own known under a name: a class with parameters, outputs and a
bar-by-bar form.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quantloom.functions import momentum, trend, volatility, volume
from quantloom.functions.indicator import ColumnIndicator, Indicator, SeriesIndicator

_BASES = (Indicator, ColumnIndicator, SeriesIndicator)
_KNOWN: dict[str, type] = {}


def define(name: str, cls: type) -> None:
    """Makes ``cls`` known as ``name``. Instances have ``outputs``, ``types`` and ``start()``, which returns
    an object with ``next(bar)``: a dictionary of outputs, or None while there is not enough data."""
    if not name.isidentifier():
        raise ValueError("a name is letters, digits and underscores")
    if not all(hasattr(cls, x) for x in ("outputs", "start")):
        raise ValueError("an indicator has outputs and start()")
    _KNOWN[name.lower()] = cls


for _module in (trend, momentum, volatility, volume):
    for _cls in vars(_module).values():
        if isinstance(_cls, type) and issubclass(_cls, Indicator) and _cls not in _BASES:
            define(re.sub(r"(?<!^)(?=[A-Z])", "_", _cls.__name__).lower(), _cls)


def names() -> list[str]:
    return sorted(_KNOWN)


def make(name: str, params: str | dict | None = None) -> Indicator:
    """The indicator of a name with parameters as JSON or a dictionary; unknown ones are refused."""
    if name.lower() not in _KNOWN:
        raise ValueError(f"no indicator is called {name}; there are {', '.join(names())}")
    given = json.loads(params or "{}") if not isinstance(params, dict) else params
    return _KNOWN[name.lower()](**given)


def _kinds(i: Indicator) -> list[tuple[str, str]]:
    types = getattr(i, "types", ("double",))
    own = i.outputs if i.outputs != ("",) else ("value",)
    return list(zip(own, types if len(types) == len(own) else types * len(own)))


class IndicatorTable:
    """Rows of the table, each with the indicator's outputs (``value`` if it has one). Every partition is a
    series of its own, in the order that the call states."""

    @staticmethod
    def analyze(table: AnalyzeArgument, name: AnalyzeArgument, params: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(name.value, str) or (params is not None and not isinstance(params.value, (str, type(None)))):
            raise ValueError("the name and the parameters are constant strings")
        made = make(name.value, params.value if params is not None else None)
        outputs = [StructField(o, DoubleType() if k == "double" else StringType()) for o, k in _kinds(made)]
        if clash := {f.name for f in outputs} & set(table.dataType.names):
            raise ValueError(f"the table has {', '.join(sorted(clash))} already; rename them first")
        return AnalyzeResult(StructType([*table.dataType.fields, *outputs]))

    def __init__(self):
        self.live = None

    def eval(self, row: Row, name: str, params: str | None = None):
        if self.live is None:
            made = make(name, params)
            self.keys = made.outputs
            self.live = made.start()
        got = self.live.next(row.asDict())
        values = [None if got is None else got[k] for k in self.keys]
        yield (*row, *[None if isinstance(v, float) and math.isnan(v) else v for v in values])


def register(spark: SparkSession, name: str = "indicator") -> None:
    """Adds the table function to a session."""
    spark.udtf.register(name, udtf(IndicatorTable))
