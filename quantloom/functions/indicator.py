"""What an indicator is: parameters, output names, a batch form and a bar-by-bar form."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from quantloom.schema import Bars


#: Makes bar-by-bar states; ``quantloom.streaming.steppers`` puts it here, so that it travels with the
#: indicators to executors that cannot import the package.
STEPPER: list = []


@dataclass(frozen=True)
class Indicator:
    """Base class. ``outputs`` are name suffixes; a single output has the suffix ''."""

    outputs = ("",)
    types = ("double",)  # of the outputs; one entry stands for all

    @property
    def name(self) -> str:
        return re.sub(r"(?<!^)(?=[A-Z])", "_", type(self).__name__).lower()

    @property
    def period(self) -> int | None:
        return getattr(self, "n", None)

    @property
    def least_bars(self) -> int:
        """Bars without which a symbol has no output at all."""
        return 1

    def names(self, alias: str) -> list[str]:
        return [f"{alias}_{o}" if o else alias for o in self.outputs]

    def start(self):
        """A fresh bar-by-bar state with ``next(bar)`` and ``reset()``."""
        return STEPPER[0](self)


@dataclass(frozen=True)
class ColumnIndicator(Indicator):
    """Finite lookback or running sum: plain columns over the shared window."""

    def stages(self, c: Bars) -> Iterable[dict[str, Column]]:
        """Columns to add, stage by stage; a later stage may use an earlier one. The last stage has
        one column per output, keyed by suffix; helpers of earlier stages are dropped."""
        raise NotImplementedError

    def apply(self, df: DataFrame, alias: str | None = None, c: Bars = Bars()) -> DataFrame:
        alias = alias or self.name
        *before, last = list(self.stages(c))
        keep = [x for x in df.columns if x not in self.names(alias)]
        for stage in before:
            df = df.withColumns(stage)
        df = df.withColumns({f"_out_{k}": v for k, v in last.items()})
        return df.select(*keep, *[df[f"_out_{o}"].alias(n) for o, n in zip(self.outputs, self.names(alias))])


@dataclass(frozen=True)
class SeriesIndicator(Indicator):
    """Recurrence or state machine: arrays of one symbol in, arrays out (NaN before the first value)."""

    needs = ("close",)

    def series(self, bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        raise NotImplementedError
