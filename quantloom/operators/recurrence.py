"""The linear recurrences behind exponential and Wilder smoothing, and the walk over whole symbols."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def linear(x: np.ndarray, alpha: float, seed_at: int = 0, seed: float | None = None) -> np.ndarray:
    """y = alpha * x + (1 - alpha) * y_before from ``seed_at`` on, where y is ``seed`` (default x); NaN before."""
    y = np.full(len(x), np.nan)
    if len(x) <= seed_at:
        return y
    z = np.array(x[seed_at:], np.float64)
    if seed is not None:
        z[0] = seed
    if np.isnan(z).any():  # ewm would skip a NaN, the recurrence carries it on
        at = int(np.flatnonzero(np.isnan(z))[0])
        z = z[:at]
    y[seed_at : seed_at + len(z)] = pd.Series(z).ewm(alpha=alpha, adjust=False).mean().to_numpy() if len(z) else z
    return y


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return linear(x, 2 / (n + 1))


def wilder_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n values, then (y * (n - 1) + x) / n."""
    if len(x) < n:
        return np.full(len(x), np.nan)
    return linear(x, 1 / n, n - 1, float(np.mean(x[:n])))


def whole_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole symbols and where each begins, from sorted batches whose last column numbers the
    bars of a symbol from 1. Memory holds the bars of one symbol at a time, or one batch."""
    held: list[pa.RecordBatch] = []
    last = 0
    for b in batches:
        if not b.num_rows:
            continue
        rn = b.column(b.num_columns - 1).to_numpy()
        if ((rn != 1) & (rn != np.append(last, rn[:-1]) + 1)).any():
            raise RuntimeError("bars did not arrive in order")
        last = int(rn[-1])
        starts = np.flatnonzero(rn == 1)
        if not len(starts):
            held.append(b)
            continue
        if starts[0]:
            held.append(b.slice(0, starts[0]))
        if held:
            yield pa.concat_batches(held), np.array([0])
        if len(starts) > 1:
            yield b.slice(starts[0], starts[-1] - starts[0]), starts[:-1] - starts[0]
        held = [b.slice(starts[-1])]
    if held:
        yield pa.concat_batches(held), np.array([0])
