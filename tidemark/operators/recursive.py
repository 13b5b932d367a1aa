"""Kernels that depend on their own previous value: one pass over each symbol's ordered rows, in Arrow batches.

Windows can't express these. A symbol's series is one group; sweeps group by (run, symbol), so that tasks multiply with
what is swept. Values are NaN inside and NULL outside until they are known.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Weight 2 / (n + 1) for the newest; starts at the mean of the first n known values."""
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    if len(known) == 0 or known[0] + n > len(x):
        return out
    at, k = known[0] + n - 1, 2.0 / (n + 1)
    now = x[known[0] : at + 1].mean()
    out[at] = now
    for i, v in enumerate(x[at + 1 :].tolist(), at + 1):
        now = v * k + now * (1 - k)
        out[i] = now
    return out


def wilder(x: np.ndarray, n: int, start: int) -> np.ndarray:
    """Mean of x[start : start + n], then n - 1 parts of the value before and one of the newest."""
    out = np.full(len(x), np.nan)
    if start + n > len(x):
        return out
    now = x[start : start + n].mean()
    out[start + n - 1] = now
    for i, v in enumerate(x[start + n :].tolist(), start + n):
        now = (now * (n - 1) + v) / n
        out[i] = now
    return out


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    known = np.flatnonzero(~np.isnan(x))
    first = known[0] if len(known) else len(x)
    moved = np.diff(x, prepend=np.nan)
    gain, loss = wilder(np.maximum(moved, 0), n, first + 1), wilder(np.maximum(-moved, 0), n, first + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))


def true_range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    was = np.roll(c, 1)
    tr = np.maximum(h - low, np.maximum(np.abs(h - was), np.abs(low - was)))
    tr[:1] = 0.0
    return tr


def atr(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(h, low, c), n, 1)


def adx(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Trend strength: smoothed directional moves over smoothed true range, smoothed again."""
    if len(c) < 2 * n + 1:
        return np.full(len(c), np.nan)
    up, down = np.diff(h, prepend=h[0]), -np.diff(low, prepend=low[0])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    ranges, plus, minus = (wilder(x, n, 1) * n for x in (true_range(h, low, c), plus, minus))
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = (np.where(ranges > 1e-12, 100 * x / ranges, 0.0) for x in (plus, minus))
        dx = np.where(p + m > 1e-12, 100 * np.abs(p - m) / (p + m), 0.0)
    dx[:n] = np.nan
    return wilder(dx, n, n)


def ewma_variance(ret: np.ndarray, decay: float = 0.94) -> np.ndarray:
    out = np.empty(len(ret))
    now = np.nan
    for i, r in enumerate(np.nan_to_num(ret).tolist()):
        now = r * r if i == 0 else decay * now + (1 - decay) * r * r
        out[i] = now
    return out


def entry_prices(weight: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Volume-weighted entry price of the open position, and the gain that each change of weight realises."""
    entry, gains = np.full(len(weight), np.nan), np.zeros(len(weight))
    held, at = 0.0, np.nan
    for i, (w, p) in enumerate(zip(weight.tolist(), price.tolist(), strict=True)):
        change = w - held
        if held == 0 or held * w < 0:  # opened, or turned round
            if held:
                gains[i] = held * (p / at - 1)
            at = p if w else np.nan
        elif abs(w) > abs(held):
            at = (at * abs(held) + p * abs(change)) / abs(w)
        elif change:
            gains[i] = -change * (p / at - 1)
            at = at if w else np.nan
        held = w
        entry[i] = at
    return entry, gains


def cycle_leg(value: np.ndarray, above: np.ndarray, buy: float, sell: float, days: int, sell_step: float = 0.06, cap: float = 1.0) -> np.ndarray:
    """Weights of a machine over a valuation: idle, buying after value <= buy, selling after value >= sell.

    It buys a step a bar up to cap, or all at once above the trend; it sells sell_step a bar above the trend and two
    steps below it; it is idle again once full or empty. A step is 30 / (4 days), the whole at most.
    """
    out, held, mode, step = np.zeros(len(value)), 0.0, 0, 1 / max(1, round(days / 30 * 4))
    for i, (x, up) in enumerate(zip(value.tolist(), above.tolist(), strict=True)):
        if x >= sell and held > 0:
            mode = -1
        elif x <= buy and held < 1:
            mode = 1
        if mode < 0:
            held = max(0.0, held - (sell_step if up else 2 * step))
        elif mode > 0:
            held = 1.0 if up else min(cap, held + step)
        if (mode < 0 and held <= 1e-9) or (mode > 0 and held >= 1 - 1e-9):
            mode = 0
        out[i] = held
    return out


KERNELS: dict[str, Callable[..., np.ndarray]] = {"ema": ema, "rsi": rsi, "atr": atr, "adx": adx, "ewma_variance": ewma_variance}


def apply(bars: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with a double column for each function of a group's rows in the order of ts. One exchange and sort for all."""
    schema = T.StructType([*bars.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("ts", kind="stable", ignore_index=True)
        return own.assign(**{c: pd.Series(f(own), dtype="float64") for c, f in columns.items()})

    return bars.groupBy(*by).applyInPandas(run, schema)


def of(kernel: str, *inputs: str, n: int) -> Callable[[pd.DataFrame], np.ndarray]:
    """A column function for apply(): a kernel of the named columns."""
    own = KERNELS[kernel]
    return lambda pdf: own(*(pdf[c].to_numpy(dtype=np.float64) for c in inputs), n)
