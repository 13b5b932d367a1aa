"""Forward simulation as keyed state: each candidate's equity, weight and last time, stepped by arriving bars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "symbol string, ts timestamp, equity double, peak double, weight double, killed boolean"
STATE = "last_us long, close double, equity double, peak double, weight double, killed boolean, recent array<double>"


def step(bars: DataFrame, n: int = 20, cost: float = 13e-4, worst: float = 0.5) -> DataFrame:
    """A long-above-average account for each symbol: weights decided at a close earn the next bar.

    Bars not after the account's last one are ignored, so that a batch delivered again changes nothing. An account whose
    equity falls by `worst` from its peak stays flat.
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, close, equity, peak, weight, killed, recent = state.get if state.exists else (-1, 0.0, 1.0, 1.0, 0.0, False, [])
        recent, out = list(recent), []
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, c in rows[["ts", "c"]].itertuples(index=False):
            us = int(ts.value // 1000)
            if us <= last:
                continue
            if close > 0:
                equity *= 1 + weight * (c / close - 1)
            peak = max(peak, equity)
            killed = killed or equity <= (1 - worst) * peak
            recent = [*recent, c][-n:]
            new = float(len(recent) == n and c > sum(recent) / n and not killed)
            equity *= 1 - abs(new - weight) * cost
            last, close, weight = us, c, new
            out.append((key[0], ts, equity, peak, weight, killed))
        state.update((last, close, equity, peak, weight, killed, recent))
        yield pd.DataFrame(out, columns=["symbol", "ts", "equity", "peak", "weight", "killed"])

    return bars.groupBy("symbol").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
