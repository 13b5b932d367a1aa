"""Back-test: a state machine turns signals into weights, then windows turn weights into returns.

The first pass needs its own past and is one grouped map for each (run, symbol); the second is native.

Rules of the first pass, at each bar's close: an exit and an entry may happen on one bar, so that a stop while the entry
still holds changes nothing; a stop is tested at the level set before this bar; the weight is the direction times the
volatility target over an exponentially weighted estimate, at most maxLeverage.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import expr

#: Loss floor of a bar, equity share at which an account is lost, and margin kept by a leveraged short.
FLOOR, BUST, MARGIN = -0.95, 0.05, 0.005
DECAY = 0.94


class Stops:
    """Stop levels of the open position."""

    def __init__(self, risk: dict) -> None:
        self.stop, self.trail = risk.get("stopAtrMult"), risk.get("trailAtrMult")
        self.arm, self.give = risk.get("trailActivate"), risk.get("trailOffset")
        self.level = self.best = self.entry = math.nan
        self.armed = False

    def open(self, side: int, price: float, atr: float) -> None:
        self.entry = self.best = price
        self.armed = False
        self.level = price - side * self.stop * atr if self.stop and not math.isnan(atr) else math.nan

    def hit(self, side: int, price: float, atr: float) -> bool:
        """Whether this close stops the position out; then moves the levels."""
        out = not math.isnan(self.level) and side * price <= side * self.level
        self.best = side * max(side * self.best, side * price)
        if self.arm and self.give and self.entry > 0:
            gain = price / self.entry - 1 if side == 1 else self.entry / price - 1
            self.armed |= gain >= self.arm
            back = self.best / price - 1 if side == 1 else price / self.best - 1
            out |= self.armed and back >= self.give
        if self.trail and not math.isnan(atr):
            trail = self.best - side * self.trail * atr
            self.level = trail if math.isnan(self.level) else side * max(side * self.level, side * trail)
        return out


def weights(pdf: pd.DataFrame, risk: dict, per_year: float) -> tuple[np.ndarray, np.ndarray]:
    """Direction and weight decided at each close of a symbol's ordered bars; the first bar decides nothing."""
    n, side = len(pdf), 0
    dirs, out = np.zeros(n, dtype=np.int32), np.zeros(n)
    close, atr = pdf["c"].tolist(), pdf["atr14"].astype(float).tolist()
    enter, leave, short, cover = (pdf[s].tolist() for s in expr.SIGNALS)
    target, stops, var = risk["volTargetAnnual"] ** 2 / per_year, Stops(risk), None
    for i in range(1, n):
        r = close[i] / close[i - 1] - 1 if close[i - 1] > 0 else 0.0
        var = r * r if var is None else DECAY * var + (1 - DECAY) * r * r
        stopped = side != 0 and stops.hit(side, close[i], atr[i])
        new = 0 if side and (stopped or (leave[i] if side == 1 else cover[i])) else side
        if not new:
            new = 1 if enter[i] else -1 if short[i] else 0
        if new != side and new:
            stops.open(new, close[i], atr[i])
        side = new
        dirs[i] = side
        if side:
            out[i] = side * min(risk["maxLeverage"], math.sqrt(target / var) if var > 1e-12 else 1.0)
    return dirs, out


def decide(signals: DataFrame, risk: dict, per_year: float, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """signals with dir and w, the weight held during the next bar."""
    schema = T.StructType([*signals.schema.fields, T.StructField("dir", T.IntegerType()), T.StructField("w", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("ts", kind="stable", ignore_index=True)
        dirs, w = weights(own, risk, per_year)
        return own.assign(dir=dirs, w=w)

    return signals.groupBy(*by).applyInPandas(run, schema)


def long_flat(signals: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """dir and w of long entries and exits without stops and sizing: the last of them rules, an entry before an exit."""
    own = Window.partitionBy(*by).orderBy("ts")
    event = F.when(F.row_number().over(own) == 1, 0).when(F.col("longEntry"), 1).when(F.col("longExit"), 0)
    last = F.last("_event", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return signals.withColumn("_event", event).withColumn("dir", last).withColumn("w", F.col("dir").cast("double")).drop("_event")


def returns(decided: DataFrame, cost: float, funding: Column | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """w_held, turnover, ret and equity of decided weights; cost: share of each change of weight."""
    o = Window.partitionBy(*by).orderBy("ts")
    held, before = F.coalesce(F.lag("w").over(o), F.lit(0.0)), F.coalesce(F.lag("w", 2).over(o), F.lit(0.0))
    was = F.lag("c").over(o)
    own = decided.withColumns({"w_held": held, "turnover": F.abs(held - before), "_r": F.when(was > 0, F.col("c") / was - 1).otherwise(0.0), "_up": F.when(was > 0, F.col("h") / was - 1), "_first": was.isNull()})
    costs = F.col("turnover") * cost
    plain = F.col("w_held") * F.col("_r") - costs - F.col("w_held") * (F.lit(0.0) if funding is None else funding)
    room = 1 / F.abs("w_held") - MARGIN
    squeezed = (F.col("w_held") < -1) & (F.col("_up") >= room)
    own = own.withColumn("ret", F.when(F.col("_first"), 0.0).otherwise(F.greatest(F.lit(FLOOR), F.when(squeezed, -room - costs).otherwise(plain))))
    up_to, before_now = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(up_to)))
    bust = F.coalesce(F.max(F.col("equity") <= BUST).over(before_now), F.lit(False))
    own = own.withColumn("ret", F.when(bust, 0.0).otherwise(F.col("ret"))).withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(up_to)))
    return own.drop("_r", "_up", "_first")


def trades(run: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Entry and exit time, side and return of every position of returns(); the last one ends with the data."""
    o = Window.partitionBy(*by).orderBy("ts")
    own = run.withColumn("_new", F.coalesce((F.col("dir") != F.lag("dir").over(o)).cast("int"), F.lit(0)))
    own = own.withColumns({"_trade": F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)), "_end": F.coalesce(F.lead("ts").over(o), F.col("ts")), "_end_equity": F.coalesce(F.lead("equity").over(o), F.col("equity"))})
    exits = own.withColumns({"_exit_equity": F.coalesce(F.lead("_end_equity").over(o), F.col("_end_equity"))})
    held = exits.where("dir <> 0").groupBy(*by, "_trade")
    return held.agg(F.min("ts").alias("entry_ts"), F.max("_end").alias("exit_ts"), F.first("dir").alias("dir"), (F.max_by("_exit_equity", "ts") / F.min_by("equity", "ts") - 1).alias("ret")).drop("_trade")


def backtest(bars: DataFrame, doc: dict, params: dict[str, float] | None = None, per_year: float = 365.0, cost: float = 13e-4) -> DataFrame:
    """bars with dir, w, w_held, turnover, ret and equity of a strategy document."""
    own = decide(expr.signals(bars, doc, params), doc["risk"], per_year)
    return returns(own, cost)
