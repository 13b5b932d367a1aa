"""Daily sleeves: builders of their inputs, the two-legged blend, hedged residuals, network momentum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import EPS
from tidemark.operators import joins, portfolio, recursive
from tidemark.operators import windows as w


def with_daily_funding(daily: DataFrame, stamps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """daily with ret and the sum of its UTC day's funding stamps (0 if none)."""
    sums = stamps.groupBy(*by, F.to_date("ts").alias("_day")).agg(F.sum("rate").alias("funding"))
    own = daily.withColumn("_day", F.to_date("ts")).join(sums, [*by, "_day"], "left").drop("_day").fillna(0.0, ["funding"])
    return own.withColumn("ret", F.coalesce(F.col("c") / F.lag("c").over(w.order()) - 1, F.lit(0.0)))


def with_implied_vol(daily: DataFrame, index: DataFrame, n: int = 20) -> DataFrame:
    """daily (with ret) of days that the index (ts, iv) has, with iv, realised vol and their gap.

    Realised volatility is that of all bars, before days without an index go.
    """
    own = daily.withColumn("rv", F.coalesce(w.realised_vol(F.when(F.col("i") > 0, F.col("ret")), n), F.lit(0.0)))
    return joins.on_day(own, index, ["iv"]).withColumn("gap", F.col("iv") - F.col("rv"))


def with_feature(daily: DataFrame, features: DataFrame, name: str, lag_days: int = 1) -> DataFrame:
    """daily (with ret) of the days that a lagged feature covers. Returns are of all bars, before days go."""
    shifted = features.select((F.col("ts") + F.expr(f"interval {lag_days} days")).alias("ts"), name)
    return joins.covered(joins.asof_backward(daily, joins.for_each_key(shifted, daily.select("symbol").distinct()), [name], ["symbol"]), name)


def blend(daily: DataFrame, value: str, cost: float = 8e-4, share: float = 0.7, n_trend: int = 150, n_long: int = 200, buy: float = 0.0, sell: float = 0.6, days: int = 90, sell_step: float = 0.06, cap: float = 1.0, idle_yield: float = 0.0) -> DataFrame:
    """daily with the weights of both legs, w, their returns and ret = share a + (1 - share) b + idle yield.

    Leg a is the cycle machine over 1 - 1 / value, carried forward, and the long average, both a bar late; leg b is long at
    or above the trend average. Legs start when both averages are full; funding, if daily has it, is paid while long.
    """
    known = F.when(F.col(value) > 0, 1 - 1 / F.col(value))
    own = daily.withColumns({"_x": F.coalesce(w.carried(known), F.lit(0.0)), "_ma": F.coalesce(w.sma(F.col("c"), n_long), F.col("c"))})
    own = own.withColumns({"_x": w.lag(F.col("_x"), 1), "_up": F.col("c") >= w.lag(F.col("_ma"), 1), "_start": F.col("i") > max(n_trend, n_long) + 2})
    own = own.withColumn("wb", F.when(F.col("_start"), F.coalesce((F.col("c") >= w.sma(F.col("c"), n_trend)).cast("double"), F.lit(0.0))).otherwise(0.0))

    def leg(pdf: pd.DataFrame) -> np.ndarray:
        out, live = np.zeros(len(pdf)), pdf["_start"].to_numpy(dtype=bool)
        out[live] = recursive.cycle_leg(pdf["_x"].to_numpy(dtype=float)[live], pdf["_up"].to_numpy(dtype=bool)[live], buy, sell, days, sell_step, cap)
        return out

    own = recursive.apply(own, {"wa": leg})
    o = w.order()
    r, pay = F.coalesce(F.col("c") / F.lag("c").over(o) - 1, F.lit(0.0)), F.col("funding") if "funding" in daily.columns else F.lit(0.0)

    def realised(name: str) -> Column:
        held, before = F.coalesce(F.lag(name).over(o), F.lit(0.0)), F.coalesce(F.lag(name, 2).over(o), F.lit(0.0))
        return held * r - F.abs(held - before) * cost - held * pay

    own = own.withColumns({"ra": realised("wa"), "rb": realised("wb"), "w": share * F.col("wa") + (1 - share) * F.col("wb")})
    idle = F.greatest(F.lit(0.0), 1 - F.coalesce(F.lag("w").over(o), F.lit(0.0))) * (idle_yield / 365)
    return own.withColumn("ret", share * F.col("ra") + (1 - share) * F.col("rb") + idle).drop("_x", "_ma", "_up", "_start")


def latest_target(decided: DataFrame, now: Column, stale_days: int = 3) -> DataFrame:
    """By symbol the newest weight, between 0 and 1; NULL if it is older than stale_days."""
    own = decided.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("w", "ts").alias("w"))
    fresh = F.datediff(now, F.col("ts")) <= stale_days
    return own.select("symbol", "ts", F.when(fresh, F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0))).alias("target"))


def hedged(streams: DataFrame, market: DataFrame, n: int = 60, cost: float = 7e-4) -> DataFrame:
    """(id, ts, beta, ret): streams less their past beta times the market's return and the cost of changing the hedge."""
    own = streams.withColumnRenamed("id", "symbol").join(market.select("ts", F.col("ret").alias("m")), "ts")
    o = w.order()
    own = own.withColumn("beta", w.past_beta(F.col("ret"), F.col("m"), n))
    change = F.abs(F.col("beta") - F.coalesce(F.lag("beta").over(o), F.lit(0.0)))
    return own.select(F.col("symbol").alias("id"), "ts", "beta", (F.col("ret") - F.col("beta") * F.col("m") - change * cost).alias("ret"))


def network_scores(panel: DataFrame, n: int = 60, least: int = 30) -> DataFrame:
    """(symbol, ts, score): over the others, their return now times how it led this one's over the past n rows.

    panel: symbol, ts, ret on times that all symbols share. One join by time: times x pairs of symbols.
    """
    left = panel.select("ts", "symbol", F.col("ret").alias("y"))
    right = panel.select("ts", F.col("symbol").alias("leader"), F.col("ret").alias("x"), F.lag("ret").over(w.order()).alias("x1"))
    both = left.join(right, "ts").where("symbol <> leader")
    past = Window.partitionBy("symbol", "leader").orderBy("ts").rowsBetween(-n, -1)
    known = (F.count("x1").over(past) > least) & (F.stddev_pop("x1").over(past) > EPS) & (F.stddev_pop("y").over(past) > EPS)
    led = F.when(known, F.corr("x1", "y").over(past)).otherwise(0.0)
    return both.withColumn("_led", led).groupBy("symbol", "ts").agg(F.sum(F.col("_led") * F.col("x")).alias("score"))


def network_momentum(panel: DataFrame, k: int = 2, every: int = 5, n: int = 60) -> DataFrame:
    """panel (symbol, ts, c, ret) with scores and weights of the k best that aren't 0."""
    return portfolio.top_k(panel.join(network_scores(panel, n), ["symbol", "ts"]), "score", k, every, n + 2, skip_zero=True)
