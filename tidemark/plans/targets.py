"""What a document wants to hold now, from each symbol's trailing bars and what is held: the step of a live account.

The same evaluator as the back-test's reads the last `keep` bars of a symbol. Stops of a held position aren't carried as
state: they are derived again from the bars since the entry, which is the newest bar (of the last `LOOK`) that closed at the
price the position was opened at, or the bar before the last if there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import expr
from tidemark.plans.backtest import DECAY

#: Trailing bars, how far back an entry is looked for, how near its close has to be, and returns of the volatility estimate.
KEEP, LOOK, NEAR, WARM = 3000, 800, 1e-4, 500


def trailing(bars: DataFrame, keep: int = KEEP, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The last `keep` bars of each symbol, numbered from 0."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))
    own = bars.withColumn("_back", newest).where(F.col("_back") <= keep).drop("_back")
    return own.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("ts")) - 1)


def targets(bars: DataFrame, doc: dict, held: DataFrame, per_year: float, params: dict[str, float] | None = None, keep: int = KEEP) -> DataFrame:
    """(symbol, ts, c, dir, weight, reason) of each symbol's last bar: what to hold from its close on, and why a position ends.

    held: (symbol, dir, price), one row for each open position. reason: exit, stop or trail; NULL where nothing ends.
    """
    risk = doc["risk"]
    own = expr.signals(trailing(bars, keep), doc, params).join(held.select("symbol", F.col("dir").alias("_was"), F.col("price").alias("_price")), "symbol", "left")
    whole = Window.partitionBy("symbol")
    own = own.withColumn("_last", F.max("i").over(whole))
    back = F.col("_last") - F.col("i")
    at_entry = (F.col("i") >= F.greatest(F.lit(1), F.col("_last") - LOOK)) & (F.abs(F.col("c") - F.col("_price")) / F.col("_price") < NEAR)
    own = own.withColumn("_entry", F.coalesce(F.max(F.when(at_entry, F.col("i"))).over(whole), F.greatest(F.lit(1), F.col("_last") - 1)))
    r = F.col("c") / F.lag("c").over(whole.orderBy("ts")) - 1
    first = F.greatest(F.lit(1), F.col("_last") - WARM)
    share = F.when(F.col("i") == first, F.pow(F.lit(DECAY), back)).when(F.col("i") > first, (1 - DECAY) * F.pow(F.lit(DECAY), back))
    own = own.withColumn("_part", share * r * r)
    now = lambda c: F.max(F.when(F.col("i") == F.col("_last"), F.col(c))).alias(c)
    since = F.when(F.col("i") >= F.col("_entry"), F.col("c"))
    last = own.groupBy("symbol").agg(
        now("ts"), now("c"), *[now(s) for s in expr.SIGNALS], F.first("_was").alias("_was"), F.first("_price").alias("_price"), F.sum("_part").alias("_var"),
        F.max(F.when(F.col("i") == F.col("_entry"), F.col("atr14"))).alias("_atr"), F.max(since).alias("_top"), F.min(since).alias("_bottom"),
    )
    side, c, price = F.coalesce(F.col("_was"), F.lit(0)), F.col("c"), F.col("_price")
    left = ((side == 1) & F.col("longExit")) | ((side == -1) & F.col("shortExit"))
    reason = F.when(left, "exit")
    known = (side != 0) & (price > 0)
    if risk.get("stopAtrMult"):
        level = price - side * risk["stopAtrMult"] * F.col("_atr")
        reason = reason.when(known & F.col("_atr").isNotNull() & ~F.isnan("_atr") & (side * c <= side * level), "stop")
    if risk.get("trailActivate") and risk.get("trailOffset"):
        gain = F.when(side == 1, c / price - 1).otherwise(price / c - 1)
        back_off = F.when(side == 1, F.col("_top") / c - 1).otherwise(c / F.col("_bottom") - 1)
        reason = reason.when(known & (gain >= risk["trailActivate"]) & (back_off >= risk["trailOffset"]), "trail")
    kept = F.when(F.col("reason").isNotNull(), 0).otherwise(side)
    new = F.when(kept != 0, kept).when(F.col("longEntry"), 1).when(F.col("shortEntry"), -1).otherwise(0)
    size = F.when(F.col("_var") > 1e-12, F.least(F.lit(float(risk["maxLeverage"])), _root(risk["volTargetAnnual"] ** 2 / per_year / F.col("_var")))).otherwise(F.least(F.lit(float(risk["maxLeverage"])), F.lit(1.0)))
    return last.withColumn("reason", reason).select("symbol", "ts", "c", new.cast("int").alias("dir"), (new * size).alias("weight"), "reason")


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), x))
