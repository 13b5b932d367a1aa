"""Alignment of streams: as-of joins both ways, intersections, unions, calendars and intervals.

As-of joins are one union and one window: both sides are dealt by the same key once and sorted once, whatever their
sizes, and nothing is compared that isn't adjacent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(bars: DataFrame, stamps: DataFrame, values: list[str], by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """bars with each stamp column's last value at or before the bar's ts. Stamps of one ts: the last by `tie`.

    by: columns that both sides share, besides ts; without any the whole is one ordered stream, which suits stamps that
    concern all bars: then give the bars' own key as `by` and stamps for each key.
    """
    by, tie = by or [], tie or []
    own = [c for c in bars.columns if c not in values]
    row = F.struct(*[F.col(v).alias(v) for v in values])
    left = bars.select(*own, F.lit(None).cast(stamps.select(row.alias("x")).schema["x"].dataType).alias("_stamp"), F.lit(1).alias("_side"), *[F.lit(None).cast(stamps.schema[t].dataType).alias(f"_{t}") for t in tie])
    right = stamps.select(*[F.col(c) if c in [*by, "ts"] else F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in own], row.alias("_stamp"), F.lit(0).alias("_side"), *[F.col(t).alias(f"_{t}") for t in tie])
    w = Window.partitionBy(*by).orderBy("ts", "_side", *[f"_{t}" for t in tie]).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_stamp", F.last("_stamp", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*own, *[F.col(f"_stamp.{v}").alias(v) for v in values])


def for_each_key(stamps: DataFrame, keys: DataFrame) -> DataFrame:
    """The stamps once for each key, for streams that concern every symbol. keys: few rows, as symbols are."""
    return stamps.crossJoin(F.broadcast(keys))


def asof_forward_sum(bars: DataFrame, stamps: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """bars with the sum of the stamps since the bar before, each at the first bar at or after it; 0 if none."""
    by = by or []
    left = bars.select(*by, "ts", F.lit(None).cast("double").alias(value), F.col("ts").alias("_bar"))
    right = stamps.select(*by, "ts", F.col(value).cast("double").alias(value), F.lit(None).cast(bars.schema["ts"].dataType).alias("_bar"))
    # backwards in time a bar comes before the stamps of its ts, and the last bar seen is the next one: one pass
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.col("_bar").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    at = left.unionByName(right).withColumn("_bar", F.last("_bar", ignorenulls=True).over(w)).where(F.col(value).isNotNull() & F.col("_bar").isNotNull())
    sums = at.groupBy(*by, F.col("_bar").alias("ts")).agg(F.sum(value).alias(value))
    return bars.join(sums, [*by, "ts"], "left").fillna(0.0, [value])


def exact(bars: DataFrame, other: DataFrame, value: str, by: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return bars.join(other.select(*by, value), list(by), "left")


def intersection(panel: DataFrame, member: str = "symbol", at: str = "ts") -> DataFrame:
    """Rows of the times that every member has."""
    members = panel.select(member).distinct().agg(F.count("*").alias("_members"))
    common = panel.groupBy(at).agg(F.count_distinct(member).alias("_n")).crossJoin(F.broadcast(members)).where("_n = _members").select(at)
    return panel.join(common, at, "left_semi")


def mean_of_all(streams: DataFrame, streams_in_all: int | None = None) -> DataFrame:
    """ts, ret: sums over the streams that have a time, divided by the number of all streams."""
    n = streams.select("id").distinct().agg(F.count("*").alias("n")) if streams_in_all is None else None
    sums = streams.groupBy("ts").agg(F.sum("ret").alias("s"))
    if n is None:
        return sums.select("ts", (F.col("s") / streams_in_all).alias("ret"))
    return sums.crossJoin(F.broadcast(n)).select("ts", (F.col("s") / F.col("n")).alias("ret"))


def mean_of_present(streams: DataFrame) -> DataFrame:
    return streams.groupBy("ts").agg(F.avg("ret").alias("ret"))


def on_day(left: DataFrame, right: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Inner join by UTC day."""
    r = right.select(*by, F.to_date("ts").alias("_day"), *columns)
    return left.withColumn("_day", F.to_date("ts")).join(r, [*by, "_day"]).drop("_day")


def covered(bars: DataFrame, feature: str) -> DataFrame:
    """Rows on which a feature is there and not 0."""
    return bars.where(F.col(feature).isNotNull() & (F.col(feature) != 0))


def labelled(returns: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels by exact time; NULL where there is none."""
    return returns.join(labels.select("ts", label), "ts", "left")


def within(rows: DataFrame, windows: DataFrame, start: str = "start", end: str = "end", ts: str = "ts") -> DataFrame:
    """Rows of each interval [start, end). windows are a calendar: its size doesn't follow the data, so it is sent to all."""
    return rows.join(F.broadcast(windows), (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)))


def pairwise(streams: DataFrame, least: int = 30, ordered: bool = False) -> DataFrame:
    """a, b, n, corr of two streams over the times they share, for a < b (for all a <> b, if ordered).

    The join is by time: its size is times x pairs of streams, and is summed up before the next exchange.
    """
    left, right = streams.select("ts", F.col("id").alias("a"), F.col("ret").alias("x")), streams.select("ts", F.col("id").alias("b"), F.col("ret").alias("y"))
    both = left.join(right, "ts").where(F.col("a") != F.col("b") if ordered else F.col("a") < F.col("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr")).where(F.col("n") > least)


def lookups(parent: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left joins of several one-row-a-key tables: {name: (table, key)}."""
    return reduce(lambda df, own: df.join(own[0], own[1], "left"), children.values(), parent)


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def below_family_cap(rows: DataFrame, existing: DataFrame, family: str, cap: int = 10) -> DataFrame:
    """Rows whose family has fewer than cap members so far."""
    full = existing.groupBy(family).agg(F.count("*").alias("_n")).where(F.col("_n") >= cap)
    return rows.join(full, family, "left_anti")


def penalised(rows: DataFrame, box: DataFrame, key: str, now: Column) -> DataFrame:
    return rows.join(box.where(F.col("until") > now).select(key).distinct(), key, "left_semi")


def sweep(bars: DataFrame, params: DataFrame) -> DataFrame:
    """Every bar for every row of a parameter table. Parameter tables are made by the caller, not by data."""
    return bars.crossJoin(F.broadcast(params))
