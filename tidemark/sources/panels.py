"""Bars, stamps and candidate documents derived from event and order tables.

A panel is long: symbol, ts (bucket start), i (row number within the symbol), o, h, l, c, v. First and last within a
bucket follow the time and then the row's id, so that ties have one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(ticks: DataFrame, symbol: Column, ts: Column, bucket: Column, price: Column, size: Column, tie: list[Column]) -> DataFrame:
    """Ticks summed up by symbol and bucket. min_by and max_by merge before the shuffle."""
    at = F.struct(ts, *tie)
    own = ticks.groupBy(symbol.alias("symbol"), bucket.alias("ts")).agg(
        F.min_by(price, at).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, at).alias("c"), F.sum(size).cast("double").alias("v")
    )
    return own.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.window("ts", "1 hour")["start"].cast("timestamp_ntz")
    return bars(e, F.col("event_type"), F.col("ts"), hour, F.col("value"), F.lit(1), [F.col("event_id")])


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate").cast("timestamp_ntz")
    return bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), day, F.col("o_totalprice"), F.lit(1), [F.col("o_orderkey")])


def bars_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate").cast("timestamp_ntz")
    return bars(li, F.col("l_returnflag"), F.col("l_shipdate"), day, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), [F.col("l_orderkey"), F.col("l_linenumber")])


def stamps(spark: SparkSession, sf_dir: str, kind: str = "error") -> DataFrame:
    """Irregular stamps of one kind of event: ts, event_id, rate."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("ts", "event_id", (F.col("value") / 1e6).alias("rate"))


def upsample(own: DataFrame, bucket: Column, per_bucket: int) -> DataFrame:
    """Bars of a longer bucket; the last bucket of a symbol is dropped if it holds fewer than per_bucket bars."""
    out = own.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n")
    )
    last = F.max("bucket").over(Window.partitionBy("symbol"))
    return out.withColumn("last", last).where((F.col("bucket") < F.col("last")) | (F.col("n") >= per_bucket)).drop("last", "n")


def gaps_and_outliers(own: DataFrame, seconds: int, jump: float = 0.35) -> DataFrame:
    """By symbol: bars, gaps of over 1.5 bar lengths, and closes that move by over `jump`."""
    w = Window.partitionBy("symbol").orderBy("ts")
    step = (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1e6
    move = F.abs(F.col("c") / F.lag("c").over(w) - 1)
    marked = own.select("symbol", (step > 1.5 * seconds).alias("gap"), (move > jump).alias("jump"))
    return marked.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("gap").alias("gaps"), F.count_if("jump").alias("outliers"))


def has_data(x: Column) -> Column:
    """Whether a group has any finite value other than 0; false for one without values."""
    return F.coalesce(F.bool_or((x != 0) & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
