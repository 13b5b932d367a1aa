"""Readers and writers of bars, stamps and archives. Network pagers of the services behind them are left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of archived candles and funding files; times are epoch milliseconds or microseconds.
CANDLES = "open_time long, o double, h double, l double, c double, v double, close_time long, quote double, trades long, taker double, taker_quote double, ignore string"
FUNDING = "time long, hours int, rate double"
METRICS = "time timestamp_ntz, symbol string, oi double, oi_value double, top_accounts double, top_positions double, accounts double, taker_ratio double"


def millis(x: Column) -> Column:
    """Epoch microseconds as milliseconds; milliseconds as they are."""
    return F.when(x > 100_000_000_000_000, F.floor(x / 1000)).otherwise(x).cast("long")


def timestamp(x: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=millis(x) / F.lit(1000))


def read_candles(spark: SparkSession, path: str, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Candles of CSV archives, with or without a header: rows whose first column isn't a number are dropped."""
    rows = spark.read.schema(CANDLES).option("mode", "DROPMALFORMED").csv(path).where("open_time is not null")
    own = rows.select(F.lit(symbol).alias("symbol"), timestamp(F.col("open_time")).alias("ts"), "o", "h", "l", "c", "v").dropDuplicates(["symbol", "ts"])
    own = own if start is None else own.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return own if end is None else own.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def read_funding(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    rows = spark.read.schema(FUNDING).option("mode", "DROPMALFORMED").csv(path).where("time is not null and rate is not null")
    return rows.select(F.lit(symbol).alias("symbol"), timestamp(F.col("time")).alias("ts"), "rate")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Open interest and taker ratio as long stamps (symbol, ts, kind, value) without missing values."""
    rows = spark.read.schema(METRICS).option("header", True).csv(path)
    return rows.select("symbol", F.col("time").alias("ts"), F.expr("stack(2, 'oi', oi, 'lsr', taker_ratio) as (kind, value)")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")


def read_column_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars stored as one JSON object of parallel arrays, gzipped or not, as rows."""
    schema = "symbol string, tf string, t array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"
    own = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = own.select("symbol", "tf", F.explode(F.arrays_zip("t", "o", "h", "l", "c", "v")).alias("r"))
    return rows.select("symbol", "tf", timestamp(F.col("r.t")).alias("ts"), *[F.col(f"r.{c}").alias(c) for c in "ohlcv"])


def read_closes(spark: SparkSession, path: str) -> DataFrame:
    """Daily closes of a CSV with a header; rows without a positive number are dropped."""
    rows = spark.read.option("header", True).csv(path)
    date, close = rows.columns[0], rows.columns[-1]
    return rows.select(F.to_date(date).alias("day"), F.try_to_number(F.col(close), F.lit("999999999999.999999")).cast("double").alias("close")).where("close > 0 and day is not null")


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> bool:
    """Bars by timeframe and symbol; False, and nothing written, if there are none."""
    if bars.isEmpty():
        return False
    bars.repartition("tf", "symbol").sortWithinPartitions("tf", "symbol", "ts").write.mode(mode).partitionBy("tf", "symbol").parquet(path)
    return True


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, tf: str | None = None) -> DataFrame:
    """Bars of a path written by write_bars; symbol and tf prune partitions."""
    own = spark.read.parquet(path)
    own = own if tf is None else own.where(F.col("tf") == tf)
    return own if symbol is None else own.where(F.col("symbol") == symbol)


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day"))


def base_asset(symbol: Column) -> Column:
    return F.split_part(symbol, F.lit("/"), F.lit(1))


def venue_symbol(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("/"), F.lit(""))


def catalog(bars: DataFrame) -> DataFrame:
    """Coverage by symbol and timeframe."""
    return bars.groupBy("symbol", "tf").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
