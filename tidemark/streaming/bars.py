"""Bars from streams of ticks: closed bars behind a watermark, forming candles, and idempotent micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import documents


def ticks(spark, path: str, schema, per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files of events. Watermarks need times with a zone, so that ts is cast here."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def closed_bars(stream: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars that no event can change any more: append mode emits a window once the watermark has passed it.

    Events later than `late` are dropped; events delivered again within it count once.
    """
    own = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return _bars(own, length)


def forming_bars(stream: DataFrame, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """The bars that events still change, for update mode."""
    return _bars(stream.withWatermark("ts", late), length)


def _bars(stream: DataFrame, length: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    own = stream.groupBy(F.window("ts", length).alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count("*").cast("double").alias("v")
    )
    return own.select("symbol", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v")


def append_batches(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stores each batch's rows after the last stored ones of their symbol, so that a batch run twice adds nothing."""

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        documents.append_new(old, batch, ("symbol",)).write.mode("append").parquet(path)

    return bars.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
