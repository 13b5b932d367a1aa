"""Series that are corrected for some days after they are published: late corrections merged into a table by months.

Rows are long: key, day, metric, value, rev, the higher rev being the later correction. A row counts if its day isn't over
`days` before the last stored day of its key; of a (key, day, metric) the highest rev stays, of equal revs the highest
value. So the order in which corrections come within those days doesn't matter, and a batch that comes again changes nothing.

Nulls: a row without key, day, metric or value is none; a null rev is the lowest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "key string, day date, metric string, value double, rev long"
COLUMNS = ("key", "day", "metric", "value", "rev")


def in_time(feed: DataFrame, last: DataFrame, days: int = 5) -> DataFrame:
    """The rows of feed that still count. last: (key, last), the last stored day of each key."""
    own = feed.dropna(subset=["key", "day", "metric", "value"]).join(last, "key", "left")
    return own.where(F.col("last").isNull() | (F.col("day") >= F.date_sub("last", days))).select(*COLUMNS)


def merged(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """One row for each (key, day, metric) of both: its last correction."""
    rows = stored.select(*COLUMNS).unionByName(feed.select(*COLUMNS))
    best = F.max(F.struct(F.coalesce("rev", F.lit(-(1 << 62))).alias("at"), "value", "rev")).alias("b")
    return rows.groupBy("key", "day", "metric").agg(best).select("key", "day", "metric", "b.value", "b.rev")


def revised(stored: DataFrame, feed: DataFrame, days: int = 5) -> DataFrame:
    """The table after one batch."""
    return merged(stored, in_time(feed, stored.groupBy("key").agg(F.max("day").alias("last")), days))


def store(feed: DataFrame, path: str, batch: int, days: int = 5) -> None:
    """Merges a batch into the table at path, which is partitioned by month: only the batch's months are read and replaced.

    The new months are written aside first, so that a run that breaks off leaves either the old or the new month, and the
    batch can be run again.
    """
    spark = feed.sparkSession
    month = F.date_format("day", "yyyy-MM").alias("month")
    try:
        old = spark.read.schema(f"{SCHEMA}, month string").parquet(path)
    except Exception as e:  # the first batch: there is no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], f"{SCHEMA}, month string")
    fresh = in_time(feed, old.groupBy("key").agg(F.max("day").alias("last")), days).withColumn("month", month)
    months = [r["month"] for r in fresh.select("month").distinct().collect()]  # a few: those of one batch
    if not months:
        return
    aside = f"{path}/_aside/{batch}"
    new = merged(old.where(F.col("month").isin(months)), fresh).withColumn("month", month)
    new.repartition("month", "key").write.mode("overwrite").parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def follow(stream: DataFrame, path: str, checkpoint: str, days: int = 5) -> StreamingQuery:
    """Keeps the table at path up to date with a stream of corrections."""
    return stream.writeStream.foreachBatch(lambda batch, number: store(batch, path, number, days)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
