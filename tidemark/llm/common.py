"""What the operators of this subpackage share: tables, checkpoints, labelled samples and sums over partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch. Texts can be long, so that batches stay short.
BATCH_ROWS = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in spark.checkpoint.dir.

    A local session, whose executors are the driver itself, may leave it unset: it then has a folder of its own. On a
    cluster an unset one is an error, since a folder of one machine would lose what another needs.
    """
    sc = spark.sparkContext
    if folder := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    from tempfile import mkdtemp

    sc.setCheckpointDir(mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder, so that lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def others(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of df but for those named, in upper or lower case."""
    names = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in names]


def packed_up(columns: list[str]) -> Column:
    """Columns as one struct named `kept`, in which no name of theirs can clash with one of an operator's own.

    With a field more, so that it has one if there are no columns.
    """
    more = "end"
    while more in {c.lower() for c in columns}:
        more += "_"
    return F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast("boolean").alias(more)).alias("kept")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"kept.`{c}`").alias(c) for c in columns]


def hot(counted: DataFrame, rows: int, n: str = "n") -> DataFrame:
    """Of keys and how many rows have them, those so frequent that they would hold up a task of a shuffle.

    At most 10,000 keys can have over a ten-thousandth of all rows: what joins with them can be broadcast.
    """
    return counted.where(F.col(n) > max(500, rows // 10_000))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from: crc32(doc_id) mod 5 is not 0, the label is 0 or 1.

    Of an id that is labelled repeatedly, y is the mean. At most `most` ids, those with the smallest hash: a uniform sample
    of a fixed greatest size, small enough to broadcast.
    """
    own = labels.select("doc_id", F.col(label).cast("double").alias("y"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & (remainder(F.col("doc_id"), 5) != 0))
    own = own.groupBy("doc_id").agg(F.avg("y").alias("y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def wider(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Vectors that a task of partition_sums adds up.
FAN = 64


def partition_sums(df: DataFrame, parts: Callable[[pa.RecordBatch], np.ndarray], width: int, wide: bool = False) -> np.ndarray:
    """Sum of parts(batch), vectors of `width` doubles, over all batches of all partitions.

    Each partition makes one vector; these are added up as a tree, `FAN` by one task, so that no task holds more, however
    many partitions there are; the driver gets one vector. df: read without a shuffle. wide: of short rows, many to a batch.
    """
    from pyspark import TaskContext

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in wider(batches) if wide else batches:
            if batch.num_rows:
                total += parts(batch)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        yield pa.RecordBatch.from_arrays([pa.array([part // FAN], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "v"])

    def added(own: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for v in own.column("v"):
            total += np.frombuffer(v.as_buffer())
        return pa.table({"g": pa.array([own.column("g")[0].as_py() // FAN], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    partitions = max(1, df.rdd.getNumPartitions())
    summed = df.mapInArrow(partial, "g int, v binary")
    for _ in range(max(1, math.ceil(math.log(partitions, FAN)))):
        summed = summed.groupBy("g").applyInArrow(added, "g int, v binary")
    total = np.zeros(width)
    for row in summed.collect():
        total += np.frombuffer(row["v"])
    return total


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's array column, all of `width` doubles, as rows of a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)
