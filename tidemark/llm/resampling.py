"""Importance resampling towards a target: features hashed into buckets, log ratios as gains, a draw by Gumbel's trick.

Words are lower-cased runs of letters, digits and characters beyond ASCII; features are all runs of 1 to `grams` words,
joined by one space, their bucket is their CRC-32 modulo `buckets`. Two passes over the texts in Arrow batches:

The first counts. Each partition adds its batches' np.bincount into one vector as long as there are buckets; treeReduce
merges the vectors, so that the driver gets one, however many partitions there are. The same for the target's texts.

Then each bucket has a gain, floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), and the second pass, with the
gains broadcast (a vector of fixed length), adds up each document's gains by np.bincount with weights: whole numbers in
doubles, exact below 2^53. A document's score is its weight plus floor(-1000 ln(-ln u)), u from a hash of its id.

The draw takes the highest scores among documents of enough words. Ranks are counted over a sort by range, each partition
numbering its rows and adding what lies before it; so no task sees all rows.

Nulls and odd rows: a null text has no features; a null id counts as the empty text in the hash and comes last in ties;
repeated rows are rows like any other, their ties in any order; an empty table gives an empty result. Columns of the
input are kept but for the text and those named like the result's.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, others, packed_up, unpacked
from .words import as_bytes, stretches

BUCKETS, GRAMS, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Features whose bucket a task remembers, the longest of them in bytes, and features that are counted at once.
REMEMBERED, LONGEST, AT_ONCE = 1 << 18, 64, 1 << 18


class Buckets(dict):
    """The bucket of a feature, remembered for the short ones that come first."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(self) < REMEMBERED and len(feature) <= LONGEST:
            self[feature] = bucket
        return bucket


def features(text: bytes | None, grams: int) -> Iterator[tuple[list[bytes], int]]:
    """A text's features stretch by stretch, with the number of the stretch's words."""
    held: list[bytes] = []  # the words before the stretch that its runs can begin with
    for words in stretches(text):
        found, k = list(words), len(words)
        words = held + words
        for n in range(2, grams + 1):
            first = max(0, len(held) - n + 1)
            found += [b" ".join(run) for run in zip(*(words[first + i :] for i in range(n)), strict=False)]
        held = words[len(words) - grams + 1 :] if grams > 1 else []
        yield found, k


def hashed(texts: list[bytes | None], of: Buckets, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the features of texts, the number of the text that each is of, and the words of each text, some at a time."""
    buckets: list[int] = []
    owners: list[int] = []
    counts: list[int] = []
    words = np.zeros(len(texts), dtype=np.int64)

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.array(buckets, dtype=np.int64), np.repeat(np.array(owners, dtype=np.int64), counts), words.copy()
        buckets.clear(), owners.clear(), counts.clear()
        words[:] = 0
        return out

    for i, text in enumerate(texts):
        for found, k in features(text, grams):
            buckets.extend(map(of.__getitem__, found))
            owners.append(i)
            counts.append(len(found))
            words[i] += k
            if len(buckets) >= AT_ONCE:
                yield flush()
    yield flush()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """How often each bucket's features are in the only column of texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(buckets, dtype=np.int64), Buckets(buckets)
        for batch in batches:
            for found, _, _ in hashed(as_bytes(batch.column(0)), of, grams):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = texts.mapInArrow(counted, "v binary").rdd.map(lambda row: np.frombuffer(row[0], dtype=np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, dtype=np.int64)
    return vectors.treeReduce(lambda a, b: a + b, depth=max(2, math.ceil(math.log(vectors.getNumPartitions() + 1, 32))))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, from how often it is in the source and in the target."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = ((float(t + 1) * float(all_source + n)) / (float(s + 1) * float(all_target + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """kept (the other columns), id, n_words, n_features, weight and score of every document."""
    columns = others(docs, text, "n_features", "weight", "score", "rank")
    own = docs.select(packed_up(columns), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("said"))
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, of = shared.value, Buckets(len(shared.value))
        for batch in batches:
            n = batch.num_rows
            words, count, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
            for found, owner, more in hashed(as_bytes(batch.column(2)), of, grams):
                words += more
                count += np.bincount(owner, minlength=n)
                weight += np.bincount(owner, weights=each[found], minlength=n)
            score = weight.astype(np.int64) + np.array([noise(i, seed) for i in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (words, count, weight.astype(np.int64), score))], KINDS)

    kinds = StructType([own.schema["kept"]])
    for c in KINDS[1:]:
        kinds = kinds.add(c, "long")
    return own.mapInArrow(added, kinds)


KINDS = ["kept", "id", "n_words", "n_features", "weight", "score"]


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with `place`, from 1, in a global order; written to the shared folder, so that a retry doesn't deal rows anew."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at + 1, at + n + 1))], [*batch.schema.names, "part", "no"])
            at += n

    done = cut(rows.orderBy(*order).mapInArrow(numbered, StructType(rows.schema.fields).add("part", "integer").add("no", "long")))
    sizes = sorted((r["part"], r["n"]) for r in done.groupBy("part").agg(F.max("no").alias("n")).collect())
    starts = np.concatenate(([0], np.cumsum([n for _, n in sizes])))
    offsets = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=False)], "part int, before long")
    return done.join(F.broadcast(offsets), "part").withColumn("place", F.col("no") + F.col("before")).drop("part", "no", "before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, least: int = LEAST, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """docs without the text, with n_features, weight, score and rank: 1, 2, 3... of the drawn ones, null for the others.

    target: texts in a column named as that of docs. Of the documents with `least` words or more, `percent` in 100 are drawn.
    """
    gain = gains(bucket_counts(docs.select(text), buckets, grams), bucket_counts(target.select(text), buckets, grams))
    scored = cut(weighed(docs, gain, grams, doc_id, text, seed))  # a sort by range reads its rows twice
    scored = scored.withColumn("apart", F.col("n_words") < least).withColumn("uid", F.monotonically_increasing_id())
    placed = ranked(scored, "apart", F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    drawn = placed.agg(F.count(F.when(~F.col("apart"), 1)).alias("n")).first()["n"] * percent // 100
    rank = F.when(~F.col("apart") & (F.col("place") <= drawn), F.col("place"))
    columns = others(docs, text, "n_features", "weight", "score", "rank")
    return placed.select(*unpacked(columns), "n_features", "weight", "score", rank.cast("long").alias("rank"))
