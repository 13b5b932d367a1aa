"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a whole text are standardised and mapped to `FEATURES` random cosines, whose inner products approximate a
Gaussian kernel. Normal equations, summed over partitions, give ridge scores; a step curve that never falls, fitted to
other labelled rows, turns scores into chances.

Labels are learnt from a uniform sample of at most `LABELLED` labelled documents that may be learnt from, chosen by a hash
of their ids: four fifths for the scores, the rest for the curve. All documents are scored.

Nulls and odd rows: a null text counts as empty, a null id as not held out only if its hash says so; without labels every
score is 0.5; with labels of one kind it is that kind's smoothed share; an empty table gives an empty result. Columns of
the input are kept but for the text and those named score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, matrix, others, packed_up, training_labels, unpacked
from .linear import isotonic, moments, normal_equations

LABELLED, FEATURES, RIDGE, BINS, SEED = 60_000, 192, 1e-3, 512, 5
UPPER, LOWER, DIGITS = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
STOPS, EXCLAIM, SYMBOLS = b".,;:'\"-()", b"!?", b"#$%&*|<>{}[]=+~^_@\\/"
#: Number of statistics().
WIDTH = 18


def statistics(text: str | None) -> list[float]:
    """Sizes, shares of kinds of characters, repetition and line shapes of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, size = data.split(), max(1, len(data))
    n = max(1, len(words))
    share = lambda kind: (len(data) - len(data.translate(None, kind))) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower, other = share(UPPER), share(LOWER), len(data.translate(None, bytes(range(128)))) / size
    packed = len(zlib.compress(data, 1)) / (size + 20)
    distinct = set(words)
    return [
        np.log1p(len(words)), np.log1p(len(data)), len(b"".join(words)) / n / 10, len(distinct) / n, sum(map(len, distinct)) / max(1, len(distinct)) / 10, upper, lower, other, share(DIGITS), share(STOPS), share(EXCLAIM), share(SYMBOLS),
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))), np.log1p(max(map(len, words), default=0)), packed, upper / (upper + lower + 1e-9),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics instead of the text."""
    keep = [c for c in docs.columns if c not in (text, "statistics")]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(len(keep)).to_pylist()], dtype=np.float32).reshape(-1, WIDTH)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*keep, "statistics"])

    own = docs.select(*keep, text)
    return own.mapInArrow(measured, own.drop(text).schema.add("statistics", T.ArrayType(T.FloatType())))


def fourier(mean: np.ndarray, deviation: np.ndarray, seed: int = SEED, out: int = FEATURES):
    """The map from statistics to random cosines and a constant, for a kernel as wide as the square root of their number."""
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(size=(len(mean), out - 1)) / np.sqrt(len(mean)) * 0.8, rng.uniform(0, 2 * np.pi, out - 1)

    def project(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / deviation, -6, 6)
        return np.hstack((np.sqrt(2 / out) * np.cos(z @ turn + shift), np.ones((len(x), 1))))

    return project


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their text, with score: the chance that the label is 1. labels: doc_id and the label."""
    keep = others(docs, text, "score")
    measured = cut(with_statistics(docs.select(F.col(doc_id).alias("i"), packed_up(keep), F.col(text).cast("string").alias("text"))))
    sample = training_labels(labels, label, LABELLED).select(F.col("doc_id").alias("label_id"), "y")
    learnt = cut(measured.join(F.broadcast(sample), F.col("i") == F.col("label_id")).select("statistics", "y", (F.pmod(F.xxhash64("label_id"), F.lit(5)) == 0).alias("curve")))
    _, mean, deviation = moments(measured.select("statistics"), WIDTH)
    project = fourier(mean, deviation)
    gram, by, middle, n = normal_equations(learnt.where("not curve").select("statistics", "y"), project, WIDTH, FEATURES)
    w = np.linalg.solve(gram + RIDGE * max(n, 1.0) / FEATURES * np.eye(FEATURES), by) if n else np.zeros(FEATURES)
    raw = lambda x: np.clip(middle + project(x) @ w, -0.5, 1.5)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.minimum((raw(matrix(batch.column(0), WIDTH)) + 0.5) / 2 * BINS, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["at", "y"])

    bins = learnt.where("curve").select("statistics", "y").mapInArrow(ranked, "at int, y double").groupBy("at").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    found = sorted(bins.collect(), key=lambda r: r["at"])
    if found and n:
        # a pseudo-row at each end keeps chances off 0 and 1
        x = np.array([-0.5, *((r["at"] + 0.5) / BINS * 2 - 0.5 for r in found), 1.5])
        knots, heights = isotonic(x, np.array([0.0, *(r["y"] for r in found), 1.0]), np.array([0.5, *(float(r["n"]) for r in found), 0.5]))
    else:
        knots, heights = np.array([0.0, 1.0]), np.array([middle, middle]) if n else np.array([0.5, 0.5])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), WIDTH)
            s = np.interp(raw(x), knots, heights) if n else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(s, 0.0, 1.0))], ["kept", "score"])

    own = measured.select("kept", "statistics")
    return own.mapInArrow(scored, own.drop("statistics").schema.add("score", "double")).select(*unpacked(keep), "score")
