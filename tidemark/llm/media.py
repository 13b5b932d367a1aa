"""Media columns: bytes stored as lossless WebP images and read back, with features of their samples.

A payload is filled with bytes 0 to a positive multiple of 64 and lies in an image 16 pixels wide, 4 samples a pixel, or
of twice, four times ... that width where the image would otherwise be higher than the format allows; the image's last row
is filled with 0. Reading decodes the file and cuts the fill of the row off.

Nulls and odd rows: a null text is empty; equal texts make equal files; repeated rows and null ids are rows like any
other; an empty table gives an empty result. Payloads of over 1 GiB, more than a row can hold, have no image.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import others

UNIT = 64
#: Bytes of texts, beyond those of one batch, whose images are read side by side.
BYTES = 1 << 24


def store(payload: bytes) -> bytes:
    """The file of a payload, whose size is a multiple of UNIT."""
    pixels, width = len(payload) // 4, 16
    while -(-pixels // width) > webp.SIDE:
        width *= 2
    height = -(-pixels // width)
    return webp.encode(payload + bytes(4 * (width * height - pixels)), width, height)


def samples(files: list[bytes]) -> Iterator[np.ndarray]:
    """The samples of each file in the order of the payload."""
    for pixels in webp.decode_all(files):
        yield np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]].ravel()


def gathered(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches as large as can be read side by side, by the sizes in column n_bytes no larger than BYTES.

    A batch that alone is larger stays as it is.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        own = sum(batch.column(n_bytes).to_pylist())
        if held and (rows + batch.num_rows > webp.TOGETHER or size + own > BYTES):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + own
    if rows:
        yield pa.concat_batches(held)


def feature(x: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and share of the eight ranges of 32 values, of all samples."""
    counts = np.bincount(x, minlength=256)
    n = max(1, len(x))
    mean = counts @ np.arange(256) / n
    deviation = np.sqrt(max(0.0, counts @ np.arange(256) ** 2 / n - mean**2))
    p = counts[counts > 0] / n
    shares = " ".join(f"{1000 * c // n:d}" for c in counts.reshape(8, 32).sum(axis=1).tolist())
    return f"mean {mean:.3f} deviation {deviation:.3f} entropy {-(p * np.log2(p)).sum():.3f} ranges {shares}"


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media, the file, instead of the text."""
    keep = others(docs, text, "n_bytes", "media", *NAMES)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(len(keep)).to_pylist()]
            files = [store(t + bytes(-len(t) % UNIT if t else UNIT)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], [*keep, "n_bytes", "media"])

    own = docs.select(*keep, text)
    return own.mapInArrow(stored, own.drop(text).schema.add("n_bytes", "long").add("media", "binary"))


def read_back(stored: DataFrame) -> DataFrame:
    """stored, from with_media(), with what its files hold instead of them."""
    keep = [c for c in stored.columns if c != "media"]
    at = keep.index("n_bytes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, at):
            rows = []
            files = batch.column(len(keep)).to_pylist()
            for n, file, x in zip(batch.column(at).to_pylist(), files, samples(files), strict=True):
                x = x[: n + (-n % UNIT if n else UNIT)]
                data = x.tobytes()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(x)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keep, *NAMES])

    own = stored.select(*keep, "media")
    schema = own.drop("media").schema
    for name, kind in zip(NAMES, ("long", "string", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return own.mapInArrow(read, schema)


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
