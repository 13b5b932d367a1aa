"""Exact duplicates by a minimal perfect hash over the distinct digests of what came before.

A text's digest is the SHA-256 of its UTF-8 without white space (space and the controls 9 to 13). The distinct digests of
the history are dealt into shards by their first bits. A shard holds a minimal perfect hash of its digests (levels of
bits: a digest takes the first level in which its place is nobody else's, and its slot is the rank of that bit) and, by
slot, the full digest, the locator of the row that stays (its id, batch and number) and how many rows have the text.

A batch of arrivals is first grouped by digest, which merges before the shuffle. Its digests are then looked up in their
shard: a slot counts only if its digest is equal byte by byte. Found digests update their slot (a better row takes it
over), the others are grouped apart and become the next generation of the shard. At last every row looks up its text in
the shard's generations, and so learns which row stays and how many there are; the rows of a shard are dealt into parts,
each with a copy of the shard, so that a text that a third of all rows have isn't one task's.

Of equal texts the row with the most code points stays, then that with the smallest id.

Nulls and odd rows: a null text is empty; texts without anything but white space are equal; a null id comes last; of rows
that agree in id and code points, that with the smaller hash of its text stays, then the earlier batch, and of rows that
agree in everything, one; an empty table gives an empty result. Columns of the input are kept but for the text and those
named like the result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, others, packed_up, unpacked

SPACE = r"[\x20\x09-\x0D]+"
#: Distinct digests of a shard of the history (more, beyond the greatest number of shards), and rows of a part of a look-up.
DIGESTS, MOST_SHARDS, ROWS = 2048, 1 << 20, 4096
#: Bits of a level for each digest that is left.
GAMMA = 2.0
#: A slot's record beside its digest: code points, then what breaks ties, and the number of rows.
RECORD = ("chars", "none", "id", "tie", "batch", "uid", "n")
INDEX = "shard int, generation int, sizes array<int>, bits binary, digests binary, records binary"


def place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest, a row of four numbers, goes among a level's `size` bits."""
    h = digests[:, level % 4] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The sizes of the levels and all their bits, of distinct digests."""
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    left = digests
    while len(left):
        at = place(left, len(sizes), size := max(16, int(GAMMA * len(left))))
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


def slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Each digest's slot; for one that isn't a member, any slot or -1."""
    rank, out, left, start = np.cumsum(bits), np.full(len(digests), -1, dtype=np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = place(digests[left], level, size) + start
        hit = bits[at]
        out[left[hit]] = rank[at[hit]] - 1
        left, start = left[~hit], start + size
    return out


def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the row of record a stays rather than that of b: more code points, then what comes first."""
    less, same = a[:, 0] > b[:, 0], a[:, 0] == b[:, 0]
    for k in range(1, 6):
        less |= same & (a[:, k] < b[:, k])
        same &= a[:, k] == b[:, k]
    return less


def unfold(column: pa.ChunkedArray) -> np.ndarray:
    """Digests of 32 bytes as rows of four numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)


class Generation:
    """One generation of a shard: its perfect hash, digests and records by slot."""

    def __init__(self, number: int, sizes: list[int], bits: np.ndarray, digests: np.ndarray, records: np.ndarray) -> None:
        self.number, self.sizes, self.bits, self.digests, self.records = number, sizes, bits, digests, records

    @classmethod
    def of(cls, number: int, digests: np.ndarray, records: np.ndarray) -> Generation:
        sizes, bits = perfect_hash(digests)
        order = np.argsort(slots(digests, sizes, bits))
        return cls(number, sizes, bits, digests[order], records[order])

    @classmethod
    def read(cls, row: dict) -> Generation:
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8))[: sum(row["sizes"])].astype(bool)
        records = np.frombuffer(row["records"], dtype=np.int64).reshape(-1, len(RECORD)).copy()
        return cls(row["generation"], row["sizes"], bits, np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4), records)

    def row(self, shard: int) -> dict:
        return {"shard": shard, "generation": self.number, "sizes": self.sizes, "bits": np.packbits(self.bits).tobytes(), "digests": self.digests.tobytes(), "records": self.records.tobytes()}

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slots of digests that are members, byte by byte; -1 for the others."""
        at = slots(digests, self.sizes, self.bits)
        own = at >= 0
        own[own] = (self.digests[at[own]] == digests[own]).all(axis=1)
        return np.where(own, at, -1)


def digested(docs: DataFrame, batch: Column, doc_id: str = "doc_id", text: str = "text", taken: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their digest and record, and their other columns packed up; written to the shared folder once.

    batch: the number of the batch that a row came with. taken: columns that aren't kept besides the text.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(packed_up(others(docs, text, *taken)), F.col(doc_id).cast("long").alias("id"), said.alias("said"), F.coalesce(batch.cast("long"), F.lit(0)).alias("batch"))
    digest = F.unhex(F.sha2(F.regexp_replace("said", SPACE, ""), 256))
    return cut(own.select("kept", digest.alias("digest"), F.length("said").cast("long").alias("chars"), F.col("id").isNull().cast("long").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("said").alias("tie"), "batch", F.monotonically_increasing_id().alias("uid")))


def grouped(rows: DataFrame) -> DataFrame:
    """Each distinct digest with the record of its row that stays and its number of rows."""
    best = F.min(F.struct((-F.col("chars")).alias("fewer"), *RECORD[1:6])).alias("w")
    return rows.groupBy("digest").agg(best, F.count("*").alias("n")).select("digest", (-F.col("w.fewer")).alias("chars"), *[F.col(f"w.{c}").alias(c) for c in RECORD[1:6]], "n")


def shard_of(digest: Column, shards: int) -> Column:
    """The shard by the digest's last 60 bits, which its hash doesn't use alone."""
    return F.pmod(F.conv(F.hex(F.substring(digest, -7, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def history_index(groups: DataFrame, shards: int) -> DataFrame:
    """The first generation of each shard's index, of grouped() rows."""
    return extended(groups.sparkSession.createDataFrame([], INDEX), groups, shards)


def extended(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """The index after a batch: its groups merged into the slots of the digests that are members, the others a new generation."""

    def update(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        generations = sorted((Generation.read(r) for r in old.to_pylist()), key=lambda g: g.number)
        digests = unfold(new.column("digest"))
        records = np.column_stack([new.column(c).to_numpy() for c in RECORD]).reshape(-1, len(RECORD))
        for g in generations:
            at = g.find(digests)
            mine = at >= 0
            was, now = g.records[at[mine]], records[mine]
            g.records[at[mine]] = np.column_stack((np.where(before(now, was)[:, None], now[:, :6], was[:, :6]), was[:, 6] + now[:, 6]))
            digests, records = digests[~mine], records[~mine]
        if len(digests):
            generations.append(Generation.of(len(generations), digests, records))
        return pa.Table.from_pylist([g.row(shard) for g in generations], schema=KINDS)

    sharded = groups.withColumn("shard", shard_of(F.col("digest"), shards))
    return index.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(update, INDEX)


KINDS = pa.schema([("shard", pa.int32()), ("generation", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("digests", pa.binary()), ("records", pa.binary())])


def looked_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """kept, digest, keep_id, group_size and stays of every row, by look-ups in the index, which has to hold all of them."""
    rows = rows.withColumn("shard", shard_of(F.col("digest"), shards))
    held = index.groupBy("shard").agg(F.sum(F.length("digests") / 32).alias("held"))
    dealing = rows.groupBy("shard").agg(F.count("*").alias("n")).join(held, "shard", "left")
    dealing = F.broadcast(dealing.select("shard", F.ceil(F.col("n") / F.greatest(F.lit(ROWS), 2 * F.coalesce("held", F.lit(0)))).cast("int").alias("parts")))
    asked = rows.join(dealing, "shard").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    copies = index.join(dealing, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kinds = StructType([rows.schema["kept"], rows.schema["digest"]]).add("keep_id", "long").add("group_size", "long").add("stays", "boolean")

    def answer(asked: pa.Table, old: pa.Table) -> pa.Table:
        digests, n = unfold(asked.column("digest")), asked.num_rows
        records = np.zeros((n, len(RECORD)), dtype=np.int64)
        for row in old.to_pylist():
            g = Generation.read(row)
            at = g.find(digests)
            records[at >= 0] = g.records[at[at >= 0]]
        own = np.column_stack([asked.column(c).to_numpy() for c in ("batch", "uid")]).reshape(-1, 2)
        keep = pa.array(records[:, 2], pa.int64(), mask=records[:, 1] != 0)
        return pa.table([asked.column("kept"), asked.column("digest"), keep, pa.array(records[:, 6]), pa.array((records[:, 4:6] == own).all(axis=1))], names=["kept", "digest", "keep_id", "group_size", "stays"])

    return asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(answer, kinds)


def dedup(docs: DataFrame, batch: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with keep_id, group_size, kept and text_sha256.

    batch: 0 for rows of the history, 1 for arrivals. The index of the history is built first; arrivals are looked up in it.
    """
    columns = others(docs, text, "keep_id", "group_size", "kept", "text_sha256")
    rows = digested(docs, batch, doc_id, text, ("keep_id", "group_size", "kept", "text_sha256"))
    history = cut(grouped(rows.where("batch = 0")))
    shards = min(MOST_SHARDS, max(1, -(-history.count() // DIGESTS)))
    index = cut(extended(history_index(history, shards), grouped(rows.where("batch <> 0")), shards))
    found = looked_up(rows, index, shards)
    return found.select(*unpacked(columns), "keep_id", "group_size", F.col("stays").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

