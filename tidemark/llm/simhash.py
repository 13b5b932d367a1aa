"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by BK-trees over shards.

Fingerprint: A-Z lower-cased, words joined by one space, every run of four words (all words, if fewer) hashed by XXH64 of
its UTF-8 bytes with seed 42; a bit is 1 if it is set in over half of the hashes. No words or a null text: 0.

Links: of k blocks of a fingerprint's bits, two fingerprints within the radius agree in at least k - radius. Each choice
of k - radius blocks is a table, each value of their bits a shard. A shard's fingerprints are dealt into chunks of at
most `CHUNK`; every chunk becomes a BK-tree, whose children are keyed by their integer distance to the parent, and each
chunk of the shard searches it, following only edges within the radius. The shards' trees are broadcast while they hold at
most `BROADCAST` fingerprints, counted beforehand; since they grow with the corpus, larger ones meet their queries by a
shuffle on the shard's key, with the same links. k follows the number of fingerprints, so
that shards stay small; every choice of k finds all links.

Components: by alternating star contractions of the links, each round a few groupings, until nothing changes.

Nulls and odd rows: a null text is like an empty one; rows without words link with each other; rows with a null or
repeated id are rows like any other, and a component is named by its smallest id that is not null. An empty table gives an
empty result. Columns of the input are kept but for those named fingerprint and component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot, others, packed_up, unpacked

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Most fingerprints of a BK-tree, and the mean size of a shard that the number of blocks is chosen for.
CHUNK, SHARD = 512, 64
#: Most fingerprints of trees that are broadcast, eight bytes each; beyond, trees and queries meet by a shuffle.
BROADCAST = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    h = np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):  # bounded memory for the longest texts
        counts += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text, if None) and fp, the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c not in (text, "fp")] if keep is None else keep
    own = docs.select(*keep, F.col(text).alias("fp"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*keep, "fp"])

    kinds = own.drop("fp").schema.add("fp", "long")
    return own.mapInArrow(hashed, kinds)


class BKTree:
    """Fingerprints by distance: a node's child at distance d holds all further fingerprints that are d from the node."""

    def __init__(self, values: list[int]) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
        node = self.root
        while (d := (node ^ value).bit_count()) > 0:
            below = self.children[node]
            if d not in below:
                below[d] = value
                self.children[value] = {}
                return
            node = below[d]

    def within(self, value: int, radius: int) -> list[int]:
        """All members at most `radius` from value, by edges d - radius to d + radius only."""
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if below := self.children[node]:
                todo += [c for e, c in below.items() if d - radius <= e <= d + radius]
        return found


def blocks(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks for which a shard holds SHARD of n fingerprints on average."""
    k = radius + 1
    while k < radius + 4 and n >> (64 * (k - radius) // k) > SHARD:
        k += 1
    return k


def shard_keys(fp: Column, k: int, radius: int = RADIUS) -> Column:
    """An array of (table, value): the bits of each choice of k - radius of k blocks."""
    edges = [64 * i // k for i in range(k + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(k), k - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(signed)])


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: links of distinct fingerprints `fp`, enough of them to connect whatever is connected.

    Within a pair of chunks only links that join two parts not joined yet are given.
    """
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), blocks(n, radius), radius)).alias("k")).select("fp", "k.t", "k.v")
    sizes = keyed.groupBy("t", "v").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    dense = sizes.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    chunked = keyed.join(dense, ["t", "v"]).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    parts = chunked.groupBy("t", "v", "c").agg(F.collect_list("fp").alias("own"))
    other = parts.select("t", "v", F.col("c").alias("d"), F.col("own").alias("tree"))
    held = dense.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    trees = F.broadcast(other) if held <= BROADCAST else other.hint("merge")
    pairs = parts.join(trees, ["t", "v"]).where(F.col("c") <= F.col("d")).select("own", "tree", (F.col("c") == F.col("d")).alias("same"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for own, tree, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parent: dict[int, int] = {}

                def root(x: int, parent: dict[int, int] = parent) -> int:
                    while (p := parent.setdefault(x, x)) != x:
                        parent[x] = parent[p]
                        x = parent[x]
                    return x

                grown = BKTree([] if same else sorted(x & (1 << 64) - 1 for x in tree))
                for value in sorted(x & (1 << 64) - 1 for x in own):
                    for near in grown.within(value, radius):
                        r, q = root(value), root(near)
                        if r != q:
                            parent[max(r, q)] = min(r, q)
                            a.append(min(value, near))
                            b.append(max(value, near))
                    if same:
                        grown.add(value)
            to = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([to(a), to(b)], ["a", "b"])

    return pairs.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b) one node of its component, the same for all of them.

    Large-star and small-star by turns: each node's larger neighbours go to its smallest, then its smaller ones do.
    """

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("a", "b").union(df.select(F.col("b"), F.col("a"))) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def sums(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    seen = sums(now)
    while seen[0]:
        now = cut(star(star(now, True), False))
        was, seen = seen, sums(now)
        if was == seen:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows without their text, with fp (signed), fingerprint (16 hex digits) and component_id."""
    keep = others(docs, text, "fp", "fingerprint", "component_id")
    hashed = cut(with_fingerprints(docs, text, keep))
    fps = cut(hashed.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("n")))
    found = cut(components(links(fps, fps.count(), radius)))
    named = fps.join(found.union(found.select(F.col("root"), F.col("root")).distinct()), F.col("fp") == F.col("node")).groupBy("root").agg(F.min("least").alias("component"))
    linked = found.union(found.select(F.col("root"), F.col("root")).distinct()).join(named, "root").select(F.col("node").alias("fp"), "component")
    by_fp = cut(fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id")))
    # rows of frequent fingerprints meet their component by a broadcast of at most 10,000, the others by a shuffle
    rows = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.broadcast(hot(by_fp, rows).select("fp", F.col("component_id").alias("component"), F.lit(True).alias("frequent")))
    marked = hashed.select("fp", packed_up(keep)).join(often, "fp", "left")
    one = marked.where("frequent").select("fp", "kept", F.col("component").alias("component_id"))
    two = marked.where("frequent is null").select("fp", "kept").join(by_fp.select("fp", "component_id"), "fp")
    return one.unionByName(two).select(*unpacked(keep), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
