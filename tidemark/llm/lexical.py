"""Ranked lexical search: document-sharded postings in compressed sparse rows, with whole-number impacts.

Terms are lower-cased runs of letters, digits and characters beyond ASCII. A shard holds up to `SHARD` documents, their
ids, and for each term of the items that it has a run of postings: the document's place in the shard and the term's
count. Counts of terms, documents and words are added up over all shards as a tree; with these each posting's count
becomes its impact, w ((10^9 tf) div (1000 tf + 8 m)), in 64-bit integers, m = 100 - b + (b n N) div L.

A shard is searched term at a time: an item's terms add their impacts, read off their runs, into a dense vector of the
shard's documents. Of these the k best are selected by partition, ties at the last place by the smallest ids; a task
merges its shards' k best, and a grouping by item the tasks'.

The items are the queries: they are dealt into blocks of about `TERMS` terms (the longest item's, if it has more) that
the driver sends to every task, and each block is searched in all documents.

Nulls and odd rows: a null text has no terms, and a document without terms isn't counted; rows of one item_id are one
item, a null item_id too; a null doc_id comes after all others in ties; repeated rows are documents like any other and may
all be found; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partition_sums
from .words import as_bytes, stretches

#: Documents and postings of a shard, terms of a block of items, results of an item.
SHARD, POSTINGS, TERMS, K = 1 << 14, 1 << 21, 1 << 17, 10
#: Share of a document's length in its m, in hundredths.
LENGTH = 90
SHARDS = "ids array<long>, lengths array<long>, terms array<int>, starts array<int>, docs array<int>, counts array<long>"
KINDS = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
LAST = np.iinfo(np.int64).max


def postings(docs: DataFrame, terms: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of docs with the counts of `terms`. lengths: all terms of a document, those without postings too."""
    known = docs.sparkSession.sparkContext.broadcast(terms)
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("said"))

    def shard(ids: list, lengths: list[int], found: list[Counter]) -> pa.RecordBatch:
        each = np.array([len(c) for c in found], dtype=np.int64)
        place = np.repeat(np.arange(len(found), dtype=np.int32), each)
        term = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(each.sum()))
        count = np.fromiter(chain.from_iterable(c.values() for c in found), dtype=np.int64, count=len(term))
        order = np.lexsort((place, term))
        term, place, count = term[order], place[order], count[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        values = [ids, lengths, term[first], np.append(first, len(term)).astype(np.int32), place, count]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, KINDS, strict=True)], schema=KINDS)

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        ids: list = []
        lengths: list[int] = []
        found: list[Counter] = []
        n = 0
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                length, counts = 0, Counter()
                for words in stretches(data):
                    length += len(words)
                    counts.update(map(number.get, words, repeat(-1)))
                counts.pop(-1, None)
                if length:
                    ids.append(i), lengths.append(length), found.append(counts)
                    n += len(counts)
                if len(ids) >= SHARD or n >= POSTINGS:
                    yield shard(ids, lengths, found)
                    ids, lengths, found, n = [], [], [], 0
        if ids:
            yield shard(ids, lengths, found)

    return own.mapInArrow(sharded, SHARDS)


def totals(shards: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """In how many documents each term is, the number of documents with terms, and of all terms with repeats."""

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(terms + 2)
        for row in range(batch.num_rows):
            lengths, present, starts = (batch.column(k)[row].values.to_numpy() for k in (1, 2, 3))
            out[present] += np.diff(starts)
            out[-2:] += len(lengths), lengths.sum()
        return out

    total = partition_sums(shards, parts, terms + 2)
    return total[:-2].astype(np.int64), int(total[-2]), int(total[-1])


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(lengths: np.ndarray, runs: np.ndarray, docs: np.ndarray, counts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Each posting's impact. runs: its term's weight."""
    m = np.array([100 - LENGTH + (LENGTH * x * n) // words for x in lengths.tolist()], dtype=np.int64)  # of any size before the division
    return runs * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[docs]))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, highest first, ties by the smaller id: also those at the last place."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        own = scores[found]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
        above, level = found[own > least], found[own == least]
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        found = np.concatenate((above, level))
    return found[np.lexsort((ids[found], -scores[found]))]


def searched(shards: DataFrame, items: list[np.ndarray], df: np.ndarray, n: int, words: int, k: int = K) -> DataFrame:
    """item (its place in items), score and doc_id of each task's k best documents. items: the terms of each, once each."""
    shared = shards.sparkSession.sparkContext.broadcast((items, term_weights(df, n)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2] * len(asked)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, starts, docs, counts = (batch.column(c)[row].values for c in range(6))
                ids, (lengths, terms, starts, docs, counts) = ids.fill_null(LAST).to_numpy(), (a.to_numpy() for a in (lengths, terms, starts, docs, counts))
                impact = impacts(lengths, np.repeat(weight[terms], np.diff(starts)), docs, counts, n, words)
                run = np.full(len(weight), -1, dtype=np.int64)
                run[terms] = np.arange(len(terms))
                total = np.zeros(len(ids), dtype=np.int64)
                for i, own in enumerate(asked):
                    total[:] = 0
                    for r in run[own]:
                        if r >= 0:
                            total[docs[starts[r] : starts[r + 1]]] += impact[starts[r] : starts[r + 1]]
                    found = best(total, ids, k)
                    if len(found):
                        both, named = np.concatenate((top[i][0], total[found])), np.concatenate((top[i][1], ids[found]))
                        first = best(both, named, k)
                        top[i] = both[first], named[first]
        item = np.repeat(np.arange(len(asked), dtype=np.int32), [len(s) for s, _ in top])
        scores, named = (np.concatenate([t[c] for t in top]) if top else np.zeros(0, dtype=np.int64) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(scores), pa.array(named, mask=named == LAST)], ["item", "score", "doc_id"])

    return shards.mapInArrow(search, "item int, score long, doc_id long")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term) of all items, once each."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(as_bytes(batch.column(1))):
                for words in stretches(data):
                    own = list(set(words))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(own), pa.int64())), pa.array(own, pa.binary())], ["item_id", "term"])

    own = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("said"))
    return own.mapInArrow(cut_up, own.drop("said").schema.add("term", "binary")).distinct()


def rank(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank from 1, doc_id and score of the k best documents above 0 of each item."""
    spark = docs.sparkSession
    asked = cut(item_terms(items, item_id, item_text))
    blocks = max(1, -(-asked.count() // TERMS))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    found: DataFrame | None = None
    for block in range(blocks):
        pairs = dealt.where(F.col("block") == block).select("item_id", "term").toArrow()
        terms = {t: i for i, t in enumerate(sorted(set(pairs.column("term").to_pylist())))}
        own: dict[object, list[int]] = {}
        for item, term in zip(pairs.column("item_id").to_pylist(), pairs.column("term").to_pylist(), strict=True):
            own.setdefault(item, []).append(terms[term])
        shards = cut(postings(docs, terms, doc_id, text))
        df, n, words = totals(shards, len(terms))
        tops = searched(shards, [np.array(sorted(t), dtype=np.int64) for t in own.values()], df, n, words, k)
        names = spark.createDataFrame(list(enumerate(own)), asked.select(F.lit(0).alias("item"), "item_id").schema)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        tops = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        tops = tops.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = tops if found is None else found.unionByName(tops)
    return found
