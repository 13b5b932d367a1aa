"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt into shards by a hash of their ids and lie end to end there in a seeded order; every
`BLOCK` words are a block. The blocks of the mix go to the sources by highest quotients weight / (2 seats + 1), then in
the same way to each source's shards by their sizes: an integer quota for each shard, never above `MOST` times its
blocks. A shard of m blocks and quota q takes every block q // m times, and q % m of them once more, chosen by an evenly
spread pattern with a seeded start. Whether a block is taken is arithmetic on its number, so that no row is made for a
block, and a document's share is a closed form of its place.

Nulls and odd rows: a null text has size 0; null is a source of its own, sorted last; null and repeated ids are rows
like any other; a source without words takes nothing; an empty table gives an empty result. Columns of the input named
like the result's are replaced.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, others, packed_up, unpacked, word_count

#: Words of a block, and words of a shard before there are `SHARDS` in all.
BLOCK, SHARD = 16, 32_768
#: Greatest number of shards of all sources together: bounds what the driver apportions and what is broadcast.
SHARDS = 1 << 17
#: Weights of the sources in order, repeating, and how often a text may be repeated.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
SEED = 20_011


def apportion(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Sainte-Laguë: `seats` given one by one to the highest weight / (2 held + 1) among those below their cap.

    Starts from rounded-down shares rather than from 0 and then moves seats until no quotient not served is above one
    served, which is the same result in steps that grow with len(weights), not with seats.
    """
    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    held = [min(c, int(x)) for c, x in zip(caps, fill(weights, [float(c) for c in caps], float(seats)), strict=True)]
    nxt = [(-w / (2 * h + 1), i) for i, (w, h, c) in enumerate(zip(weights, held, caps, strict=True)) if h < c and w > 0]
    last = [(w / (2 * h - 1), -i) for i, (w, h) in enumerate(zip(weights, held, strict=True)) if h > 0]
    heapq.heapify(nxt)
    heapq.heapify(last)

    def current(heap: list, quotient) -> tuple | None:
        while heap and quotient(abs(heap[0][1])) != heap[0][0]:
            heapq.heappop(heap)
        return heap[0] if heap else None

    up = lambda i: -weights[i] / (2 * held[i] + 1) if held[i] < caps[i] else None
    down = lambda i: weights[i] / (2 * held[i] - 1) if held[i] > 0 else None

    def change(i: int, by: int) -> None:
        held[i] += by
        if up(i) is not None and weights[i] > 0:
            heapq.heappush(nxt, (up(i), i))
        if down(i) is not None:
            heapq.heappush(last, (down(i), -i))

    given = sum(held)
    while given < seats and (top := current(nxt, up)):
        change(top[1], 1)
        given += 1
    while (top := current(nxt, up)) and (low := current(last, down)) and -top[0] > low[0]:
        change(-low[1], -1)
        change(top[1], 1)
    return held


def fill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """`total` shared by weight; a share stops at its cap, and the excess is shared again until none is above."""
    shares, open_, left = [0.0] * len(caps), [i for i, w in enumerate(weights) if w > 0], total
    while open_ and left > 0:
        by = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / by >= caps[i]]
        if not over:
            for i in open_:
                shares[i] = left * weights[i] / by
            break
        for i in over:
            shares[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return shares


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _before(j: Column, p: Column) -> Column:
    """Of a shard's blocks before block j, counted from its seeded turn: those that are taken once more than the others."""
    return _div((j + p["turn"]) * (p["quota"] % p["blocks"]), p["blocks"])


def _taken(p: Column, size: Column) -> Column:
    """Words that the mix takes of a document that lies at place p."""
    block = F.lit(BLOCK).cast("long")
    end = p["start"] + size
    first, last = _div(p["start"], block), _div(F.greatest(end - 1, F.lit(0)), block)
    one = lambda j: _before(j + 1, p) - _before(j, p)
    head = one(first) * (F.least((first + 1) * block, end) - p["start"])
    rest = (_before(last, p) - _before(first + 1, p)) * block + one(last) * (end - last * block)
    return F.when(size > 0, size * _div(p["quota"], p["blocks"]) + head + F.when(last > first, rest).otherwise(0)).otherwise(0).cast("long")


def mix(docs: DataFrame, sized: Column | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target (its source's), taken, and mix_place: where the document lies and its shard's quota.

    sized: the expression of a document's size; its words, if None. The driver gets one row for each source and shard.
    """
    sized = word_count(F.col(text)) if sized is None else sized
    columns = others(docs, "size", "source_size", "target", "taken", "mix_place")
    rows = docs.select(packed_up(columns), F.col(doc_id).alias("i"), F.col(source).cast("string").alias("o"), F.coalesce(sized, F.lit(0)).cast("long").alias("size"))
    slim = cut(rows.select("i", "o", "size"))
    spark = docs.sparkSession
    found = slim.groupBy("o").agg(F.sum("size").alias("n")).collect()
    found = sorted(((r["o"], r["n"] or 0) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    total = sum(n for _, n in found)
    by = [weights[k % len(weights)] for k in range(len(found))]
    targets = fill(by, [float(MOST * n) for _, n in found], float(total))
    shards = [max(1, min(math.ceil(n / SHARD), SHARDS * n // max(total, 1))) for _, n in found]
    kinds = spark.createDataFrame([(s, k, n, t, c) for k, ((s, n), t, c) in enumerate(zip(found, targets, shards, strict=True))], "mix_of string, mix_no int, source_size long, target double, mix_shards int")
    hashed = lambda c: F.xxhash64(F.lit(seed), c)

    def dealt(df: DataFrame) -> DataFrame:
        own = df.withColumn("mix_hash", hashed(F.col("i")))
        own = own.join(F.broadcast(kinds), F.col("o").eqNullSafe(F.col("mix_of")), "inner").drop("mix_of")
        return own.withColumn("mix_shard", F.pmod(F.shiftright("mix_hash", 8), F.col("mix_shards")).cast("int"))

    sizes = dealt(slim).groupBy("mix_no", "mix_shard").agg(F.sum("size").alias("n")).collect()
    each: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(sizes):
        each.setdefault(r["mix_no"], []).append((r["mix_shard"], r["n"]))
    blocks = [sum(-(-n // BLOCK) for _, n in each.get(k, [])) for k in range(len(found))]
    caps = [MOST * b for b in blocks]
    # a source that stops at its cap takes all its blocks MOST times; the others share the rest by highest quotients
    full = [t >= MOST * n for t, (_, n) in zip(targets, found, strict=True)]
    left = total - sum(MOST * n for f, (_, n) in zip(full, found, strict=True) if f)
    rest = apportion([0.0 if f else w for f, w in zip(full, by, strict=True)], caps, round(left / BLOCK))
    quotas = []
    for k, own in each.items():
        most = [MOST * -(-n // BLOCK) for _, n in own]
        got = most if full[k] else apportion([float(n) for _, n in own], most, rest[k])
        quotas += [(k, s, max(1, -(-n // BLOCK)), q) for (s, n), q in zip(own, got, strict=True)]
    quota = spark.createDataFrame(quotas, "mix_no int, mix_shard int, m long, q long")
    order = Window.partitionBy("mix_no", "mix_shard").orderBy("mix_hash", "i", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    # rows of one id and size are told apart by all that they hold, so that a rerun lays them alike
    placed = dealt(rows).withColumn("tie", F.xxhash64(F.to_json("kept") if "map<" in rows.schema["kept"].dataType.simpleString() else F.col("kept"))).withColumn("mix_start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(F.broadcast(quota), ["mix_no", "mix_shard"], "inner")
    turn = F.pmod(F.xxhash64(F.lit(seed), "mix_no", "mix_shard"), F.col("m"))
    place = F.struct(F.col("mix_start").alias("start"), F.col("m").alias("blocks"), F.col("q").alias("quota"), turn.alias("turn"), F.col("mix_no").alias("source_no"), F.col("mix_shard").alias("shard"))
    placed = placed.select("kept", "size", "source_size", "target", place.alias("mix_place"))
    return placed.select(*unpacked(columns), "size", "source_size", "target", _taken(F.col("mix_place"), F.col("size")).alias("taken"), "mix_place")


def texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each whole repetition of a text, and one of the words that are taken once more, if any."""
    p, size = F.col("mix_place"), F.col("size")
    whole = _div(p["quota"], p["blocks"]).cast("int")
    number = lambda i: _div(p["start"] + i, F.lit(BLOCK).cast("long"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.filter(words, lambda w, i: _before(number(i) + 1, p) > _before(number(i), p)), " ")
    more = F.when(F.col("taken") == size * (whole + 1), F.array(F.col(text))).when(F.col("taken") > size * whole, F.array(part))
    copies = F.concat(F.array_repeat(F.col(text), whole), F.coalesce(more, F.array().cast("array<string>")))
    return mixed.where(F.col("taken") > 0).withColumn(text, F.explode(copies))
