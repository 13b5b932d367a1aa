"""Packing documents into sequences by bin completion, a branch-and-bound search over fillings of one bin.

Lengths are whole numbers up to the capacity, so that a histogram of them, at most `capacity` counts, says all that the
search needs, however many pieces there are. The driver fills bins around the largest length left. Best fit's filling is
the incumbent; where it wastes something, branches by the largest lengths first are pruned by an exact bound, the sums
that the smaller lengths can still make, so that the filling found has the least waste of all and the largest lengths
among those. It is used as often as its scarcest length allows, so that one search fills many bins. The packing so made is
the incumbent of a search over all bins, which ends where the lower bound of the whole proves it the best there is.
Otherwise all bins are filled anew, first around the lengths that were left for bins with waste, a few times. Then bins of the
best packing are taken back from the last on, one of a run of equal ones after the other, and filled by the next filling
that no other one dominates; a branch is pruned where even the lower bound of what is left can't beat the incumbent. The last
few pieces of every branch get the fewest bins there can be for them. All that comes after the first packing shares a number of
steps, counted and not timed, so that reruns agree; when they are used up, the incumbent stays.
Pieces then find their places by length and rank: a join, not a loop.

Nulls and odd rows: a null text is empty and is its end mark alone; every row is packed, also with null or repeated ids;
an empty table gives an empty result. Columns of the input are kept but for those named like the result's.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, others, packed_up, unpacked

CAPACITY, END_ID = 2048, 0
#: Bins that the search fills anew before it stays with its incumbent, and pieces of a filling up to which dominance is looked for.
BRANCHES, COMPARED = 1000, 12
#: Times that all bins are filled anew, and steps of all that comes after the first packing: lengths and fillings looked at.
RESTARTS, STEPS = 12, 10_000_000
#: Pieces that are packed last, by a search through all their bins, and pieces of one length that one task ranks (of over
#: a million, their square root).
LAST, RANKED = 12, 1000
#: Words whose ids a worker remembers: so many lately used ones, and as many before these. A stage among others remembers fewer.
WORDS, STAGE_WORDS = 500_000, 60_000
#: Bytes of text that are parted into words at once.
STRETCH = 1 << 21
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Ids(dict):
    """The ids of a word as little-endian bytes, by word; asks the tokenizer once for a batch's new words.

    The tokenizer drops white space, which always ends a token, and changes text only within words; so that the ids of a
    text are those of its words, one after another. It also parts letters from what follows them, so that the letters and
    the ASCII punctuation of a word go to its model directly, in the byte alphabet that its vocabulary is written in;
    other words go the whole way.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normal = self.tokenizer.model, self.tokenizer.normalizer
        self.before: dict[bytes, bytes] = {}
        # printable bytes stand for themselves, the others for the characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = (b for b in range(256) if b not in set(plain))
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def part(self, text: str) -> bytes:
        """Of letters only or punctuation only, in normal form."""
        if not text.isascii():
            text = "".join([self.alphabet[b] for b in text.encode()])
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def normalized(self, texts: list[str]) -> Iterator[str]:
        """Of words, all at once unless one holds white space or isn't UTF-8; those have no letters' normal form."""
        try:
            found = self.normal.normalize_str(" ".join(texts)).split(" ") if texts else []
        except UnicodeEncodeError:
            found = []
        if len(found) == len(texts):
            yield from found
            return
        for x in texts:
            try:
                yield self.normal.normalize_str(x)
            except UnicodeEncodeError:
                yield "0"

    def __missing__(self, word: bytes) -> bytes:
        self[word] = found = self.before[word]
        return found

    def forget(self) -> None:
        self.clear()
        self.before = {}

    def learn(self, words: set[bytes], most: int | None = None) -> None:
        """most: words to remember, WORDS if None; those of one call are remembered in any case."""
        if len(self) + len(words) > (WORDS if most is None else most):
            self.before = dict(self)
            self.clear()
        new = list(words.difference(self).difference(self.before))
        # white space parts words, so that one decoding does for all; what is no UTF-8 goes the whole way
        texts = b"\n".join(new).decode("utf-8", "surrogateescape").split("\n") if new else []
        cores = [x.rstrip(PUNCTUATION) for x in texts]
        parts, odd, part, normal = {"": b""}, [], self.part, self.normalized([c for c in cores if not c.isascii()])
        for w, x, core in zip(new, texts, cores, strict=True):
            tail = x[len(core) :]
            letters = core.lower() if core.isascii() else next(normal)
            if core and not letters.isalpha():
                odd.append(w)
                continue
            if (head := parts.get(letters)) is None:
                head = parts[letters] = part(letters)
            if tail:
                if (end := parts.get(tail)) is None:
                    end = parts[tail] = part(tail)
                head += end
            self[w] = head
        for w, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False), strict=True):
            self[w] = array("I", e.ids).tobytes()


_IDS: dict[str, Ids] = {}


def worker_ids(path: str) -> Ids:
    """The memory of words, one for a worker and all its tasks."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def encoded(texts: list[bytes], ids: Ids, words: int | None = None) -> Iterator[bytes]:
    """The ids of each text as bytes. Only the words of about STRETCH bytes are held at a time, of one long text or many short."""
    held: list[list[bytes]] = []
    size = 0

    def flushed() -> Iterator[bytes]:
        ids.learn(set().union(*held), words)
        for t in held:
            yield b"".join(map(ids.__getitem__, t))

    for text in texts:
        if held and size + len(text) > STRETCH:
            yield from flushed()
            held, size = [], 0
        if len(text) <= STRETCH:
            held.append(text.split())
            size += len(text)
            continue
        data, at = [], 0
        while at < len(text):
            end = SPACE.search(text, at + STRETCH)
            own = text[at : end.start() if end else len(text)].split()
            at = end.start() if end else len(text)
            ids.learn(set(own), words)
            data.append(b"".join(map(ids.__getitem__, own)))
        yield b"".join(data)
    yield from flushed()


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, words: int | None = None) -> DataFrame:
    """For each document its pieces: piece, start, length, ids_crc32, with the other columns of the document.

    words: those that a task remembers, and forgets at its end; if None, workers remember WORDS from task to task, which
    saves time, but workers outlive a query and are lent in turn, so that in time each of them holds as many.
    """
    keep = others(docs, text, "piece", "start", "length", "ids_crc32")
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_ids(tokenizer)
        try:
            for batch in batches:
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(len(keep)).to_pylist()]
                row, piece, start, length, crc = [], [], [], [], []
                for i, data in enumerate(encoded(texts, ids, words)):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                kept = batch.select(keep).take(pa.array(row, pa.int64())) if keep else None
                yield pa.RecordBatch.from_arrays([*(kept.columns if kept else []), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [*keep, "piece", "start", "length", "ids_crc32"])
        finally:
            if words is not None:
                ids.forget()

    kinds = docs.select(*keep).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select(*keep, text).mapInArrow(cut_up, kinds)


def reachable(left: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """By k: the sums up to `room` that the k smallest lengths can make, as the bits of a number."""
    mask, out = (2 << room) - 1, [1]
    for x in lengths:
        sums, copies, block = out[-1], min(left[x], room // x), 1
        while copies > 0:  # blocks of 1, 2, 4, ... copies and a rest make every number of copies
            block = min(block, copies)
            sums |= sums << x * block & mask
            copies -= block
            block *= 2
        out.append(sums)
    return out


def best_fit(left: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The largest length that fits, again and again."""
    found, held, at = [], dict.fromkeys(lengths, 0), bisect.bisect_right(lengths, room)
    while at:
        x = lengths[at - 1]
        if held[x] < left[x]:
            found.append(x)
            held[x] += 1
            room -= x
            at = min(at, bisect.bisect_right(lengths, room))
        else:
            at -= 1
    return found


def completion(left: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The filling of `room` by lengths of which `left` remain that wastes least and of those has the largest lengths.

    lengths: those in `left`, ascending. Best fit's filling is the incumbent, and stays if it wastes nothing. Otherwise the
    branches are numbers of copies, largest length first; the bound of a branch, which sums the smaller lengths can still
    make, is exact, so that every branch taken leads to a least waste. What takes larger lengths for the same waste
    dominates: any rest that suits the smaller ones suits what is then left.
    """
    first = best_fit(left, lengths, room)
    if sum(first) == room:
        return first
    lengths = lengths[: bisect.bisect_right(lengths, room)]
    sums = reachable(left, lengths, room)
    need, found = sums[-1].bit_length() - 1, []
    for k in range(len(lengths), 0, -1):
        x = lengths[k - 1]
        copies = next(c for c in range(min(left[x], need // x), -1, -1) if sums[k - 1] >> need - c * x & 1)
        found += [x] * copies
        need -= copies * x
    return found


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: for each k, lengths over capacity - k stay alone, those over half don't share a bin, and
    what of k and more doesn't fit beside these needs bins of its own (Martello and Toth's L2)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] += c
    number, total = np.concatenate(([0], counts.cumsum())), np.concatenate(([0], (counts * np.arange(capacity + 1)).cumsum()))
    k = np.arange(0, capacity // 2 + 1)
    half, far = capacity // 2 + 1, capacity - k + 1  # lengths from `half` on are over half, from `far` on they stay alone
    alone = number[-1] - number[far]
    pairs, pairs_sum = number[far] - number[half], total[far] - total[half]
    small = total[half] - total[np.minimum(k, half)]
    more = np.maximum(0, -(-(small - (pairs * capacity - pairs_sum)) // capacity))
    return int((alone + pairs + more).max(initial=0))


class Spent(Exception):
    """The steps of a search are used up."""


class Steps:
    """The steps that a search has left."""

    def __init__(self, left: float = math.inf) -> None:
        self.left = left

    def take(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise Spent


def dominates(a: tuple[int, ...], b: tuple[int, ...], steps: Steps | None = None) -> bool:
    """Whether the lengths of b fit into those of a as bins, so that a in b's place never needs more bins."""
    steps = steps or Steps()

    def place(rooms: list[int], rest: tuple[int, ...]) -> bool:
        steps.take(4)  # as long as four others
        if not rest:
            return True
        tried = set()
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in tried:
                tried.add(room)
                if place([*rooms[:i], room - rest[0], *rooms[i + 1 :]], rest[1:]):
                    return True
        return False

    return place(list(a), tuple(sorted(b, reverse=True)))


def undominated(rest: list[int], room: int, steps: Steps | None = None) -> list[tuple[int, ...]]:
    """Fillings of `room` by some of `rest` (descending) that nothing more fits into and that no other one dominates."""
    steps = steps or Steps()
    found: set[tuple[int, ...]] = set()

    def widen(at: int, space: int, own: tuple[int, ...]) -> None:
        steps.take(len(rest) + 1)
        i = at
        while i < len(rest):
            if rest[i] <= space:
                widen(i + 1, space - rest[i], (*own, rest[i]))
                while i + 1 < len(rest) and rest[i + 1] == rest[i]:
                    i += 1
            i += 1
        left = Counter(rest) - Counter(own)
        if not left or min(left) > space:
            found.add(own)

    widen(0, room, ())
    out: list[tuple[int, ...]] = []
    for own in sorted(found, key=lambda f: (-sum(f), tuple(-x for x in f))):
        if not any(dominates(other, own, steps) for other in out):
            out.append(own)
    return out


def fewest(pieces: list[int], capacity: int, steps: Steps | None = None) -> list[tuple[int, ...]]:
    """A packing of few pieces into as few bins as there can be: branches are undominated fillings, pruned by the bound."""
    best: list[tuple[int, ...]] = []
    rest = sorted(pieces, reverse=True)
    while rest:  # the incumbent: best fit's fillings
        left = Counter(rest[1:])
        own = (rest[0], *best_fit(left, sorted(left), capacity - rest[0]))
        best.append(own)
        rest = sorted((Counter(rest) - Counter(own)).elements(), reverse=True)

    def descend(rest: list[int], bins: list[tuple[int, ...]]) -> None:
        nonlocal best
        if not rest:
            best = bins if len(bins) < len(best) else best
        elif len(bins) + lower_bound(Counter(rest), capacity) < len(best):
            for own in undominated(rest[1:], capacity - rest[0], steps):
                left = sorted((Counter(rest[1:]) - Counter(own)).elements(), reverse=True)
                descend(left, [*bins, (rest[0], *own)])

    descend(sorted(pieces, reverse=True), [])
    return best


def completions(left: dict[int, int], lengths: list[int], room: int, steps: Steps | None = None) -> Iterator[tuple[int, ...]]:
    """The fillings of `room` by increasing waste, those with the largest lengths first, without what an earlier one dominates.

    A filling of over COMPARED pieces is always a branch, since placing its pieces may take long.
    """
    steps = steps or Steps()
    lengths = lengths[: bisect.bisect_right(lengths, room)]
    steps.take(len(lengths))
    sums = reachable(left, lengths, room)
    seen: list[tuple[int, ...]] = []

    def exactly(k: int, need: int) -> Iterator[tuple[int, ...]]:
        if not need:
            yield ()
        while k and need and sums[k] >> need & 1:
            steps.take()
            x = lengths[k - 1]
            for copies in range(min(left[x], need // x), 0, -1):
                if sums[k - 1] >> need - copies * x & 1:
                    for rest in exactly(k - 1, need - copies * x):
                        yield (x,) * copies + rest
            k -= 1

    for need in range(sums[-1].bit_length() - 1, -1, -1):
        for own in exactly(len(lengths), need):
            if len(own) > COMPARED or not any(len(other) <= COMPARED and dominates(other, own, steps) for other in seen):
                seen.append(own)
                yield own


def fillings(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins) that use up the histogram.

    Depth first: each bin is filled around the largest length left, with the least waste first, and the last `LAST` pieces get
    the fewest bins there can be for them. Where the lower bound isn't met, lengths that lay in bins with waste go first, those of
    the latest packing before the others, and all bins are filled anew; then bins of the best packing are taken back and filled
    otherwise. That ends when the lower bound is met, nothing is left to try, BRANCHES bins were filled anew or STEPS are used up.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths, pieces, used = sorted(left), sum(left.values()), 0
    path: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]] | None]] = []
    last: list[tuple[int, ...]] = []
    best: list[tuple[tuple[int, ...], int]] = []
    kept: list[tuple[tuple[int, ...], int]] = []  # the path of the best packing
    fewest_yet, least = pieces + 1, lower_bound(left, capacity)
    awkward: dict[int, int] = {}  # lengths that go first, by the packing that left them for bins with waste
    steps = Steps()

    def take(found: tuple[int, ...], times: int) -> None:
        """Bins filled; taken back, if times is negative."""
        nonlocal pieces, used
        for n, u in Counter(found).items():
            if n not in left:
                left[n] = 0
                bisect.insort(lengths, n)
            left[n] -= u * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
        pieces -= times * len(found)
        used += times

    def dive() -> None:
        nonlocal best, kept, fewest_yet, last
        first = sorted(awkward, key=lambda n: (awkward[n], n))
        while pieces > LAST:
            while first and first[-1] not in left:
                first.pop()
            top = first[-1] if first else lengths[-1]
            steps.take(len(lengths))
            left[top] -= 1
            found = (top, *completion(left, lengths, capacity - top))
            left[top] += 1
            times = min(left[n] // u for n, u in Counter(found).items())
            path.append((found, times, None))
            take(found, times)
        last = fewest(list(Counter(left).elements()), capacity, steps)
        if used + len(last) < fewest_yet:
            kept = [(found, times) for found, times, _ in path]
            fewest_yet, best = used + len(last), kept + [(own, 1) for own in last]

    def search() -> None:
        tried = 0
        while fewest_yet > least and tried < min(RESTARTS, BRANCHES):
            tried += 1
            for found in [*(found for found, _, _ in path), *last]:
                if sum(found) < capacity:
                    awkward.update(dict.fromkeys(found, tried))
            while path:
                found, times, _ = path.pop()
                take(found, -times)
            dive()
        while path:
            found, times, _ = path.pop()
            take(found, -times)
        for found, times in kept:
            path.append((found, times, None))
            take(found, times)
        while path and fewest_yet > least and tried < BRANCHES:
            found, times, others_left = path.pop()
            take(found, -1)
            if others_left is None:
                if times > 1:  # the last of several bins alike is filled anew, the others stay
                    path.append((found, times - 1, None))
                top, own = found[0], dict(left)
                own[top] -= 1
                others_left = completions(own, list(lengths), capacity - top, steps)
                next(others_left)  # the filling that was there
            filling = next(others_left, None)
            if filling is None:
                continue
            tried += 1
            path.append(((found[0], *filling), 1, others_left))
            take(path[-1][0], 1)
            steps.take(len(lengths))
            if used + lower_bound(left, capacity) < fewest_yet:
                dive()

    dive()
    if fewest_yet > least:
        steps.left = STEPS
        try:
            search()
        except Spent:
            pass
    return best


def packed(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """parts, with their `length`, and sequence_id and offset. The driver holds one count for each length."""
    columns = others(parts, "sequence_id", "offset")
    names = [F.col(c) for c in order if c in columns]
    hashed = F.xxhash64(*names) if names else F.lit(0).cast("long")
    rows = cut(parts.select(packed_up(columns), F.col("length").cast("long").alias("length"), hashed.alias("hash"), *[c.alias(f"by{i}") for i, c in enumerate(names)]))
    by = [F.col(f"by{i}") for i in range(len(names))]
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins = fillings(counts, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: the first rank, its sequence, the place there
    reached: dict[int, int] = {}
    base = 0
    for found, times in bins:
        offset = 0
        for n in found:
            slots.setdefault(n, []).append((reached.get(n, 0), base, offset))
            reached[n] = reached.get(n, 0) + times
            offset += n
        base += times
    spark = rows.sparkSession
    slot = spark.sparkContext.broadcast({n: np.array(own, dtype=np.int64).T for n, own in slots.items()})
    salts = spark.createDataFrame([(n, -(-c // max(RANKED, math.isqrt(c)))) for n, c in counts.items()], "length long, salts long")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod("hash", "salts"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("hash", *by)) - 1
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", within).join(starts, ["length", "salt"]).select("kept", "length", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (np.asarray(batch.column(i), dtype=np.int64) for i in (1, 2))
            seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for x in np.unique(n):
                own = n == x
                lo, first, offset = slot.value[int(x)]
                at = np.searchsorted(lo, rank[own], side="right") - 1
                seq[own], off[own] = first[at] + rank[own] - lo[at], offset[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq), pa.array(off)], ["kept", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, ranked.select("kept").schema.add("sequence_id", "long").add("offset", "long"))
    return placed.select(*unpacked(columns), "sequence_id", "offset")
