"""Language-model scores by the likelihood of a subword lattice.

A text is a run of words, each with a mark before it, and an end. Its probability is that of all ways to segment it into
pieces of an existing vocabulary, each piece drawn by the vocabulary's own score: scores that are logarithms of chances
count as they stand; ranks, of a vocabulary of merges, become chances by Zipf's law, 1 / (`RANK` + rank). No piece goes on
beyond a word, so that the sum over all segmentations is a product over the words, each by a forward recursion in
logarithms. The end is one more piece, with the share that ends have among the tokens of the training documents. That is
the score, which learns nothing else from the corpus. Two further numbers do: the base score, from the training documents'
words alone, and the adapted score, of the lattice fitted to the training documents: the pieces have the chances that
`STEPS` rounds of expectation and maximisation find for them in the distinct training words, by forward and backward sums,
with the vocabulary's own chances as `PRIOR` pieces seen beforehand; a training word is one more edge, over the whole
word, with its discounted share of the training words, and what the discount leaves goes to the pieces; and an earlier word
of the same text is another edge, with its share of the text so far, times at most `AGAIN`.

Words: every distinct word is counted and its lattice summed once. The most frequent, at most `HOT`, go to the tasks, so
that a document's sums need a join for its rare words only; a rare word has under 1 / `HOT` of all words.

Nulls and odd rows: a null text is empty: the end alone; a null id is hashed as empty text; repeated rows are kept, each
with its own score; an empty table gives an empty result. Characters that no piece holds are spelt by byte pieces. Columns
of the input other than those named are not kept.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, wider

#: Most words whose scores are sent to every task, and distinct words that a task counts before it sends them on.
HOT, COUNTED = 300_000, 500_000
#: Rounds that fit the pieces' chances, and how many pieces the vocabulary's own chances count for.
STEPS, PRIOR = 2, 1000.0
#: Largest chance that a word is one of the text's own once more, and the words after which it is half that.
AGAIN, HALF = 0.2, 20
#: What is added to ranks, and the chance of a byte that the vocabulary has no piece for.
RANK, NO_BYTE = 50.0, 1e-6
MARK = "▁"
#: Longest word, with its mark, of which many are scored together.
LONG = 40


class Lattice:
    """Pieces with the natural logarithm of a chance each."""

    def __init__(self, pieces: list[str], logs: np.ndarray) -> None:
        self.index = {p: i for i, p in enumerate(pieces)}
        # by character: the piece that ends there, or -1, and what may follow
        self.first: dict[str, tuple[int, dict]] = {}
        for i, piece in enumerate(pieces):
            node = self.first
            for c in piece[:-1]:
                node = node.setdefault(c, (-1, {}))[1]
            node[piece[-1]] = (i, node.get(piece[-1], (-1, {}))[1])
        self.bytes = [self.index.get(f"<0x{b:02X}>", -1) for b in range(256)]
        self._take(logs)

    def _take(self, logs: np.ndarray) -> None:
        self.log = logs.tolist()
        self.table = np.append(logs, -np.inf)  # the last: no piece
        self.spelling = [self.log[k] if k >= 0 else math.log(NO_BYTE) for k in self.bytes]

    def having(self, logs: np.ndarray) -> Lattice:
        """The same pieces with other chances."""
        own = copy.copy(self)
        own._take(logs)
        return own

    def one(self, text: str) -> float:
        """ln of the chances of all segmentations of a text of any length, by the forward recursion."""
        n, first, log = len(text), self.first, self.log
        into: list[list[float]] = [[] for _ in range(n + 1)]  # by place: the logarithms of the ways to get there
        into[0].append(0.0)
        reached = 0.0
        for i in range(n):
            most = max(into[i])
            reached = most + math.log(sum(math.exp(x - most) for x in into[i]))
            into[i] = []
            node, single = first, False
            for j in range(i, n):
                if (e := node.get(text[j])) is None:
                    break
                k, node = e
                if k >= 0:
                    into[j + 1].append(reached + log[k])
                    single = single or j == i
            if not single:
                into[i + 1].append(reached + sum(self.spelling[b] for b in text[i].encode("utf-8", "surrogatepass")))
        most = max(into[n])
        return most + math.log(sum(math.exp(x - most) for x in into[n]))

    def expected(self, text: str, into: np.ndarray) -> None:
        """Adds how often each piece is expected in a text of any length, by forward and backward recursions."""
        n, first, log = len(text), self.first, self.log
        edges: list[tuple[int, int, float, list[int]]] = []
        for i in range(n):
            node, single = first, False
            for j in range(i, n):
                if (e := node.get(text[j])) is None:
                    break
                k, node = e
                if k >= 0:
                    edges.append((i, j + 1, log[k], [k]))
                    single = single or j == i
            if not single:
                own = text[i].encode("utf-8", "surrogatepass")
                edges.append((i, i + 1, sum(self.spelling[x] for x in own), [self.bytes[x] for x in own if self.bytes[x] >= 0]))
        to, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        to[0] = back[n] = 0.0
        for i, j, x, _ in edges:
            to[j] = _added(to[j], to[i] + x)
        for i, j, x, _ in reversed(edges):
            back[i] = _added(back[i], back[j] + x)
        for i, j, x, found in edges:
            share = math.exp(to[i] + x + back[j] - to[n])
            for k in found:
                into[k] += share

    def walk(self, words: list[str]) -> tuple[list[tuple[int, list[int], np.ndarray]], list[int]]:
        """By length: the places of the words and the pieces at (word, begin, size - 1); and places of words that go alone."""
        first, none = self.first, len(self.index)
        alone: list[int] = []
        by_size: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for i, word in enumerate(words):
            text = MARK + word
            n = len(text)
            if n > LONG or any(c not in first or first[c][0] < 0 for c in text):
                alone.append(i)
                continue
            own, at, found = by_size.setdefault(n, ([], [], []))
            base = len(own) * n * n
            for a in range(n):
                node, row = first, base + a * n - a
                for b in range(a, n):
                    if (e := node.get(text[b])) is None:
                        break
                    k, node = e
                    if k >= 0:
                        at.append(row + b)
                        found.append(k)
            own.append(i)
        out = []
        for n, (own, at, found) in by_size.items():
            ids = np.full(len(own) * n * n, none, dtype=np.int32)
            ids[at] = found
            out.append((n, own, ids.reshape(len(own), n, n)))
        return out, alone

    def logs(self, words: list[str], walked: tuple | None = None) -> np.ndarray:
        """log10 of the words' chances. Words of one length are summed together, place by place, in logarithms."""
        none, out = len(self.index), np.zeros(len(words))
        groups, alone = walked or self.walk(words)
        for i in alone:
            out[i] = self.one(MARK + words[i])
        for n, own, ids in groups:
            reach = np.full((n + 1, len(own)), -np.inf)
            reach[0] = 0.0
            for a in range(n):
                for size in range(1, n - a + 1):
                    k = ids[:, a, size - 1]
                    if (use := np.flatnonzero(k != none)).size:
                        reach[a + size, use] = np.logaddexp(reach[a + size, use], reach[a, use] + self.table[k[use]])
            out[own] = reach[n]
        return out / math.log(10)

    def expectations(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected in the words, each once. Words of up to LONG characters need no logarithms."""
        none, out = len(self.index), np.zeros(len(self.index))
        groups, alone = self.walk(words)
        for i in alone:
            self.expected(MARK + words[i], out)
        chance = np.exp(self.table)
        for n, own, ids in groups:
            to, back = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
            to[0] = back[n] = 1.0
            edges = []
            for a in range(n):
                for size in range(1, n - a + 1):
                    k = ids[:, a, size - 1]
                    if (use := np.flatnonzero(k != none)).size:
                        p = chance[k[use]]
                        to[a + size, use] += to[a, use] * p
                        edges.append((a, a + size, use, k[use], p))
            small = np.flatnonzero(to[n] < 1e-200)  # too small for what is left to be a double
            for i in small.tolist():
                self.expected(MARK + words[own[i]], out)
            back[n, small], to[n, small] = 0.0, 1.0
            found = []
            for a, b, use, _, p in reversed(edges):
                ways = p * back[b, use]
                back[a, use] += ways
                found.append(to[a, use] * ways / to[n, use])
            out += np.bincount(np.concatenate([e[3] for e in reversed(edges)]), np.concatenate(found), len(out))
        return out


def _added(a: float, b: float) -> float:
    """ln of the sum of two numbers of which the ln is given."""
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a vocabulary and the natural logarithms of the chances that its own scores give them, 1 in all.

    A byte piece without a score of its own has that of the rarest piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or MARK in model.id_to_piece(i)[1:])]
    scores = np.array([model.get_score(i) for i in kept], dtype=np.float64)
    byte = np.array([model.is_byte(i) for i in kept])
    ranks = bool((scores == np.round(scores)).all())
    logs = -np.log(RANK - scores) if ranks else scores
    if byte.any() and not byte.all():
        logs = np.where(byte, logs[~byte].min(), logs)
    return [model.id_to_piece(i) for i in kept], logs - np.logaddexp.reduce(logs)


def word_table(docs: DataFrame, train: Column, text: str) -> DataFrame:
    """(word, n, c): every distinct word, how often all documents have it, and the training documents."""
    own = docs.select(F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for learnt, own in seen.items():
                n = pa.array(list(own.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), n, n if learnt else pa.array(np.zeros(len(own), dtype=np.int64))], ["word", "n", "c"])
                own.clear()

        for batch in batches:
            for learnt, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[learnt].update((x or "").encode("utf-8", "surrogatepass").lower().split())
            if sum(map(len, seen.values())) > COUNTED:
                yield from out()
        yield from out()

    return own.mapInArrow(count, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


_MADE: list[tuple[object, Lattice]] = []


def _lattice(model: tuple) -> Lattice:
    """The lattice of a vocabulary, made once in a worker."""
    if not _MADE or _MADE[0][0] is not model:
        _MADE[:] = [(model, Lattice(*model))]
    return _MADE[0][1]


def fitted(words: DataFrame, shared) -> np.ndarray:
    """The natural logarithms of the pieces' chances by expectation and maximisation over the distinct training words.

    A task sends one number for each piece on, in millionths, so that no order of sums matters.
    """
    own, learnt = shared.value[1], words.where("c > 0").select("word")
    for _ in range(STEPS):
        now = words.sparkSession.sparkContext.broadcast(own)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice = _lattice(shared.value).having(now.value)
            out = np.zeros(len(now.value))
            for batch in wider(batches):
                out += lattice.expectations([w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()])
            times = np.rint(out * 1e6).astype(np.int64)
            at = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(times[at])], ["piece", "times"])

        sums = learnt.mapInArrow(expect, "piece int, times long").groupBy("piece").agg(F.sum("times").alias("times")).toArrow()
        seen = PRIOR * np.exp(shared.value[1])
        seen[sums.column("piece").to_numpy()] += sums.column("times").to_numpy() / 1e6
        own = np.log(seen / seen.sum())
    return own


def word_chances(words: DataFrame, shared, learnt, total: int, kinds: int, discount: float) -> DataFrame:
    """(word, c, piece, edge): the words' training counts, and log10 of their chances by the vocabulary and as fitted.

    learnt: the pieces' fitted chances; total, kinds: all and distinct training words.
    """

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wider(batches):
            lattice, texts = _lattice(shared.value), [w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            walked = lattice.walk(texts)
            logs, own = lattice.logs(texts, walked), lattice.having(learnt.value).logs(texts, walked)
            c = np.asarray(batch.column(1), dtype=np.float64)
            rest = math.log10(discount * kinds / total) if total else 0.0
            with np.errstate(divide="ignore"):  # an unseen word has the pieces' share only
                whole = np.log(np.maximum(c - discount, 0) / max(total, 1))
            edge = np.logaddexp(whole, (rest + own) * math.log(10)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs), pa.array(edge)], ["word", "c", "piece", "edge"])

    return words.select("word", "c").mapInArrow(chances, "word binary, c long, piece double, edge double")


def score(docs: DataFrame, train: Column, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and adapted_score of every document.

    train: which documents are learnt from, an expression over columns other than the text.
    """
    spark = docs.sparkSession
    words = cut(word_table(docs, train, text))
    n_docs = docs.where(train).count()
    facts = words.agg(*[F.coalesce(f, F.lit(0)).alias(a) for f, a in ((F.sum("c"), "n"), (F.count_if(F.col("c") > 0), "v"), (F.count_if(F.col("c") == 1), "once"), (F.count_if(F.col("c") == 2), "twice"))]).first()
    n, v = facts["n"] + n_docs, facts["v"] + (n_docs > 0)
    discount = min(0.95, max(0.3, facts["once"] / max(1, facts["once"] + 2 * facts["twice"])))
    model = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    # how often a word must occur to be sent to every task: by a histogram of a bounded number of steps
    step = F.floor(F.log2("n") * 16).cast("int")
    least, sent = 1 << 30, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["step"]):
        if (sent := sent + r["m"]) > HOT:
            break
        least = r["step"]
    learnt = spark.sparkContext.broadcast(fitted(words, model))
    chances = lambda own: word_chances(own, model, learnt, facts["n"], facts["v"], discount)
    hot = chances(words.where(step >= least)).toArrow()
    frequent = spark.sparkContext.broadcast((hot.column("word").to_pylist(), *(hot.column(x).to_numpy() for x in ("c", "piece", "edge"))))
    del hot
    rare_words = chances(words.where(step < least))
    size = n + v + 1
    p_end = (n_docs + 0.5) / (n + 1)
    go_on, stop = math.log10(1 - p_end), math.log10(p_end)
    names = ["word", "id", "key", "times", "copies", "tokens", "known", "base", "piece_sum", "edge_sum", "again"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts, piece, edge = _frequent(frequent.value)
        log_base, is_known = np.log10((counts + 1) / size), counts > 0
        end_base = math.log10((n_docs + 1) / size)
        for batch in batches:
            word, times, again, row, own = [], [], [], [], []
            ids, get = batch.column(0), place.get
            for i, x in enumerate(batch.column(1).to_pylist()):
                data = (x or "").encode("utf-8", "surrogatepass")
                used = data.lower().split()
                at = np.array([get(w, -1) for w in used], dtype=np.int64)
                hot = np.flatnonzero(at >= 0)
                h, tokens = at[hot], len(used)
                ends = tokens * go_on + stop
                own.append((xxhash.xxh64_intdigest(data) - (1 << 63), tokens + 1, int(is_known[h].sum()) + (n_docs > 0), float(log_base[h].sum()) + end_base, float(piece[h].sum()) + ends, float(edge[h].sum()) + ends + fresh(tokens) + repeated(h, hot, edge)))
                if len(h) < tokens:
                    rare: dict[bytes, list[float]] = {}
                    for j in np.flatnonzero(at < 0).tolist():
                        if (shares := rare.get(used[j])) is None:
                            rare[used[j]] = []
                        else:
                            shares.append(AGAIN * (len(shares) + 1) / (j + HALF - AGAIN * j))
                    for w, shares in rare.items():
                        word.append(w)
                        times.append(len(shares) + 1)
                        again.append(shares or None)
                        row.append(i)
            at = np.array(row, dtype=np.int64)
            m, none = len(own), pa.nulls(len(row), pa.int64())
            columns = list(zip(*own, strict=True)) if own else [[]] * 6
            key = np.array(columns[0], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b" %d" % x for x in columns[0]] + word, pa.binary()),  # no word begins with a space
                    pa.concat_arrays([ids, ids.take(pa.array(at))]),
                    pa.array(np.concatenate((key, key[at]))),
                    pa.array(np.concatenate((np.zeros(m, dtype=np.int64), np.array(times, dtype=np.int64)))),
                    *(pa.concat_arrays([pa.array(x, pa.int64()), none]) for x in ([1] * m, *columns[1:3])),
                    *(pa.concat_arrays([pa.array(x, pa.float64()), none.cast(pa.float64())]) for x in columns[3:]),
                    pa.array([None] * m + again, pa.list_(pa.float64())),
                ],
                names,
            )

    schema = "word binary, id long, key long, times long, copies long, tokens long, known long, base double, piece_sum double, edge_sum double, again array<double>"
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(sums, schema)
    joined, times = rows.join(rare_words, "word", "left"), F.col("times")
    # what the edges of repeated words add, in logarithms, since a rare word's own chance may be too small for a double
    gain = lambda d: F.greatest(d, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(d)))
    repeats = F.coalesce(F.aggregate("again", F.lit(0.0), lambda sum_, x: sum_ + gain(F.log10(x) - F.col("edge"))), F.lit(0.0))
    part = lambda own, rare: F.sum(F.when(times > 0, times * rare).otherwise(F.col(own)))
    by_doc = joined.groupBy("id", "key").agg(
        *[F.sum(x).alias(x) for x in ("copies", "tokens")],
        part("known", (F.col("c") > 0).cast("long")).alias("known"),
        part("base", F.log10((F.col("c") + 1) / F.lit(float(size)))).alias("base"),
        part("piece_sum", F.col("piece")).alias("piece_sum"),
        F.sum(F.when(times > 0, times * F.col("edge") + repeats).otherwise(F.col("edge_sum"))).alias("edge_sum"),
    )
    once = lambda c: (F.col(c) / F.col("copies")).cast("long")
    each = lambda c: F.col(c) / F.col("copies")
    return by_doc.withColumn("copy", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select(
        F.col("id").alias(doc_id), once("tokens").alias("n_tokens"), once("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("piece_sum").alias("score"), each("edge_sum").alias("adapted_score")
    )


def fresh(tokens: int) -> float:
    """log10 of the chance that none of a text's words is taken from the words before it."""
    i = np.arange(tokens)
    return float(np.log10(1 - AGAIN * i / (i + HALF)).sum())


def repeated(found: np.ndarray, at: np.ndarray, edge: np.ndarray) -> float:
    """What earlier words of the text add to the log10 of its chance, of words by their number and place."""
    order = np.argsort(found, kind="stable")
    own, i = found[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))[: len(own)]
    before = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    own, i, before = own[before > 0], i[before > 0], before[before > 0]
    return float(np.logaddexp(0.0, np.log(AGAIN * before / (i + HALF - AGAIN * i)) - edge[own] * math.log(10)).sum()) / math.log(10)


_PLACES: list[tuple[object, tuple]] = []


def _frequent(shared: tuple) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """The places of the frequent words, made once in a worker, their counts and the logarithms of their chances."""
    words = shared[0]
    if not _PLACES or _PLACES[0][0] is not words:
        _PLACES[:] = [(words, ({w: i for i, w in enumerate(words)}, *shared[1:]))]
    return _PLACES[0][1]
