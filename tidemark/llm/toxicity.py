"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

Voters fire or not. Lexicon voters: a fixed list of words of abuse, one voter a word; and words and beginnings of words
that are far likelier in toxic documents than in others, found among labelled rows and dealt into voters by a hash, so that
a voter has words of every language. Pattern voters: how often and how densely such words occur, a run of them, shouting,
exclamations, curses written as signs.

The label model sees votes only. It takes the hidden class as the one common cause of the votes: off the diagonal their
correlations are products of one number each, which least squares find and which say how accurate a voter is; pairs that
vary together beyond that are taken as correlated, leave the fit, and share their weight in the posterior. The classifier
is a logistic regression on the posterior chances of all documents; its input are votes and counts of hits. The score is
its output. Labels set three numbers after the lexicon: the share of the class in the label model, and the slope and offset
of the classifier's output, without which chances would be too extreme.

Labels are learnt from a uniform sample of at most `LABELLED` labelled documents that may be learnt from; the words that
are tried and kept are those of this sample that pass the tests, without a further bound. Words are runs of word
characters, lower-cased, over whole texts.

Nulls and odd rows: a null text is empty; without labels the fixed lexicon and the patterns vote alone and the output isn't
rescaled; a null or repeated id is a row like any other; an empty table gives an empty result. Columns of the input are
kept but for the text and one named score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, matrix, others, packed_up, partition_sums, training_labels, unpacked
from .linear import logistic, sigmoid

#: Fixed words of abuse, a voter each.
LEXICON = (
    "bastard", "clown", "coward", "creep", "cretin", "degenerate", "despicable", "dimwit", "disgusting", "dumb", "fool", "freak", "garbage", "hideous", "idiot", "imbecile", "jerk", "liar",
    "loser", "moron", "nitwit", "parasite", "pathetic", "pig", "rat", "scum", "stupid", "swine", "trash", "ugly", "vermin", "worthless",
)
LABELLED = 20_000
#: Lengths of beginnings of words, and the voters of found words and of found beginnings.
BEGINNINGS, VOTERS = (4, 5, 6), 12
#: Least log odds of a found term, and residual correlation from which voters count as correlated.
ODDS, CORRELATED = 2.5, 0.1
#: Pattern voters, in this order: 2 hits, 4 hits, one word in 100, one in 25, 2 different hits, shouting, exclamations, signs.
PATTERNS = 8
#: Class share where nothing is labelled.
SHARE = 0.1
_WORDS = re.compile(r"\w+")
_EXCLAMATIONS, _SIGNS = re.compile(r"[!?]{3,}"), re.compile(r"\w[*#@$%]{2,}\w?")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def terms(distinct: set[str]) -> set[str]:
    """Words, and beginnings of longer words, marked by a hyphen, which no word holds."""
    out = set(distinct)
    for n in BEGINNINGS:
        out.update(w[:n] + "-" for w in distinct if len(w) > n)
    return out


def found_terms(labelled: DataFrame) -> list[str]:
    """Terms that are far likelier in toxic documents, of (text, y) with at most LABELLED rows.

    Of texts whose runs of three words have the same smallest hash, as most near copies do, one counts. A term's log odds have to be ODDS at least; and the chance that so many of its documents are toxic if it says nothing,
    times the number of terms tried, has to be under a hundredth, by Chernoff's bound.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for t in batch.column(0).to_pylist():
                w = words(t)
                least.append(min(xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["text", "y", "h"])

    once = labelled.select("text", "y").mapInArrow(keyed, "text string, y double, h long").groupBy("h").agg(F.max(F.struct("y", "text")).alias("one"))
    once = cut(once.select("one.text", "one.y"))
    sizes = {bool(r["toxic"]): r["n"] for r in once.groupBy((F.col("y") > 0.5).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return []

    def counted(rows: DataFrame, name: str, among=None) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            known = None if among is None else among.value
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    own = terms(set(words(t)))
                    seen.update(own if known is None else own & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    tried = cut(counted(once.where("y > 0.5"), "n").where(F.col("n") >= max(3, toxic // 400)))
    # terms of the toxic rows of a bounded sample, each in several of them; other rows' terms needn't be counted
    shared = labelled.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in tried.select("term").collect()))
    both = tried.join(counted(once.where("y <= 0.5"), "m", shared), "term", "left").fillna(0, ["m"])
    n, m, share = F.col("n"), F.col("m"), toxic / (toxic + clean)
    odds = F.log((n + 0.5) / (toxic + 1)) - F.log((m + 0.5) / (clean + 1))
    surprise = n * F.log(n / (n + m) / share) + F.when(m > 0, m * F.log(m / (n + m) / (1 - share))).otherwise(0.0)
    kept = both.where((odds >= ODDS) & (surprise >= float(np.log(100 * max(1, len(shared.value))))))
    return sorted(r["term"] for r in kept.select("term").collect())


class Voters:
    """Votes and counts of hits of a text, for the fixed lexicon and found terms."""

    def __init__(self, found: list[str]) -> None:
        k = len(LEXICON)
        self.lexicon = {w: i for i, w in enumerate(LEXICON)}
        self.words = {t: k + zlib.crc32(t.encode()) % VOTERS for t in found if not t.endswith("-")}
        self.starts = [{t[:-1]: k + VOTERS + zlib.crc32(t.encode()) % VOTERS for t in found if t.endswith("-") and len(t) == n + 1} for n in BEGINNINGS]
        self.votes = k + 2 * VOTERS + PATTERNS
        self.width = self.votes + 4

    def of(self, text: str | None) -> list[float]:
        all_words = words(text)
        fired = [0.0] * self.width
        hits, started, kinds = 0, 0, 0
        for w, m in Counter(all_words).items():
            fixed, own = self.lexicon.get(w, -1), self.words.get(w, -1)
            if fixed >= 0:
                fired[fixed] = 1.0
            if own >= 0:
                fired[own] = 1.0
            hit = fixed >= 0 or own >= 0
            if hit:
                hits += m
            for n, starts in zip(BEGINNINGS, self.starts, strict=True):
                if len(w) > n and (at := starts.get(w[:n], -1)) >= 0:
                    fired[at] = 1.0
                    if not hit:
                        started += m
                        hit = True
                    break
            kinds += hit
        n, all_hits, v = max(1, len(all_words)), hits + started, self.votes
        upper = sum(map(str.isupper, text or "")) / max(1, len(text or ""))
        fired[v - 8], fired[v - 7] = float(all_hits >= 2), float(all_hits >= 4)
        fired[v - 6], fired[v - 5] = float(all_hits / n >= 0.01), float(all_hits / n >= 0.04)
        fired[v - 4], fired[v - 3] = float(kinds >= 2), float(upper > 0.3)
        fired[v - 2], fired[v - 1] = float(bool(_EXCLAMATIONS.search(text or ""))), float(bool(_SIGNS.search(text or "")))
        fired[v], fired[v + 1], fired[v + 2], fired[v + 3] = np.log1p(hits), np.log1p(started), min(1.0, 10 * all_hits / n), 1.0
        return fired


def label_model(mean: np.ndarray, second: np.ndarray, share: float, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each voter the chance to fire for either class, and its weight in the posterior.

    mean, second: means of the votes and of their products; share: of the class 1.
    """
    cov = second - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    c = cov / np.outer(scale, scale)
    live, m = np.diag(cov) > 1e-9, len(mean)
    use = (~np.eye(m, dtype=bool)) & np.outer(live, live)
    linked = np.zeros((m, m), dtype=bool)
    a = np.zeros(m)
    for _ in range(rounds):
        fit = use & ~linked
        a = np.where(live, np.sqrt(np.clip((c * fit).sum(axis=1) / np.maximum(fit.sum(axis=1), 1), 0.01, 0.9)), 0.0)
        for _ in range(200):
            below = (fit * a**2).sum(axis=1)
            a = 0.5 * a + 0.5 * np.where(below > 0, np.clip((c * fit * a).sum(axis=1) / np.maximum(below, 1e-9), -0.99, 0.99), 0.0)
        beyond = np.abs(c - np.outer(a, a)) * use
        linked = beyond > CORRELATED
        few = linked.sum(axis=1) > max(1, (m - 1) // 2)  # each voter keeps its least correlated half for the fit
        for i in np.flatnonzero(few):
            keep = np.argsort(-beyond[i])[: (m - 1) // 2]
            own = np.zeros(m, dtype=bool)
            own[keep] = True
            linked[i] &= own
            linked[:, i] = linked[i]
    if a.sum() < 0:
        a = -a
    effect = a * scale
    for_1 = np.clip(mean + effect * np.sqrt((1 - share) / share), 1e-4, 1 - 1e-4)
    for_0 = np.clip(mean - effect * np.sqrt(share / (1 - share)), 1e-4, 1 - 1e-4)
    beyond = np.clip(np.abs(c - np.outer(a, a)), 0, 1) * linked
    return for_1, for_0, np.where(live, 1.0 / (1.0 + beyond.sum(axis=1)), 0.0)


def posterior(votes: np.ndarray, for_1: np.ndarray, for_0: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """The chance of class 1 of each row of votes."""
    fires, stays = weight * np.log(for_1 / for_0), weight * np.log((1 - for_1) / (1 - for_0))
    return sigmoid(np.log(share / (1 - share)) + votes @ fires + (1 - votes) @ stays)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their text, with score: the chance that the document is toxic. labels: doc_id and the label."""
    spark = docs.sparkSession
    keep = others(docs, text, "score")
    own = docs.select(F.col(doc_id).alias("i"), packed_up(keep), F.col(text).cast("string").alias("text"))
    sample = cut(training_labels(labels, label, LABELLED).select(F.col("doc_id").alias("label_id"), "y"))
    learnt = own.join(F.broadcast(sample), F.col("i") == F.col("label_id"))
    found = found_terms(learnt.where("text is not null").select("text", "y"))
    shared = spark.sparkContext.broadcast(found)
    width, votes = Voters(found).width, Voters(found).votes

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(shared.value)
        for batch in batches:
            x = np.array([voters.of(t) for t in batch.column(2).to_pylist()], dtype=np.float32).reshape(-1, width)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], ["i", "kept", "votes"])

    voted = cut(own.mapInArrow(vote, own.drop("text").schema.add("votes", T.ArrayType(T.FloatType()))))

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), width)[:, :votes]
        return np.concatenate(((x.T @ x).ravel(), x.sum(axis=0), [len(x)]))

    total = partition_sums(voted.select("votes"), products, votes * votes + votes + 1)
    n = max(total[-1], 1.0)
    known = sample.agg(F.avg("y").alias("y"), F.count("*").alias("n")).first()
    share = min(0.9, max(0.005, known["y"])) if known["n"] else SHARE
    model = label_model(total[-1 - votes : -1] / n, total[: votes * votes].reshape(votes, votes) / n, share)

    def with_chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = posterior(matrix(batch.column(0), width)[:, :votes], *model, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y)], ["votes", "y"])

    w = logistic(voted.select("votes").mapInArrow(with_chances, "votes array<float>, y double"), width)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = matrix(batch.column(0), width) @ w
            x = np.stack((z, np.ones(len(z))), axis=1).astype(np.float32)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 2), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([column, batch.column(1)], ["x", "y"])

    slope, offset = 1.0, 0.0
    if known["n"]:
        checked = cut(voted.join(F.broadcast(sample), F.col("i") == F.col("label_id")).select("votes", "y"))
        slope, offset = logistic(checked.mapInArrow(outputs, "x array<float>, y double"), 2, 25, 0.1)
        slope = max(slope, 0.0)  # labels may set how sure the classifier is, not turn it round

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(slope * (matrix(batch.column(1), width) @ w) + offset))], ["kept", "score"])

    out = voted.select("kept", "votes")
    return out.mapInArrow(scored, out.drop("votes").schema.add("score", "double")).select(*unpacked(keep), "score")
