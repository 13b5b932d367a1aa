"""Exact duplicates, importance resampling and ranked search on small tables, each against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact, lexical, resampling, words

ODD = [(1, "A b c d e", "en"), (2, "a B c d e", "en"), (3, None, None), (4, "", "en"), (5, " \n\t\x0b\x0c\r", "fr"), (None, "no id here at all", "en"), (6, "long " * 30_000, "en"), (6, "long " * 30_000, "en"), (7, "é%%% ☃ <|endoftext|> x's THE!! KK", "fr"), (8, "noidhere atall", "en"), (9, "w" * 3_000_000, "en"), (-4, "a bc", "en"), (11, "ab c", "en"), (12, "ab  c", "en"), (None, "", None)]
SCHEMA = "doc_id long, text string, lang string"
CLASHES = ("kept", "digest", "chars", "none", "id", "tie", "batch", "uid", "n", "shard", "part", "parts", "said", "keep_id", "group_size", "text_sha256", "stays", "generation", "n_features", "weight", "score", "rank", "place", "apart", "before", "no", "item", "item_id", "end", "W", "fewer", "held", "records")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)


def drawn_docs(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "ΔELTA", "e5", "zeta", "eta", "theta"] + [f"w{i}" for i in range(200)]
    texts = [rng.choice([" ", "\n", "; "]).join(rng.choices(vocabulary, [40] * 8 + [1] * 200, k=rng.randint(0, 60))) for _ in range(n)]
    texts = [rng.choice(texts[: 1 + n // 3]) if rng.random() < 0.3 else t for t in texts]
    return [(i, t, "en") for i, t in enumerate(texts)]


# ------------------------------------------------------------------ words
def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("aZ09 _-\n\x00\x7féßK☃\U0001f600ab", k=rng.randint(0, 40)))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        want = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
        for size in (1, 7, 1 << 20):
            assert [w for own in words.stretches(text.encode(), size) for w in own] == want
    assert not list(words.stretches(None)) and not list(words.stretches(b" \n"))


# ------------------------------------------------------------------ exact duplicates
def equal_texts(rows):
    """What dedup() returns of (doc_id, text), but for which one of equal rows stays."""
    groups = {}
    for i, t in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(t or ""), i is None, i or 0, i))
    return {d: (min(g)[3], len(g)) for d, g in groups.items()}


def check_dedup(out, rows):
    want, kept = equal_texts(rows), Counter()
    assert len(out) == len(rows)
    for r in out:
        assert (r["keep_id"], r["group_size"]) == want[r["text_sha256"]]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] += 1
    assert kept == Counter(want.keys())  # one row of each


def test_perfect_hash_gives_every_member_its_own_slot():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 3000):
        digests = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
        sizes, bits = exact.perfect_hash(digests)
        assert sorted(exact.slots(digests, sizes, bits).tolist()) == list(range(n)) and bits.sum() == n
        g = exact.Generation.of(0, digests, np.zeros((n, 7), dtype=np.int64))
        again = exact.Generation.read(g.row(3))
        assert (again.find(digests) == g.find(digests)).all() and (g.digests[g.find(digests)] == digests).all()
        assert (g.find(rng.integers(0, 1 << 63, (500, 4), dtype=np.uint64)) == -1).all()


def test_digests_that_differ_in_one_number_only_are_told_apart():
    digests = np.zeros((400, 4), dtype=np.uint64)
    digests[:, 2] = np.arange(400)
    assert sorted(exact.slots(digests, *exact.perfect_hash(digests)).tolist()) == list(range(400))


@pytest.mark.parametrize("batch", ["doc_id % 2", "0", "1", "cast(null as int)", "case when doc_id < 100 then 1 else 0 end"])
def test_dedup_as_by_groups(spark, monkeypatch, batch):
    monkeypatch.setattr(exact, "DIGESTS", 16)
    monkeypatch.setattr(exact, "ROWS", 8)
    rows = drawn_docs(300) + [(1000 + i, "one and the same" + " " * (i % 5), "en") for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check_dedup(exact.dedup(docs, F.expr(batch)).collect(), [r[:2] for r in rows])


def test_index_is_extended_batch_by_batch(spark):
    rows = drawn_docs(200)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("batch_no", F.col("doc_id") % 3)
    told = exact.digested(docs, F.col("batch_no"))
    index = exact.history_index(exact.grouped(told.where("batch = 0")), 4)
    for k in (1, 2):
        index = exact.extended(index, exact.grouped(told.where(F.col("batch") == k)), 4)
    assert index.agg(F.max("generation")).first()[0] == 2
    found = exact.looked_up(told, index, 4).select("kept.doc_id" if "doc_id" in told.schema["kept"].dataType.names else F.lit(None).alias("doc_id"), F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size", F.col("stays").alias("kept"))
    check_dedup(found.collect(), [r[:2] for r in rows])


def test_dedup_of_odd_rows_and_of_none(odd):
    out = exact.dedup(odd, F.col("doc_id") % 2)
    assert set(out.columns) == {c for c in odd.columns if c != "text"} | {"keep_id", "group_size", "kept", "text_sha256"}
    check_dedup(out.collect(), [r[:2] for r in ODD])
    assert exact.dedup(odd.limit(0), F.lit(0)).isEmpty()


# ------------------------------------------------------------------ importance resampling
def plainly(docs, target, buckets, grams, least, percent):
    def found(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(own), [" ".join(own[i : i + n]) for n in range(1, grams + 1) for i in range(len(own) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = (Counter(bucket(f) for t in own for f in found(t)[1]) for own in ([t for _, t in docs], target))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in docs:
        n, fs = found(t)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def as_rows(out):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()), key=str)


@pytest.mark.parametrize(("grams", "stretch"), [(1, 1 << 20), (3, 1 << 20), (3, 9)])
def test_resampling_as_by_hand(spark, monkeypatch, grams, stretch):
    monkeypatch.setattr(words.stretches, "__defaults__", (stretch,))
    monkeypatch.setattr(resampling, "AT_ONCE", 50)
    docs = [r[:2] for r in drawn_docs(250)]
    target = ["beta gamma w3 w3", None, "", "zeta ΔELTA theta w7 eta e5"]
    own = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    out = resampling.resample(own, spark.createDataFrame([(t,) for t in target], "text string"), 997, grams, 20, 30)
    assert as_rows(out) == plainly(docs, target, 997, grams, 20, 30)
    assert out.where("rank is not null").count() > 20


def test_resampling_of_odd_rows_and_of_none(spark, odd):
    target = spark.createDataFrame([("long the", 1)], "text string, kept int")
    out = resampling.resample(odd, target, percent=100, least=1)
    assert set(out.columns) == {c for c in odd.columns if c != "text"} | {"n_features", "weight", "score", "rank"}
    assert as_rows(out) == plainly([r[:2] for r in ODD], ["long the"], 10_000, 1, 1, 100)
    assert resampling.resample(odd.limit(0), target).isEmpty()
    nobody = resampling.resample(odd, target.limit(0), least=10**9)
    assert nobody.count() == len(ODD) and nobody.where("rank is not null").isEmpty()


def test_ranks_are_global_and_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(1000)], "id long, score long").repartition(7)
    placed = {r["id"]: r["place"] for r in resampling.ranked(rows, F.desc("score"), "id").collect()}
    assert placed == {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 3), i)))}


# ------------------------------------------------------------------ ranked search
def searched_plainly(docs, items, k):
    def terms(text):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in own}
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            scored.append((-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own), i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(s for s in scored if s[0] < 0)[:k])]
    return sorted(out, key=str)


def found_rows(out):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 17, 9])
def test_search_as_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "TERMS", block)
    monkeypatch.setattr(lexical, "SHARD", 13)
    docs = [r[:2] for r in drawn_docs(150)] + [(500 + i, "beta w3 w3") for i in range(40)]
    items = [(1, "Beta w3 beta"), (2, "ΔELTA; theta w7"), (3, None), (4, "nowhere"), (None, "eta"), (1, "zeta"), (6, "w3 W3 alpha w1 w2 w4 w5 w6 w8 w9 w10 w11"), (7, "")]
    out = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert found_rows(out) == searched_plainly(docs, items, 10)


def test_search_of_odd_rows_and_of_none(spark, odd):
    items = spark.createDataFrame([("a", "long the a c", 1), ("b", "NO id abc é", 2), ("b", "w" * 3_000_000, 2)], "item_id string, text string, score int")
    want = searched_plainly([r[:2] for r in ODD], [tuple(r[:2]) for r in items.collect()], 4)
    assert found_rows(lexical.rank(odd, items, 4)) == want
    assert lexical.rank(odd.limit(0), items).isEmpty() and lexical.rank(odd, items.limit(0)).isEmpty()


def test_selection_is_safe_in_ties():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        scores, ids = rng.integers(0, 4, n), rng.permutation(n).astype(np.int64)
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], ids[i]))[:6]
        assert lexical.best(scores, ids, 6).tolist() == want
