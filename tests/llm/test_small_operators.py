"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows and extra columns."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, common, lattice_lm, media, mixing, packing, quality, simhash, toxicity, url_rules, webp
from tidemark.llm.queries import tokenizer_path

ODD = [(1, "A b c d e", "en", "s1"), (2, "a B c d e", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, " \n\t", "fr", "s2"), (None, "no id here at all", "en", "s1"), (6, "long " * 30_000, "en", "s3"), (6, "long " * 30_000, "en", "s3"), (7, "é%%% ☃ <|endoftext|> x's THE!!", "fr", None)]
SCHEMA = "doc_id long, text string, lang string, source string"


def names_used():
    """Every name that an operator gives a column anywhere, as extra columns of the input."""
    code = "".join(Path(m.__file__).read_text() for m in (ann, common, media, mixing, packing, quality, simhash, toxicity, url_rules))
    named = re.findall(r'alias\("([A-Za-z_]\w*)"\)|withColumn\("([A-Za-z_]\w*)"|[", ]([a-z_]+) (?:long|int|double|string|binary|boolean|array)\b|"([a-z_0-9]+)"', code)
    return sorted({n for own in named for n in own if n and n.isidentifier()} - {"doc_id", "text", "lang", "source", "page_id", "url"} | {"end", "end_", "by0", "by1", "m", "q", "y", "i", "o"})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in names_used()})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(1, 8)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


# ------------------------------------------------------------------ mixing
def one_by_one(weights, caps, seats):
    held = [0] * len(weights)
    for _ in range(seats):
        open_ = [(-w / (2 * h + 1), i) for i, (w, h, c) in enumerate(zip(weights, held, caps, strict=True)) if h < c]
        if not open_:
            break
        held[min(open_)[1]] += 1
    return held


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(2)
    for _ in range(200):
        k = rng.randint(1, 8)
        w, c = [rng.choice([1.0, 2.0, 5.0, 3.3]) for _ in range(k)], [rng.randint(0, 30) for _ in range(k)]
        n = rng.randint(0, 90)
        assert mixing.apportion(w, c, n) == one_by_one(w, c, n)


def test_shares_stop_at_caps():
    assert mixing.fill([5, 2, 1], [10, 100, 100], 80) == pytest.approx([10, 70 * 2 / 3, 70 / 3])


def test_mixing_takes_blocks_as_counted_one_by_one(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(0, 90)), None, rng.choice(["a", "b", "c", None])) for i in range(300)], SCHEMA)
    mixed = mixing.mix(docs).cache()
    rows = mixed.collect()
    for r in rows:
        p = r["mix_place"]
        before = lambda j, p=p: (j + p["turn"]) * (p["quota"] % p["blocks"]) // p["blocks"]
        words = sum(p["quota"] // p["blocks"] + before(b + 1) - before(b) for b in ((p["start"] + i) // mixing.BLOCK for i in range(r["size"])))
        assert r["taken"] == words <= 3 * r["size"]
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(got - want) <= 0.02 * want + 2 * mixing.BLOCK for want, got in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    text = mixing.texts(mixed).groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in text} == {s: got for s, (_, got) in by.items() if got}
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mixing_odd_and_empty(odd, none):
    out = mixing.mix(odd).collect()
    assert len(out) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in out) and mixing.mix(none).count() == 0
    assert mixing.texts(mixing.mix(odd)).count() >= 1


# ------------------------------------------------------------------ near-duplicates
def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(common.WORD, lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in [t for _, t, *_ in ODD] + ["x y z w q x y z w q", "Éa ÀB c d e f"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bk_tree_finds_all_within():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base for _ in range(3)]
    tree = simhash.BKTree(values)
    for q in values[::5]:
        assert sorted(tree.within(q, 4)) == sorted({v for v in values if (v ^ q).bit_count() <= 4})


@pytest.mark.parametrize("chunk", [512, 8])
def test_links_connect_as_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(7)
    values, x = set(), rng.getrandbits(64)
    for _ in range(60):  # a chain, a ball and noise
        x ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        values.add(x)
        values.add(rng.getrandbits(64))
        values.add(2**63 ^ 1 << rng.randrange(64))
    values |= {0, 1}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(fps, len(values))).collect()}
    part = {v: got.get(v, signed(v)) for v in values}
    assert all((root(a) == root(b)) == (part[a] == part[b]) for a in values for b in values)
    for n in (10**6, 10**9):
        assert simhash.blocks(n) > 5


def test_near_duplicates_odd_and_empty(odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and simhash.near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in out}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[4]["fingerprint"] == "0" * 16 and by[5]["component_id"] == 3


# ------------------------------------------------------------------ nearest neighbours
def test_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).round(3)
    x[100:140] = x[99]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [1.0] * 3), (704, [None, *[1.0] * 7]), (None, [1.0] * 8), (705, [float("inf"), *[1.0] * 7])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = 0
    assert set(found) == set(range(0, 600, 50))
    for q, got in found.items():
        s = ann.scores(x[q], x)
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        hit += len({v for v, _ in got} & set(best.tolist()))
        assert all(score == s[v] for v, score in got)
    assert hit >= 0.9 * 5 * len(found)
    assert [v for v, _ in found[100]] == [99, 101, 102, 103, 104]


def test_search_of_nothing_and_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], schema), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 1), (2, 1)]


def brute(rows, k=5):
    """The k nearest of every row whose id is divisible by 50, in the order of rows: (query_id, [(vec_id, score)])."""
    out = []
    for n, (i, q) in enumerate(rows):
        if i % 50 == 0:
            near = [(-float(ann.scores(np.array(q), np.array([x]))[0]), j, m) for m, (j, x) in enumerate(rows) if m != n and len(x) == len(q)]
            out.append((i, [(j, -s) for s, j, _ in sorted(near)[:k]]))
    return out


def lists(out):
    """The lists of an answer, by query id; several queries of an id have as many rows of each rank."""
    by = {}
    for r in out:
        by.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return by


def test_no_query_gets_fewer_neighbours_than_there_are(spark):
    rng = np.random.default_rng(1)
    x = [[float(v) for v in r] for r in rng.normal(size=(900, 8)) + np.array([4.0] + [0.0] * 7)]
    far = [(950, [-9.0, 0.1] + [0.0] * 6), (951, [-9.0, 0.11] + [0.0] * 6), (952, [-9.0, 0.12] + [0.0] * 6)]
    rows = list(enumerate(x)) + far + [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1050, [1.0, 1.0, 1.0])]
    by = lists(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    want = dict(brute(rows))
    assert 1050 not in by and not want.pop(1050)  # nobody else of its length
    assert {q: len(r) for q, r in by.items()} == {q: len(v) for q, v in want.items()}
    assert [by[950][k][0][0] for k in (1, 2)] == [951, 952] and by[1000] == {1: [(1001, want[1000][0][1])]}


def test_rows_of_one_id_have_lists_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 40 * 25, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(120, 4)))]
    by = lists(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    want = {}
    for q, found in brute(rows):
        for k, v in enumerate(found, 1):
            want.setdefault(q, {}).setdefault(k, []).append(v)
    assert {q: {k: sorted(v) for k, v in r.items()} for q, r in by.items()} == {q: {k: sorted(v) for k, v in r.items()} for q, r in want.items()}


def test_search_through_several_levels(spark, monkeypatch):
    for name, value in (("LEAF", 25), ("LEAVES", 6), ("SPLIT", 50), ("MEET", 90), ("CHUNK", 100)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 6)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 6))
    x[200:500] = x[200]  # a leaf that no tree divides
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 50 == 0).collect()
    by, want = lists(out), dict(brute(rows))
    assert set(by) == set(want) and all(sorted(r) == [1, 2, 3, 4, 5] for r in by.values())
    hit = sum(len({r[k][0][0] for k in r} & {v for v, _ in want[q]}) for q, r in by.items())
    assert hit >= 0.9 * 5 * len(want)
    assert [by[250][k][0][0] for k in range(1, 6)] == [200, 201, 202, 203, 204]


def test_a_query_meets_a_group_once_however_many_leaves_it_visits(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 5)
    seen, met = [], ann.Search.met

    def counted(self, index, asked, *more):
        seen.append((asked.count(), asked.groupBy("uid").count().count()))
        return met(self, index, asked, *more)

    monkeypatch.setattr(ann.Search, "met", counted)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(4).normal(size=(3000, 16)))]
    by, want = lists(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()), dict(brute([(i, np.float32(r).astype(float)) for i, r in rows]))
    assert set(by) == set(want) and sum(r[k][0] in want[q] for q, r in by.items() for k in r) >= 0.9 * 5 * len(want)
    [(met_rows, queries)] = seen
    assert queries == 60 and met_rows <= 60 * 3  # 600 leaves in 3 groups


def test_leaves_come_best_bin_first():
    rng = np.random.default_rng(6)
    x = ann.unit(rng.normal(size=(2000, 5)))
    tree = ann.Tree(x, 10, 300)
    sizes = np.bincount(tree.assign(x), minlength=tree.leaves)
    sizes[3] = 0
    for margin, least in ((0.05, 6), (0.0, 40), (1e9, 6)):
        got = tree.visits(x[:40], margin, sizes, least)
        for q in range(40):
            heap, far, first, held, want = [(0.0, 0)], -np.inf, None, 0, set()
            while heap:
                cost, node = heapq.heappop(heap)
                far = max(far, cost) if node else far
                for c in tree.children[node]:
                    heapq.heappush(heap, (float(0.5 * (tree.centres[c] ** 2).sum() - x[q] @ tree.centres[c]), c))
                leaf = tree.leaf[node]
                if leaf >= 0 and sizes[leaf]:
                    first = far if first is None else first
                    if held >= least and far - first > margin + 1e-12:
                        break
                    want.add(leaf)
                    held += sizes[leaf]
            assert set(np.flatnonzero(got[:, q]).tolist()) == want


def test_visits_leave_in_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(ann, "BATCH", 7)
    rows = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([[1.0], [2.0], [3.0]]), pa.array([50, 60, 70])], ["id", "x", "uid"])
    who, leaf = np.repeat([0, 2], 20), np.tile(np.arange(20), 2)
    out = list(ann.by_group(rows, who, leaf, 9, leaf // 3))
    assert [b.num_rows for b in out] == [7, 7] and all(b.column("b").to_pylist() == [9] * 7 for b in out)
    assert [(b["id"], b["uid"], b["x"]) for b in out[1].to_pylist()] == [(7, 70, [3.0])] * 7
    assert [v for b in out[0].to_pylist() for v in b["leaves"]] == list(range(20)) and [b["g"] for b in out[0].to_pylist()] == list(range(7))


def test_search_through_several_bundles(spark, monkeypatch):
    for name, value in (("LEAF", 25), ("LEAVES", 6), ("SPLIT", 50), ("MEET", 90), ("CHUNK", 100), ("BUNDLE", 400), ("WALK", 7), ("BATCH", 5)):
        monkeypatch.setattr(ann, name, value)
    x = np.random.default_rng(8).normal(size=(3000, 4)).astype(np.float32)
    x[1000:1250] = x[1000]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    by, want = lists(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), F.col("vec_id") % 50 == 0).collect()), dict(brute(rows))
    assert set(by) == set(want) and all(sorted(r) == [1, 2, 3, 4, 5] for r in by.values())
    assert sum(r[k][0] in want[q] for q, r in by.items() for k in r) >= 0.9 * 5 * len(want)
    assert [by[1050][k][0][0] for k in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]


# ------------------------------------------------------------------ classifiers
def test_isotonic_is_the_nearest_rising_curve():
    from tidemark.llm.linear import isotonic

    x, y = isotonic(np.arange(4.0), np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1.0, 3.0, 1.0]))
    assert y.tolist() == [0.0, 0.25, 1.0] and (np.diff(x) > 0).all()


def made(spark, kind):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, marks = [], []
    for i in range(400):
        own = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.3
        if bad and kind == "toxic":
            own[3] = rng.choice(["vilkor", "vilkamen", "vilkest", "idiot", "scum,"])
            own[9] = rng.choice(["vilkor", "vilkamen!", "moron", "loser"])
        if bad and kind == "quality":
            own = [w.upper() + "!!%%" for w in own]
        docs.append((i, " ".join(own), "en", "s"))
        marks.append((i, int(bad) if kind == "toxic" else 1 - int(bad)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(marks, f"doc_id long, {kind} int"), dict(marks)


@pytest.mark.parametrize(("kind", "classify", "least"), [("toxic", toxicity.classify, 0.5), ("quality", quality.classify, 0.3)])
def test_held_out_rows_are_told_apart(spark, kind, classify, least):
    docs, marks, truth = made(spark, kind)
    out = {r["doc_id"]: r["score"] for r in classify(docs, marks).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) == 400 and sum((out[i] >= least) == truth[i] for i in held) >= 0.95 * len(held)


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(5)
    n, share = 200_000, 0.2
    y = rng.random(n) < share
    for_1, for_0 = np.array([0.9, 0.7, 0.5, 0.8, 0.6, 0.4, 0.75, 0.65]), np.array([0.05, 0.1, 0.2, 0.02, 0.1, 0.05, 0.15, 0.01])
    votes = (rng.random((n, 8)) < np.where(y[:, None], for_1, for_0)).astype(float)
    copied = votes[:, :1] * (rng.random((n, 1)) < 0.95)  # a voter that repeats another
    votes = np.hstack((votes, copied))
    got_1, got_0, weight = toxicity.label_model(votes.mean(axis=0), votes.T @ votes / n, share)
    assert np.abs(got_1[1:8] - for_1[1:8]).max() < 0.06 and np.abs(got_0[1:8] - for_0[1:8]).max() < 0.02
    assert weight[[0, 8]].max() < 0.9 and weight[1:8].min() > 0.9
    assert ((toxicity.posterior(votes, got_1, got_0, weight, share) > 0.5) == y).mean() > 0.97


def test_toxicity_rests_on_the_posterior(spark, monkeypatch):
    docs, marks, truth = made(spark, "toxic")
    monkeypatch.setattr(toxicity, "posterior", lambda votes, *_: np.full(len(votes), 0.2))
    out = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, marks).collect()}
    assert sum(out[i] >= 0.5 for i in out if truth[i]) == 0


@pytest.mark.parametrize("classify", [toxicity.classify, quality.classify])
def test_classifiers_odd_and_empty(spark, odd, none, classify):
    out = classify(odd, labels(spark)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert classify(none, labels(spark)).count() == 0
    assert classify(odd, labels(spark).limit(0)).count() == len(ODD)


def test_normal_equations_and_features_as_by_hand(spark):
    from tidemark.llm.linear import moments, normal_equations

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 5)).astype(np.float32), rng.integers(0, 2, 300).astype(float)
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "x array<float>, y double").repartition(7)
    n, mean, deviation = moments(rows.select("x"), 5)
    assert n == 300 and mean == pytest.approx(x.mean(axis=0), abs=1e-6) and deviation == pytest.approx(x.std(axis=0), rel=1e-5)
    project = quality.fourier(mean, deviation, out=64)
    gram, by, middle, n = normal_equations(rows, project, 5, 64)
    a = project(x.astype(np.float64))
    assert gram == pytest.approx(a.T @ a) and by == pytest.approx(a.T @ (y - y.mean())) and middle == pytest.approx(y.mean())
    wide = quality.fourier(mean, deviation, out=8193)  # products of features are the kernel's values
    z = (x - mean) / deviation * 0.8 / np.sqrt(5)
    b = wide(x[:20].astype(np.float64))[:, :-1]
    assert b @ b.T == pytest.approx(np.exp(-0.5 * ((z[:20, None] - z[None, :20]) ** 2).sum(axis=2)), abs=0.06)


def test_sums_over_many_partitions_are_a_tree(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN", 3)
    df = spark.range(1000).repartition(40).select(F.col("id").cast("double").alias("x"))
    df = common.cut(df)
    assert common.partition_sums(df, lambda b: np.array([np.asarray(b.column(0)).sum(), b.num_rows]), 2).tolist() == [499500.0, 1000.0]


# ------------------------------------------------------------------ chat and urls
def test_chat_reads_back(spark):
    odd = "<|im_end|><|im_start|>assistant\n<\\|im_sep|> <\\\\| ok"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", odd), (1, 3, "assistant", odd), (1, 3, "assistant", odd), (2, None, None, None), (None, 0, "us\\er\n<|", "x"), (3, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.formatted(turns)
    back = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("ts"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["ts"]] == [("user", odd), ("assistant", "b"), ("assistant", odd), ("assistant", odd)]
    assert back[1]["loss"] == "b" + odd + odd and back[1]["formatted"].count("<|im_start|>") == 2
    assert [(t["role"], t["text"]) for t in back[2]["ts"]] == [("", "")] and [(t["role"], t["text"]) for t in back[None]["ts"]] == [("us\\er\n<|", "x")]
    d = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert d[3]["turns_sha256"] == hashlib.sha256(b"user\n\n").hexdigest() and d[3]["loss_chars"] == 0
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0


def test_spans_are_the_texts_to_learn_in_code_points_and_bytes(spark):
    rows = [(1, k, role, f"é{k}☃ <|x") for k, role in enumerate(["user", "assistant", "assistant", "tool", "assistant", "user"])]
    r = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    texts = [f"é{k}☃ <\\|x" for k in (1, 2, 4)]
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == texts
    assert [r["formatted"].encode()[s["first"] : s["first"] + s["bytes"]].decode() for s in r["loss_spans"]] == texts


@pytest.mark.parametrize("roles", [("assistant",), ("user", "assistant")])
def test_long_conversations_take_time_in_proportion(spark, roles):
    import time

    n = 16_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, roles)), (F.col("id") % len(roles) + 1).cast("int")).alias("role"), F.concat(F.lit("text é "), F.col("id")).alias("text"))
    chat.digests(chat.formatted(turns.limit(10))).collect()
    began = time.perf_counter()
    r = chat.digests(chat.formatted(turns)).first()
    assert time.perf_counter() - began < 15  # a few seconds; a fold over the turns took over a minute
    said = "".join(f"{roles[k % len(roles)]}\ntext é {k}\n" for k in range(n))
    assert r["n_turns"] == n and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256("".join(f"text é {k}" for k in range(n) if roles[k % len(roles)] == "assistant").encode()).hexdigest()


@pytest.mark.parametrize("name", ["op5_chat_format", "op6_url_rules"])
def test_native_plans_have_no_python(spark, sf_dir, name):
    from tidemark.llm import queries

    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_url_rules(spark):
    urls = [(1, "https://Example.COM/en/x?y"), (2, "http://www.example.com/en/"), (3, "a://b.net/es/z#/en/"), (4, "http://xnet/es/"), (5, None), (6, "no scheme"), (7, "http://example.com"), (7, "http://example.com"), (8, "://com/"), (None, "https://badexample.com/en/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit("x") for c in names_used()})
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block"), ("com", "/", "block")], "host string, path string, action string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules).collect()}
    assert out == {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("com/", "allow"), None: ("com/", "allow")}
    assert url_rules.judge(pages, rules).count() == len(urls) and url_rules.judge(pages.limit(0), rules).count() == 0
    assert url_rules.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


# ------------------------------------------------------------------ packing
def test_fillings_are_whole_and_no_worse_than_best_fit():
    rng = random.Random(1)
    for _ in range(20):
        cap = rng.choice([50, 200, 2048])
        items = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 400)))
        bins = packing.fillings(dict(items), cap)
        used = Counter()
        for own, times in bins:
            assert sum(own) <= cap
            for n in own:
                used[n] += times
        assert used == items
        rooms: list[int] = []  # best fit decreasing
        for n in sorted(items.elements(), reverse=True):
            fit = min((i for i, room in enumerate(rooms) if room >= n), key=lambda i: rooms[i], default=None)
            if fit is None:
                rooms.append(cap - n)
            else:
                rooms[fit] -= n
        assert -(-sum(n * c for n, c in items.items()) // cap) <= sum(t for _, t in bins) <= len(rooms)


def test_small_packings_are_the_best_there_are():
    def best(items, cap):
        rooms, found = [], len(items)

        def place(i):
            nonlocal found
            if len(rooms) >= found:
                return
            if i == len(items):
                found = len(rooms)
                return
            for k, room in enumerate(rooms):
                if room >= items[i]:
                    rooms[k] -= items[i]
                    place(i + 1)
                    rooms[k] += items[i]
            rooms.append(cap - items[i])
            place(i + 1)
            rooms.pop()

        place(0)
        return found

    rng = random.Random(3)
    for _ in range(150):
        cap = rng.choice([20, 50, 100])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 9))), reverse=True)
        least = best(items, cap)
        assert packing.lower_bound(Counter(items), cap) <= least == sum(t for _, t in packing.fillings(Counter(items), cap))


def test_completions_waste_least():
    rng = random.Random(8)
    for _ in range(100):
        left, room = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 9))), rng.randint(1, 90)
        items = sorted(left.elements())
        sums = {sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))}
        got = packing.completion(left, sorted(left), room)
        assert sum(got) == max(s for s in sums if s <= room) and not Counter(got) - left
    assert packing.dominates((7, 5), (4, 3, 5)) and not packing.dominates((7, 5), (6, 6))


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    parts = packing.packed(packing.pieces(odd, path)).collect()
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    want = Counter((d, k, k * 2048, len(ids(t)[k * 2048 :][:2048]), zlib.crc32(np.array(ids(t)[k * 2048 :][:2048], dtype="<u4").tobytes())) for d, t, *_ in ODD for k in range(-(-len(ids(t)) // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in parts) == want
    by = {}
    for r in parts:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(packing.pieces(none, path)).count() == 0


def test_words_are_encoded_as_in_texts():
    ids = packing.Ids(tokenizer_path("word_bpe_49k.json"))
    words = ["Hello,", "it's", "don't.", "x''s", "ÉTÉ!!", "ΣΑΣ", "a_b", "3,4", "日本語", "<|endoftext|>", "a<|endoftext|>b", "'s", "İstanbul,", "²", "***", "they'll", "ﬁne", "각.", "q̀", "x-y"]
    ids.learn({w.encode() for w in words})
    for w in words:
        assert np.frombuffer(ids[w.encode()], dtype="<u4").tolist() == ids.tokenizer.encode(w, add_special_tokens=False).ids


def test_words_that_are_no_utf8_or_hold_white_space_have_the_ids_of_the_whole_way():
    words = [b"caf\xc3\xa9,", "É\u3000é".encode(), "q\u0300".encode(), "\u0300x".encode(), b"ab\xff!", b"\xed\xa0\x80x", "ΣΑΣ.".encode(), b"plain"]
    for own in (words, words[:1] + words[2:4] + words[6:]):
        ids = packing.Ids(tokenizer_path("word_bpe_49k.json"))
        ids.learn(set(own))
        for w in own:
            assert np.frombuffer(ids[w], dtype="<u4").tolist() == ids.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids


def test_bins_are_taken_back_and_filled_anew(monkeypatch):
    """Pieces that the least waste bin by bin packs into 6 bins, and 19 of which the search finds 5 and 18."""
    few = [10, 29, 39, 22, 42, 12, 11, 30, 8, 5, 31, 35, 25]
    many = {37: 1, 38: 1, 54: 2, 55: 1, 23: 3, 31: 5, 35: 1, 51: 1, 30: 1, 29: 5, 65: 1, 64: 1, 49: 1, 63: 1, 45: 2, 61: 2, 20: 1, 68: 1, 60: 1, 39: 1, 32: 1, 28: 1, 53: 1, 33: 1, 44: 2, 69: 1, 26: 1, 47: 1, 21: 1}
    for items, cap, want in ((Counter(few), 60, 5), (Counter(many), 100, 18)):
        bins = packing.fillings(dict(items), cap)
        assert sum(t for _, t in bins) == want == packing.lower_bound(items, cap)
        used = Counter()
        for own, times in bins:
            assert sum(own) <= cap
            used.update({n: times * u for n, u in Counter(own).items()})
        assert used == items
    assert len(packing.fewest(few, 60)) == 5
    monkeypatch.setattr(packing, "BRANCHES", 0)
    assert sum(t for _, t in packing.fillings(Counter(few), 60)) == 6


def test_pieces_that_many_fillings_suit_get_the_fewest_bins():
    """400 pieces, half of them near a sixth of a bin: the first packing takes 67 bins, and a search from its last bins on stays there."""
    rng = random.Random(30)
    items = Counter(max(1, min(2048, int(rng.gauss(308, 6) if rng.random() < 0.5 else rng.lognormvariate(5.6, 0.6)))) for _ in range(400))
    bins = packing.fillings(dict(items))
    assert sum(t for _, t in bins) == packing.lower_bound(items) == 66
    used = Counter()
    for own, times in bins:
        assert sum(own) <= 2048
        used.update({n: times * u for n, u in Counter(own).items()})
    assert used == items


def test_a_search_ends_with_its_steps(monkeypatch):
    """Of pieces that can't meet the lower bound: whole, no worse than the first packing, the same again."""
    rng = random.Random(2)
    items = Counter(rng.randint(500, 700) for _ in range(500))
    monkeypatch.setattr(packing, "STEPS", 300_000)
    bins = packing.fillings(dict(items))
    assert bins == packing.fillings(dict(items)) and sum(t for _, t in bins) > packing.lower_bound(items)
    used = Counter()
    for own, times in bins:
        assert sum(own) <= 2048
        used.update({n: times * u for n, u in Counter(own).items()})
    monkeypatch.setattr(packing, "BRANCHES", 0)
    assert used == items and sum(t for _, t in bins) <= sum(t for _, t in packing.fillings(dict(items)))


def test_completions_come_by_waste_and_none_is_dominated():
    left = {2: 2, 3: 1, 5: 2, 9: 1}
    found = list(packing.completions(left, sorted(left), 10))
    sums = [sum(f) for f in found]
    assert found[0] == (5, 5) and sums == sorted(sums, reverse=True) and len(set(found)) == len(found)
    assert not any(packing.dominates(a, b) for i, a in enumerate(found) for b in found[i + 1 :])


# ------------------------------------------------------------------ scoring
def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "<0xC3>", "<0xA9>"]
    w = np.random.default_rng(1).uniform(0.01, 0.3, 8)
    lattice = lattice_lm.Lattice(pieces, np.log(w))

    def brute(text):
        return sum(w[i] * (brute(text[len(p) :]) if len(p) < len(text) else 1.0) for i, p in enumerate(pieces[:6]) if text.startswith(p))

    words = ["a", "ab", "aab", "abab", "b" * 20]
    assert lattice.logs(words) == pytest.approx([np.log10(brute("▁" + x)) for x in words], abs=1e-9)
    assert [lattice.one("▁" + x) / np.log(10) for x in words] == pytest.approx(lattice.logs(words), abs=1e-9)
    assert lattice.logs(["é"])[0] == pytest.approx(np.log10(w[0] * w[6] * w[7]))
    assert lattice.logs(["ab" * 500])[0] < -200


def test_scores_are_the_sums_over_all_segmentations_of_the_texts(spark):
    """A text's chance, piece by piece over the whole of it, as one would write the recursion down without words."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "the cat  sat", True), (2, "Zyx é qq", False), (3, None, False), (4, "cat cat", True)], "doc_id long, text string, learnt boolean")
    got = {r["doc_id"]: r for r in lattice_lm.score(docs, F.col("learnt"), path).collect()}
    pieces, logs = lattice_lm.vocabulary(path)
    chance = dict(zip(pieces, np.exp(logs), strict=True))
    assert sum(chance.values()) == pytest.approx(1.0)
    ends = (2 + 0.5) / (5 + 2 + 1)
    for i, text in ((1, "▁the▁cat▁sat"), (2, "▁zyx▁é▁qq"), (3, ""), (4, "▁cat▁cat")):
        reach = [1.0] + [0.0] * len(text)
        for k in range(len(text)):
            for j in range(k + 1, len(text) + 1):
                reach[j] += reach[k] * chance.get(text[k:j], 0.0)
        words = text.count("▁")
        assert got[i]["score"] == pytest.approx(np.log10(reach[-1]) + words * np.log10(1 - ends) + np.log10(ends))
    # a training word has an edge of its own, an unseen one what the discount leaves
    assert got[4]["adapted_score"] > got[4]["score"] and got[2]["adapted_score"] < got[2]["score"]


def test_scores_and_counts(spark, odd, none):
    path = tokenizer_path("piece_bpe_32k.model")
    train = common.remainder(F.col("doc_id"), 7) != 2
    out = lattice_lm.score(odd, train, path).collect()
    words = lambda t: re.findall(common.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    seen = Counter()
    for d, t, *_ in ODD:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            seen.update(words(t))
            seen[" "] += 1
    n, v = sum(seen.values()), len(seen)
    want = Counter((d, len(words(t)) + 1, sum(seen[w] > 0 for w in [*words(t), " "]), round(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in [*words(t), " "]), 4)) for d, t, *_ in ODD)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 and r["train_tokens"] == n for r in out)
    assert lattice_lm.score(none, train, path).count() == 0


def test_scores_of_long_unseen_words_have_no_floor(spark):
    rows = [(0, "some words to learn from", "en", True)] + [(n, "xq7z" * (n // 4), "en", False) for n in (400, 5000, 10000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, learnt boolean")
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score(docs, F.col("learnt"), tokenizer_path("piece_bpe_32k.model")).collect()}
    a_char = (got[400] - got[5000]) / 4600
    assert a_char > 0.5 and (got[5000] - got[10000]) / 5000 == pytest.approx(a_char, rel=1e-3)


def test_expected_pieces_by_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "<0xC3>", "<0xA9>"]
    w = np.random.default_rng(2).uniform(0.01, 0.3, 8)
    lattice = lattice_lm.Lattice(pieces, np.log(w))

    def ways(text):
        return [(i, *rest) for i, p in enumerate(pieces[:6]) if text.startswith(p) for rest in ways(text[len(p) :])] if text else [()]

    words, want = ["a", "ab", "aab", "abab"], np.zeros(8)
    for word in words:
        own = ways("▁" + word)
        chances = np.array([np.prod(w[list(x)]) for x in own])
        for x, share in zip(own, chances / chances.sum(), strict=True):
            np.add.at(want, list(x), share)
    assert lattice.expectations(words) == pytest.approx(want)
    alone = np.zeros(8)
    for word in words:
        lattice.expected("▁" + word, alone)
    assert alone == pytest.approx(want)
    assert lattice.expectations(["é"]).tolist() == pytest.approx([1, 0, 0, 0, 0, 0, 1, 1])  # a character without a piece
    thin = lattice.having(np.full(8, -30.0))  # 30 pieces have a chance of e to the -900, which no double holds
    assert np.isfinite(thin.expectations(["ba" * 15])).all() and thin.expectations(["bb" * 15])[3] == pytest.approx(30)


def test_fitted_scores_of_held_out_texts_come_near_the_base_score(spark):
    """The query's score, on texts of syllables: it learns pieces, words and what a text repeats."""
    rng = np.random.default_rng(5)
    syllables = ["th", "re", "on", "and", "tion", "er", "st", "wh"]
    common_words = ["".join(rng.choice(syllables, 3)) for _ in range(150)]
    word = lambda: "".join(rng.choice(syllables, 4)) if rng.random() < 0.1 else common_words[min(149, int(rng.exponential(30)))]
    rows = [(k, " ".join(word() for _ in range(60)), k % 7 != 2) for k in range(300)]
    rows += [(900, "héé 日本 " + "zq" * 400 + " zq" * 3, False), (901, None, False), (902, ("zq" * 400 + " ") * 5, False)]
    got = {r["doc_id"]: r for r in lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string, learnt boolean"), F.col("learnt"), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert len(got) == len(rows) and all(np.isfinite(r["adapted_score"]) and r["adapted_score"] < 0 for r in got.values())
    held = [got[k] for k in range(2, 300, 7)]
    mean = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert mean("adapted_score") > 1.15 * mean("base_score") > mean("score")
    # a long word said again costs no more than one of the text's own words
    assert got[902]["adapted_score"] > 1.1 * (got[900]["adapted_score"])


def test_a_text_with_repeats_by_plain_arithmetic(spark, monkeypatch):
    """Words have the chances that texts of one word have; earlier words of the text add their share, rare or sent to tasks."""
    words = "cat zyx cat zyx zyx".split()
    docs = spark.createDataFrame([(1, "the cat sat", True), (2, " ".join(words), False), (3, "cat", False), (4, "zyx", False)], "doc_id long, text string, learnt boolean")
    end, go_on = np.log10(1.5 / 5), np.log10(1 - 1.5 / 5)
    for most in (0, 300_000):
        monkeypatch.setattr(lattice_lm, "HOT", most)
        got = {r["doc_id"]: r["adapted_score"] for r in lattice_lm.score(docs, F.col("learnt"), tokenizer_path("piece_bpe_32k.model")).collect()}
        chance = {"cat": 10 ** (got[3] - end - go_on), "zyx": 10 ** (got[4] - end - go_on)}
        want = end + sum(go_on + np.log10((1 - 0.2 * i / (i + 20)) * chance[w] + 0.2 * words[:i].count(w) / (i + 20)) for i, w in enumerate(words))
        assert got[2] == pytest.approx(want, abs=1e-9)


# ------------------------------------------------------------------ media
def test_media_round_trip(odd, none):
    out = media.read_back(media.with_media(odd)).collect()
    for r, (_, t, *_) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        data = (t or "").encode()
        data += bytes(-len(data) % 64 if data else 64)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert media.read_back(media.with_media(none)).count() == 0


@pytest.mark.parametrize("data", [bytes(64), b"a" * 64, os.urandom(64), os.urandom(6400), bytes(range(256)) * 4, bytes(60) + b"\1\2\3\4", os.urandom(64) * 17_000])
def test_encode_decode(data):
    assert next(media.samples([media.store(data)])).tobytes()[: len(data)] == data


def test_files_read_side_by_side():
    rng = np.random.default_rng(11)
    block = rng.integers(0, 256, 256, dtype=np.uint8).tobytes()
    words = "the of and in a to is was".split()
    data = []
    for i in range(600):
        text = " ".join(words[k] for k in rng.integers(0, len(words), rng.integers(0, 300))).encode()
        data.append((text, text + 2 * block, rng.integers(0, 256, 64 * (i % 7), dtype=np.uint8).tobytes(), bytes(i))[i % 4])
    data += [b"abc " * 20_000, os.urandom(64_000), text * 400]
    data = [d + bytes(-len(d) % 64 if d else 64) for d in data]
    files = [media.store(d) for d in data]
    assert [x.tobytes()[: len(d)] for x, d in zip(media.samples(files), data, strict=True)] == data
    with pytest.raises(ValueError):
        list(media.samples([f[: max(40, len(f) // 2)] for f in files if len(f) > 400][:64]))


def test_images_of_several_batches_are_read_side_by_side():
    """All rows in their order, no batch beyond the rows and bytes that are read at once unless it came so."""
    rows = [(k, 10) for k in range(5000)] + [(5000 + k, 6_000_000) for k in range(5)] + [(5005, webp.TOGETHER * media.BYTES)]
    sizes, batches, at = [512] * 9 + [392] + [1] * 6, [], 0
    for n in sizes:
        batches.append(pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in rows[at : at + n]], "n_bytes": [n for _, n in rows[at : at + n]]}))
        at += n
    got = list(media.gathered(iter([*batches, batches[0].slice(0, 0)]), 1))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(5006))
    assert [b.num_rows for b in got] == [2048, 2048, 906, 2, 1, 1]
    assert list(media.gathered(iter([]), 1)) == []


def test_stated_codes_are_read_back():
    rng = np.random.default_rng(6)
    lengths = [np.zeros(280, dtype=np.uint8)]
    for s in (0, 1, 255, 256, 279):
        lengths.append(np.eye(280, dtype=np.uint8)[s])
    for used in (2, 3, 7, 40, 280, 1304):  # runs of zeros and of equal lengths, short and long
        for _ in range(8):
            counts = np.zeros(1304, dtype=np.int64)
            counts[rng.integers(0, 1304, used) if rng.random() < 0.5 else np.arange(used)] = rng.integers(1, 4 ** rng.integers(1, 12))
            counts[rng.integers(0, 1304, 3)] += rng.integers(0, 1000, 3)
            lengths.append(webp.code_lengths(counts, 11))
    for own in lengths:
        bits = webp.Bits(webp._written(*webp._code_fields(own)))
        want = webp.Code(own.tobytes())
        got = webp._read_code(bits, len(own))
        assert got.most == want.most and got.numbers.tolist() == want.numbers.tolist()


def kinds_in(file):
    """Which transforms a file has, and whether its main image has a cache and back-references."""
    seen = set()
    bits = webp.Bits(file, 8 * 21 + 32)
    was = {n: getattr(webp, n) for n in ("unpredict", "unindex", "_number")}
    try:
        for n in was:
            setattr(webp, n, lambda *a, n=n: seen.add(n) or was[n](*a))
        webp.decode(file)
    finally:
        for n, f in was.items():
            setattr(webp, n, f)
    if not bits.read(1):
        seen |= {"cache"} if bits.read(1) else set()
    elif bits.read(2) == 2 and not bits.read(1):
        seen |= {"green"} | ({"cache"} if bits.read(1) else set())
    return seen


def test_the_encoder_uses_what_shrinks_a_file():
    rng = np.random.default_rng(4)
    text = " ".join("the of and in".split()[i % 4] + f" {x:x}" for i, x in enumerate(rng.integers(0, 4000, 3000).tolist())).encode()
    text += bytes(-len(text) % 64)
    ramp = np.cumsum(rng.integers(0, 3, (4096, 4)), axis=0, dtype=np.uint8).tobytes()
    grey = np.repeat(rng.integers(0, 256, (4096, 1), dtype=np.uint8), 4, axis=1).copy()
    grey[:, 3] = rng.integers(0, 256, 4096)
    block = rng.integers(0, 256, 4096, dtype=np.uint8).tobytes()
    few = rng.choice(np.array([1, 2, 3], dtype="<u4"), 4096).tobytes()
    found = {}
    for name, data in (("text", text), ("ramp", ramp), ("grey", grey.tobytes()), ("block", 2 * block), ("few", few)):
        file = media.store(data)
        found[name] = kinds_in(file)
        assert next(media.samples([file])).tobytes()[: len(data)] == data and len(file) < 0.85 * len(data)
    assert "cache" in found["text"] and "unpredict" in found["ramp"] and "_number" in found["block"] and "unindex" in found["few"] and "green" in found["grey"]


class Writer:
    """A stream of bits for hand-made files."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, value, n):
        self.value |= (value & (1 << n) - 1) << self.size
        self.size += n

    def flat(self, size, used):
        """A code of one length for the symbols `used`, whose number is a power of two, of an alphabet; gives its codes."""
        used = sorted(used)
        if len(used) == 1 and used[0] < 256:
            self.put(0b01, 2), self.put(1, 1), self.put(used[0], 8)
            return {used[0]: (0, 0)}
        n = (len(used) - 1).bit_length()
        while len(used) < 1 << n:
            used = sorted({*used, next(s for s in range(size) if s not in used)})
        lengths = [n if s in set(used) else 0 for s in range(size)]
        self.put(0, 1), self.put(15, 4)
        own = [1 if k in (0, n) else 0 for k in webp.CODE_LENGTH_ORDER]  # lengths 0 and n, one bit each
        for x in own:
            self.put(x, 3)
        self.put(0, 1)
        token = webp.canonical([1 if k in (0, n) else 0 for k in range(19)])
        for x in lengths:
            self.put(*token[x])
        return webp.canonical(lengths)

    def image(self, pixels, cache=0, main=False, refs=()):
        """Pixels as literals, (length, distance symbol, extra, bits) or ("cache", index); refs: those items, in order."""
        items = list(refs) or [int(p) for p in pixels]
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(0, 1)
        lit = [x for x in items if isinstance(x, int)]
        back = [x for x in items if isinstance(x, tuple) and x[0] != "cache"]
        cached = [x[1] for x in items if isinstance(x, tuple) and x[0] == "cache"]
        green = self.flat(280 + (1 << cache if cache else 0), {x >> 8 & 255 for x in lit} | {256 + x[0] for x in back} | {280 + x for x in cached} | {0})
        red, blue, alpha = (self.flat(256, {x >> s & 255 for x in lit} | {0}) for s in (16, 0, 24))
        dist = self.flat(40, {x[1] for x in back} | {0})
        for x in items:
            if isinstance(x, int):
                for code, s in ((green, 8), (red, 16), (blue, 0), (alpha, 24)):
                    self.put(*code[x >> s & 255])
            elif x[0] == "cache":
                self.put(*green[280 + x[1]])
            else:
                self.put(*green[256 + x[0]])
                self.put(*dist[x[1]])
                self.put(x[2], x[3])

    def file(self, width, height):
        head = Writer()
        head.put(0x2F, 8), head.put(width - 1, 14), head.put(height - 1, 14), head.put(1, 1), head.put(0, 3)
        head.put(self.value, self.size)
        body = head.value.to_bytes(-(-head.size // 8), "little")
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def pixels(n, seed=1):
    return [int(x) for x in np.random.default_rng(seed).integers(0, 1 << 32, n)]


def test_back_references_and_colour_cache():
    p = pixels(4, 2)
    w = Writer()
    w.put(0, 1)
    # 4 literals; 4 more a row of 4 above (near code 1 is (0, 1)); then 4 from distance 3 (symbol for 123 - 1: 122)
    index = webp.MULTIPLIER * p[1] % 2**32 >> 32 - 3
    w.image(None, 3, True, [*p, (3, 0, 0, 0), ("cache", index), *p[:3]])
    got = webp.decode(w.file(4, 3)).ravel().tolist()
    want = [*p, *p, p[1], *p[:3]]
    cache = [0] * 8
    for x in want[:8]:
        cache[webp.MULTIPLIER * x % 2**32 >> 29] = x
    want[8] = cache[index]
    assert got == want


def test_palette():
    p = pixels(3, 5)
    index = [0, 1, 2, 2, 1, 0, 0, 2, 1, 1, 3, 0]
    w = Writer()
    w.put(1, 1), w.put(3, 2), w.put(2, 8)
    step = [p[0], *[sum(((b >> s) - (a >> s) & 255) << s for s in (0, 8, 16, 24)) for a, b in zip(p, p[1:], strict=False)]]
    w.image(step)
    w.put(0, 1)
    w.image([sum(v << 2 * k for k, v in enumerate(index[r * 6 :][:6][c : c + 4])) << 8 for r in range(2) for c in (0, 4)], 0, True)
    assert webp.decode(w.file(6, 2)).ravel().tolist() == [p[i] if i < 3 else 0 for i in index]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 5, 4
    p = pixels(width * height, mode)
    rest = []
    for i, x in enumerate(p):
        y, c = divmod(i, width)
        guess = (p[i - 1] if c else 0xFF000000) if not y else p[i - width] if not c else webp.predicted(mode, p[i - 1], p[i - width], p[i - width - 1], p[i - width + 1])
        rest.append(sum(((x >> s) - (guess >> s) & 255) << s for s in (0, 8, 16, 24)))
    w = Writer()
    w.put(1, 1), w.put(0, 2), w.put(1, 3)
    w.image([mode << 8])
    w.put(0, 1)
    w.image(rest, 0, True)
    assert webp.decode(w.file(width, height)).ravel().tolist() == p


def test_predictions_by_the_definition():
    each = lambda x: [x >> s & 255 for s in (24, 16, 8, 0)]
    left, top, corner, right = pixels(4, 9)
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    ll, tt, cc, rr = map(each, (left, top, corner, right))
    got = lambda m: each(webp.predicted(m, left, top, corner, right))
    assert got(5) == mean(mean(ll, rr), tt) and got(10) == mean(mean(ll, cc), mean(tt, rr))
    assert got(12) == [max(0, min(255, a + b - c)) for a, b, c in zip(ll, tt, cc, strict=True)]
    assert got(13) == [max(0, min(255, a + int((a - c) / 2))) for a, c in zip(mean(ll, tt), cc, strict=True)]
    near = lambda g: sum(abs(a + b - c - x) for a, b, c, x in zip(ll, tt, cc, g, strict=True))
    assert got(11) == (ll if near(ll) < near(tt) else tt)


def test_cross_colour_and_subtracted_green():
    p = pixels(6, 11)
    factors = 0xFF000000 | 0x30 << 16 | 0xE0 << 8 | 0x21
    t = lambda f, c: ((f ^ 128) - 128) * ((c ^ 128) - 128) >> 5
    stored = []
    for x in p:
        a, r, g, b = (x >> s & 255 for s in (24, 16, 8, 0))
        stored.append(a << 24 | (r - t(0x21, g) & 255) << 16 | g << 8 | (b - t(0xE0, g) - t(0x30, r) & 255))
    w = Writer()
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    w.image([factors])
    w.put(0, 1)
    w.image(stored, 0, True)
    assert webp.decode(w.file(3, 2)).ravel().tolist() == p
    w = Writer()
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    w.image([x & 0xFF00FF00 | ((x >> 16) - (x >> 8) & 255) << 16 | (x - (x >> 8) & 255) for x in p], 0, True)
    assert webp.decode(w.file(3, 2)).ravel().tolist() == p
