"""Tables of versions under several writers, claims and champions, batches registered once, admission in order."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import portfolio, statistics
from tidemark.plans import batches, book
from tidemark.plans.registry import staged
from tidemark.sources import versioned
from tidemark.sources.versioned import Conflict, Versioned


def test_of_two_writers_one_wins_and_the_other_sees_it(spark, tmp_path):
    one, two = (Versioned(spark, str(tmp_path / "t")) for _ in range(2))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    assert one.read("i int")[0] == 0 and one.append(rows(1), 0) == 1
    seen = two.version()
    assert one.append(rows(2), seen) == 2
    with pytest.raises(Conflict):
        two.append(rows(9), seen)
    version, now = two.read("i int")
    assert version == 2 and sorted(r["i"] for r in now.collect()) == [1, 2]
    assert two.replace(rows(7), version) == 3
    assert [r["i"] for r in one.read("i int")[1].collect()] == [7] and one.read("i int", 1)[1].count() == 1  # old versions stay
    one._written(rows(5))  # a run that broke off before its commit
    assert one.read("i int")[1].count() == 1


def test_a_key_is_claimed_once(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "c"))
    assert [versioned.claim(t, *a) for a in (("k", "a"), ("k", "b"), ("k", "a"), ("m", "b"))] == [True, False, True, True]


def test_champions_change_hands_and_come_back(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "ch"))
    assert versioned.crown(t, "a", 1.0, "2020-01-01") and not versioned.crown(t, "b", 1.05, "2020-01-02") and versioned.crown(t, "b", 1.1, "2020-01-03") and versioned.crown(t, "b", 0.1, "2020-01-04")
    assert versioned.uncrown(t, "2020-02-01") == "a"
    rows = t.read(versioned.CHAMPIONS)[1].orderBy("since").collect()
    assert [(r["id"], r["until"] is None) for r in rows] == [("a", False), ("b", False), ("a", True)]
    assert versioned.uncrown(Versioned(spark, str(tmp_path / "none")), "2020-01-01") is None


def doc(n, op="sma", hypothesis="closes against their past"):
    close, k = {"op": "price", "field": "close"}, {"op": op, "src": {"op": "price", "field": "close"}, "period": {"op": "const", "value": n}}
    return json.dumps({"longEntry": {"op": "gt", "a": close, "b": k}, "longExit": {"op": "lt", "a": close, "b": k}, "risk": {"volTargetAnnual": 0.5, "maxLeverage": 1.0}, "hypothesis": hypothesis})


def test_a_batch_is_registered_once_and_families_are_capped(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "r"))
    rows = [("a", f"n{k}", doc(10 + k)) for k in range(6)] + [("b", "x", doc(10)), ("b", "y", "{"), ("b", "z", doc(5, hypothesis="?")), ("b", None, None), ("c", "m", doc(5, "median"))]
    batch = spark.createDataFrame(rows, batches.BATCH)
    out = {(r["lane"], r["name"]): r["reason"] for r in batches.screened(batch, t.read(batches.REGISTERED)[1], 4).collect()}
    assert [out["a", f"n{k}"] for k in range(6)] == [None] * 4 + ["family is full"] * 2
    assert out["b", "x"] == "twice in the batch" and out["b", "y"].startswith("not a document") and "hypothesis" in out["b", "z"] and out["b", None].startswith("not a document") and out["c", "m"] is None
    first = batches.register(batch, t)
    assert first.count() == 5 and batches.register(batch.repartition(3), t).count() == 5 and t.version() == 1
    more = batches.register(spark.createDataFrame([("a", "q", doc(11)), ("a", "w", doc(77)), ("c", "v", doc(6, "median"))], batches.BATCH), t)
    assert [r["name"] for r in more.collect()] == ["v"] and t.read(batches.REGISTERED)[1].count() == 6
    assert batches.screened(batch.limit(0), t.read(batches.REGISTERED)[1]).isEmpty()


def test_admission_in_order_as_by_plain_arithmetic(spark, tmp_path):
    rng = np.random.default_rng(11)
    base = rng.normal(0.002, 0.01, (4, 200))
    x = {"a": base[0], "b": base[0] + rng.normal(0, 0.002, 200), "c": base[1], "d": rng.normal(-0.002, 0.01, 200)}
    own = spark.createDataFrame([(i, k, float(v)) for i, r in x.items() for k, v in enumerate(r)], "id string, k int, ret double").withColumn("ts", F.timestamp_add("DAY", F.col("k"), F.lit("2020-01-01").cast("timestamp_ntz"))).drop("k")
    ratio = lambda r: r.mean() / r.std() * np.sqrt(365)

    def weighed(names):
        r = np.array([x[n] for n in names])
        return (portfolio.risk_parity(np.cov(r, bias=True).reshape(len(names), len(names)))[0] @ r) if len(names) > 1 else r[0]

    low = {r["id"]: (r["lo"], r["p5"]) for r in statistics.bootstrap_interval(statistics.block_bootstrap(own, 365, 200, by=("id",)), ("id",)).collect()}

    def plainly(order):
        members, out = [], {}
        for n in order:
            if not (low[n][0] > 0 and low[n][1] >= 0):
                out[n] = False
                continue
            near = max((np.corrcoef(x[n], x[m])[0, 1] for m in members), default=-1)
            lift = ratio(weighed([*members, n])) - ratio(weighed(members)) if members else 1.0
            out[n] = not members or (near < 0.6 and lift >= 0.05)
            members += [n] if out[n] else []
        return out

    results = []
    for k, order in enumerate((list("abcd"), list("dcba"))):
        store = Versioned(spark, str(tmp_path / f"s{k}"))
        got = {r["id"]: r for r in book.admit(spark, own, order, store, reps=200).collect()}
        assert {n: r["admitted"] for n, r in got.items()} == plainly(order)
        names = {n for n, r in got.items() if r["admitted"]}
        assert {r["id"] for r in store.read(book.STREAM)[1].select("id").distinct().collect()} == names and store.version() == len(names)
        if k == 0:
            again = book.admit(spark, own, order[:1], store, reps=200).first()
            assert store.version() == len(names) and again["reason"] == "already a member"
        results.append(names)
    assert results[0] != results[1]  # the order decides


def test_registered_queries_of_batches_are_documents(spark, sf_dir):
    rows = staged.parts_as_documents(spark, sf_dir).where("p_partkey % 13 <> 0 and p_partkey % 11 <> 0").drop("p_partkey")
    assert batches.identified(rows).where("reason is not null").isEmpty()
