"""Rules of the language and the back-test that SQL doesn't state: hand-made series, invariants, look-ahead probes."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import documents, joins, portfolio, recursive, statistics
from tidemark.plans import backtest, catalog, expr
from tidemark.plans.catalog import CLOSE, const, ind, two


def series(n=200, symbols=("a",), seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, x in enumerate(c):
            rows.append((s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), i, x * 0.99, x * 1.02, x * 0.97, x, 10.0 + i % 7))
    return pd.DataFrame(rows, columns=["symbol", "ts", "i", *"ohlcv"])


def frame(spark, pdf):
    return spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, i int, o double, h double, l double, c double, v double")


DOC = catalog.document("cross", two("crossover", ind("ema", CLOSE, 5), ind("ema", CLOSE, 20)), two("crossunder", ind("ema", CLOSE, 5), ind("ema", CLOSE, 20)), "levels that cross keep on")


def test_comparison_before_values_are_known_is_false_and_its_denial_true(spark):
    early = two("gt", CLOSE, ind("sma", CLOSE, 50))
    out = expr.evaluate(frame(spark, series(60)), {"a": early, "b": {"op": "not", "a": early}}).orderBy("i").toPandas()
    assert not out["a"][:49].any() and out["b"][:49].all()


def test_recursive_kernels_against_plain_loops():
    x = np.concatenate((np.full(3, np.nan), series(80)["c"].to_numpy()))
    got = recursive.ema(x, 10)
    now = x[3:13].mean()
    assert np.isnan(got[:12]).all() and got[12] == pytest.approx(now)
    for i in range(13, len(x)):
        now = now + 2 / 11 * (x[i] - now)
        assert got[i] == pytest.approx(now)
    up = recursive.rsi(np.arange(30.0), 14)
    assert np.isnan(up[:14]).all() and (up[14:] == 100).all()
    assert np.isnan(recursive.adx(*(np.ones(20),) * 3, 14)).all()


def machine(close, enter, leave, **risk):
    n = len(close)
    pdf = pd.DataFrame({"c": close, "atr14": np.full(n, 1.0), "longEntry": enter, "longExit": leave, "shortEntry": [False] * n, "shortExit": [False] * n})
    return backtest.weights(pdf, {"volTargetAnnual": 0.3, "maxLeverage": 1.0, **risk}, 365)[0].tolist()


def test_stop_is_ignored_while_the_entry_holds():
    close = [10, 10, 10, 7, 7, 7]
    assert machine(close, [False, True, True, True, True, True], [False] * 6, stopAtrMult=2.0) == [0, 1, 1, 1, 1, 1]
    assert machine(close, [False, True, False, False, False, False], [False] * 6, stopAtrMult=2.0) == [0, 1, 1, 0, 0, 0]


def test_profit_trail_arms_and_exits():
    close = [10, 10, 13, 12.9, 11, 11]
    assert machine(close, [False, True] + [False] * 4, [False] * 6, trailActivate=0.2, trailOffset=0.1) == [0, 1, 1, 1, 0, 0]


def test_no_look_ahead(spark):
    pdf = series(160, ("a", "b"))
    spoilt = pdf.copy()
    spoilt.loc[spoilt["i"] > 100, ["o", "h", "l", "c"]] *= 3
    a, b = (backtest.backtest(frame(spark, p), DOC).where("i <= 100").orderBy("symbol", "i").toPandas() for p in (pdf, spoilt))
    for c in ("w", "ret", "equity"):
        assert np.abs(a[c] - b[c]).max() < 1e-9


def test_costs_lower_equity_and_partitions_do_not_matter(spark):
    bars = frame(spark, series(160, ("a", "b")))
    free, dear = (backtest.backtest(b, DOC, cost=c).orderBy("symbol", "i").toPandas() for b, c in ((bars, 0.0), (bars.repartition(3, "i"), 0.01)))
    again = backtest.backtest(bars.repartition(5), DOC, cost=0.01).orderBy("symbol", "i").toPandas()
    assert (dear["equity"] <= free["equity"] + 1e-12).all() and np.allclose(dear["equity"], again["equity"])


def test_names_of_documents():
    swapped = {**DOC, "longEntry": DOC["longEntry"]}
    assert expr.exact_hash(DOC) == expr.exact_hash(swapped) and not expr.problems(DOC)
    other = catalog.document("cross", two("crossover", ind("ema", CLOSE, 6), ind("ema", CLOSE, 21)), DOC["longExit"], "levels that cross keep on")
    assert expr.exact_hash(DOC) != expr.exact_hash(other) and expr.family_hash(DOC) == expr.family_hash(other)
    a, b = two("add", CLOSE, const(1)), two("add", const(1.0001), CLOSE)
    assert expr.canonical(a, {}) == expr.canonical(b, {})
    assert expr.lookback(DOC["longEntry"], {}) == 21


def test_problems_are_named():
    bad = {**DOC, "longEntry": two("gt", CLOSE, {"op": "no"}), "hypothesis": "", "risk": {"volTargetAnnual": 2, "maxLeverage": 9}}
    assert len(expr.problems(bad)) == 4


def test_sampled_and_changed_documents_are_valid_and_seeded():
    rng = random.Random(5)
    docs = [catalog.sample(rng) for _ in range(50)]
    assert not any(expr.problems(d) for d in docs)
    changed = [catalog.mutate(d, rng) for d in docs]
    assert sum(not expr.problems(d) for d in changed) >= 45
    assert not expr.problems(catalog.cross(docs[0], docs[1]))
    assert [catalog.sample(random.Random(9)) for _ in range(3)] == [catalog.sample(random.Random(9)) for _ in range(3)]
    assert catalog.family(DOC) == "trend"
    assert catalog.choose({"a": (90, 100), "b": (1, 100)}, random.Random(1)) == "a"


def test_merge_of_two_offset_streams(spark):
    t = [dt.datetime(2020, 1, d) for d in (1, 2, 3, 4)]
    s = spark.createDataFrame([("x", t[0], 0.02), ("x", t[1], 0.02), ("x", t[2], 0.02), ("y", t[1], 0.02), ("y", t[2], 0.02), ("y", t[3], 0.02)], "id string, ts timestamp_ntz, ret double")
    out = joins.mean_of_all(s).orderBy("ts").toPandas()["ret"].tolist()
    assert out == pytest.approx([0.01, 0.02, 0.02, 0.01])
    assert joins.intersection(s, "id").select("ts").distinct().count() == 2


def test_equal_risk():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    x, risk = portfolio.risk_parity(cov)
    assert x.sum() == pytest.approx(1) and np.ptp(risk) < 1e-6


def test_overfitting_of_noise_and_of_skill(spark):
    rng = np.random.default_rng(3)
    rows = lambda m: spark.createDataFrame([(c, b, float(m[c, b])) for c in range(m.shape[0]) for b in range(m.shape[1])], "config int, block int, value double")
    noise = rng.normal(size=(12, 10))
    skill = rng.normal(size=(12, 10)) * 0.1
    skill[4] += 3
    assert statistics.overfitting(rows(skill), spark).first()["pbo"] <= 0.2
    assert statistics.overfitting(rows(noise), spark).first()["pbo"] > 0.2


def test_cycle_leg():
    out = recursive.cycle_leg(np.array([0.5, -0.1, -0.1, 0.2, 0.9, 0.9]), np.array([False, False, False, True, True, False]), 0.0, 0.8, 30, 0.06)
    assert out.tolist() == pytest.approx([0, 0.25, 0.5, 1.0, 0.94, 0.44])


def test_append_twice_adds_nothing(spark):
    b = frame(spark, series(10))
    assert documents.append_new(b, b, ("symbol",)).isEmpty()


def test_realised_gains():
    entry, gains = recursive.entry_prices(np.array([1.0, 2.0, 1.0, 0.0]), np.array([10.0, 20.0, 30.0, 15.0]))
    assert entry[1] == 15 and gains.tolist() == pytest.approx([0, 0, 1.0, 0.0])


def test_search_beats_random_draws_and_repeats():
    from tidemark.plans import validation

    specs = {"x": {"min": -5, "max": 5, "default": 4.0}, "n": {"min": 1, "max": 50, "default": 40, "int": True}}
    surface = lambda asked: [-((p["x"] - 1) ** 2) - ((p["n"] - 12) / 10) ** 2 for p in asked]
    found = validation.search(surface, specs, 60, batch=4)
    assert found[0][0] == {"x": 4.0, "n": 40.0} and all(p["n"] == int(p["n"]) for p, _ in found)
    best = max(v for _, v in found)
    rng = random.Random(0)
    assert best >= max(surface([{"x": rng.uniform(-5, 5), "n": rng.randint(1, 50)} for _ in range(60)])) - 0.3
    assert found == validation.search(surface, specs, 60, batch=4)
    assert validation.search(lambda a: [1.0], {}, 5) == [({}, 1.0)]
    assert validation.climb(surface, specs, found[0], 10, 1)[1] >= found[0][1]


def test_risk_parity_meets_its_condition():
    import numpy as np

    from tidemark.operators.portfolio import risk_parity

    rng = np.random.default_rng(2)
    for k in (2, 5, 12):
        a = rng.normal(size=(k, 3 * k)) * rng.uniform(0.001, 0.1, (k, 1))
        x, risk = risk_parity(np.cov(a))
        assert x.min() > 0 and abs(x.sum() - 1) < 1e-12 and np.abs(risk - 1 / k).max() < 1e-6


def test_parzen_search_finds_a_peak():
    from tidemark.plans import validation

    specs = {"a": {"min": 0, "max": 10, "default": 1}, "n": {"min": 1, "max": 30, "default": 2, "int": True}}
    peak = lambda many: [-((p["a"] - 7) ** 2) - (p["n"] - 20) ** 2 / 9 for p in many]
    runs = validation.search(peak, specs, 80, batch=4)
    assert len(runs) == 80 and runs[0][0] == {"a": 1.0, "n": 2.0} and runs == validation.search(peak, specs, 80, batch=4)
    assert max(v for _, v in runs) > -1.5 and all(p["n"] == round(p["n"]) and 0 <= p["a"] <= 10 for p, _ in runs)
    assert validation.climb(peak, specs, max(runs, key=lambda p: p[1]), 5, 1)[1] >= max(v for _, v in runs)


def test_forward_sums_are_one_pass(spark):
    from tidemark.operators import joins

    bars = spark.createDataFrame([("a", t) for t in (10, 20, 30)] + [("b", 15)], "symbol string, ts int")
    stamps = spark.createDataFrame([("a", 5, 1.0), ("a", 10, 2.0), ("a", 11, 4.0), ("a", 20, 8.0), ("a", 31, 16.0), ("b", 16, 1.0)], "symbol string, ts int, x double")
    got = {(r["symbol"], r["ts"]): r["x"] for r in joins.asof_forward_sum(bars, stamps, "x", ["symbol"]).collect()}
    assert got == {("a", 10): 3.0, ("a", 20): 12.0, ("a", 30): 0.0, ("b", 15): 0.0}
