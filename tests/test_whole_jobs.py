"""Queries that once did a part of their job: their whole results, by the registered SQL or by brute force."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import plain

from tidemark.functions import maths
from tidemark.operators import statistics
from tidemark.plans import queries
from tidemark.plans.registry import returns as registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        where = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{where}'")
    return con


def rows(df, columns):
    return sorted(([plain(v) for v in row] for row in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["vld_block_ratios", "vld_overfitting"])
def test_every_symbol_is_judged(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    symbols = [s for (s,) in duck.sql("SELECT DISTINCT o_orderpriority FROM orders").fetchall()]
    assert len(symbols) > 1 and sorted(got["symbol"].unique()) == sorted(symbols)
    for s in symbols:
        want = duck.sql(f"SELECT * FROM ({queries.ORACLE_SQL[name]}) WHERE symbol = '{s}'").df()
        assert rows(got[got["symbol"] == s], list(want.columns)) == rows(want, list(want.columns))


def test_groups_of_few_blocks_stay(spark):
    times = [("long", k) for k in range(40)] + [("short", k) for k in range(5)] + [("one", 0)]
    returns = spark.createDataFrame([(s, c, k, ((k * 7 + c) % 5 - 2) / 100) for s, k in times for c in (1, 2, 3)], "symbol string, config int, ts int, ret double")
    matrix = statistics.block_ratios(returns, 8, 365, ("symbol", "config"))
    got = {r["symbol"]: r for r in statistics.overfitting(matrix, spark, by=("symbol",)).collect()}
    assert {s: r["splits"] for s, r in got.items()} == {"long": 70, "short": 6, "one": 0} and got["one"]["pbo"] is None
    for s in ("long", "short"):
        alone = statistics.overfitting(matrix.where(f"symbol = '{s}'").drop("symbol"), spark).first()
        assert alone.asDict() == {k: v for k, v in got[s].asDict().items() if k != "symbol"}


@pytest.mark.parametrize(
    ("name", "counts"),
    [
        ("rsm_block_bootstrap", ["range(1000)"]),
        ("rsm_bootstrap_interval", ["range(1000)", "s[26]", "s[976]", "s[51]", "s[501]"]),
        ("agg_kill_bars", ["LIMIT 8"]),
        ("prt_capacity", ["[1e4, 2.5e4, 5e4, 1e5, 2.5e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2.5e7, 5e7, 1e8]"]),
    ],
)
def test_counts_of_the_reference(spark, sf_dir, duck, name, counts):
    sql = queries.ORACLE_SQL[name]
    assert all(c in sql for c in counts)
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.fixture
def small(spark, monkeypatch):
    """Three streams of 90 times in place of those of the tables, and as arrays."""
    x = np.random.default_rng(4).normal(0.001, 0.02, (3, 90))
    own = spark.createDataFrame([(f"s{i}", k, float(v)) for i, r in enumerate(x) for k, v in enumerate(r)], "id string, ts int, ret double")
    monkeypatch.setattr(registry, "streams", lambda *_: own)
    return x


def places(n, mean, rep, seed):
    """A stationary resample, place by place, from the generator's draws one by one."""
    u = lambda d: float(maths.uniforms(seed, np.array([d]))[0])
    out = []
    for i in range(n):
        d = 2 * (rep * n + i)
        out.append(int(u(d + 1) * n) if i == 0 or u(d) < 1 / mean else (out[-1] + 1) % n)
    return out


def falls_and_more(x, per_year=365):
    eq, top, fall = 1.0, 1.0, 0.0
    for r in x:
        eq *= 1 + r
        top = max(top, eq)
        fall = min(fall, eq / top - 1)
    return eq, fall, x.mean() / x.std() * per_year**0.5


def test_numbers_drawn_in_arrays_are_those_of_columns(spark):
    got = [r["u"] for r in spark.range(500).select(maths.uniform(F.lit(9176 ^ 0x5BD1E995), F.col("id") * 7919).alias("u")).collect()]
    assert got == maths.uniforms(9176 ^ 0x5BD1E995, np.arange(500) * 7919).tolist()


def test_monte_carlo_has_5000_paths(spark, small):
    got = {r["id"]: r for r in queries.QUERIES["rsm_monte_carlo"](spark, "").collect()}
    assert all(statistics.stationary_places(90, 15, np.array([rep]), 12345)[0].tolist() == places(90, 15, rep, 12345) for rep in (0, 17, 4999))
    for i, x in enumerate(small):
        draws = statistics.stationary_places(90, 15, np.arange(5000), 12345)
        runs = np.array([falls_and_more(x[d]) for d in draws])
        assert got[f"s{i}"]["p_loss"] == pytest.approx((runs[:, 0] < 1).mean(), abs=1e-9)
        assert got[f"s{i}"]["max_dd_p5"] == pytest.approx(np.sort(runs[:, 1])[round(0.05 * 4999)])
        assert got[f"s{i}"]["sharpe_p50"] == pytest.approx(np.sort(runs[:, 2])[int(0.5 * 4999 + 0.5)])


def test_falls_are_held_against_500_shuffles(spark, small):
    got = {r["id"]: r["share"] for r in queries.QUERIES["rsm_shuffled_falls"](spark, "").collect()}
    for i, x in enumerate(small):
        orders = [sorted(range(90), key=lambda k, rep=rep: maths.uniforms(7, np.array([rep * 90 + k]))[0]) for rep in range(500)]
        assert got[f"s{i}"] == pytest.approx(np.mean([falls_and_more(x[o])[1] <= falls_and_more(x)[1] + 1e-12 for o in orders]), abs=1e-6)


def maxima(streams, reps, seed, mean=20):
    """By replicate the greatest recentred ratio of streams, one by one."""
    out = []
    for rep in range(reps):
        v = []
        for x in streams:
            y = x[statistics.stationary_places(len(x), mean, np.array([rep]), seed)[0]]
            v.append(len(x) ** 0.5 * (y.mean() - x.mean()) / y.std())
        out.append(max(v))
    return np.array(out)


def test_reality_check_and_family_wise_chances(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(m, 0.02, n) for m, n in ((0.004, 90), (0.001, 90), (-0.02, 90), (0.002, 60), (0.0, 7))]
    rows = [(f"s{i}", k, float(v)) for i, r in enumerate(x) for k, v in enumerate(r)] + [("short", k, 0.5) for k in range(4)] + [("s0", 200, None)]
    own = spark.createDataFrame(rows, "id string, ts int, ret double").repartition(3)
    stats = np.array([len(r) ** 0.5 * r.mean() / r.std() for r in x])
    got = statistics.reality_check(own).first()
    assert got["best"] == f"s{stats.argmax()}" and got["p_reality"] == pytest.approx(((maxima(x, 1000, 9176) >= stats.max()).sum() + 1) / 1001)
    fair = [r for i, r in enumerate(x) if i != 2]
    assert stats[2] < -3 and got["p_spa"] == pytest.approx(((maxima(fair, 1000, 9176) >= stats.max()).sum() + 1) / 1001)
    p = {r["id"]: r["p"] for r in statistics.family_wise(own).collect()}
    null = maxima(x, 600, 9176 ^ 0x5BD1E995)
    assert p.pop("short") == 1.0 and [p[f"s{i}"] for i in range(5)] == pytest.approx([((null >= s).sum() + 1) / 601 for s in stats])
    order = np.argsort(-stats)
    assert all(p[f"s{a}"] <= p[f"s{b}"] for a, b in zip(order, order[1:], strict=False))  # a worse stream never has a smaller chance
    none = statistics.reality_check(own.limit(0)).first()
    assert (none["best"], none["p_reality"], none["p_spa"]) == (None, 1.0, 1.0)
    assert statistics.family_wise(own.where("id = 'short'")).first()["p"] == 1.0


def test_permutation_has_200_markets(spark, sf_dir):
    p = np.array([r["p"] for r in queries.QUERIES["rsm_permutation"](spark, sf_dir).collect()])
    assert len(p) == 5 and np.abs(p * 201 - (p * 201).round()).max() < 1e-3 and np.abs(p * 21 - (p * 21).round()).max() > 1e-3


def test_permuted_markets_keep_returns_and_shapes(spark):
    bars = spark.createDataFrame([("a", t, 1.0 * c, c + 1.0, c - 0.5, c + 0.25, float(t)) for t, c in enumerate((5, 7, 6, 9, 8, 12))], "symbol string, ts int, o double, h double, l double, c double, v double")
    was = bars.orderBy("ts").toPandas()
    seen = set()
    for perm, own in statistics.permuted_markets(bars, 20).toPandas().sort_values(["perm", "ts"]).groupby("perm"):
        assert own["c"].iloc[0] == was["c"].iloc[0] and own["v"].tolist() == was["v"].tolist()
        moves = np.diff(np.log(own["c"]))
        assert sorted(moves.round(9)) == sorted(np.diff(np.log(was["c"])).round(9))
        source = [int(np.abs(np.diff(np.log(was["c"])) - m).argmin()) + 1 for m in moves]
        assert (own["h"] / own["c"]).tolist()[1:] == pytest.approx((was["h"] / was["c"]).to_numpy()[source].tolist())
        order = sorted(range(1, 6), key=lambda i, perm=perm: maths.uniforms(1337, np.array([perm * 5 + i - 1]))[0])
        assert source == order
        seen.add(tuple(order))
    assert len(seen) > 10


def test_positions_of_the_state_machine_by_plain_loops(spark, sf_dir):
    from tidemark.plans import expr
    from tidemark.sources import panels

    risk = registry.FULL_DOC["risk"]
    signals = expr.signals(panels.bars_1d(spark, sf_dir), registry.FULL_DOC).toPandas()
    got = {(r["symbol"], r["day"]): (r["dir"], r["w"]) for r in queries.QUERIES["rec_state_machine"](spark, sf_dir).collect()}
    traded = 0
    for symbol, own in signals.sort_values("ts").groupby("symbol"):
        side, level, best, entry, armed, var, was = 0, None, 0.0, 0.0, False, None, None
        for n, (ts, c, atr, enter, leave, short, cover) in enumerate(own[["ts", "c", "atr14", "longEntry", "longExit", "shortEntry", "shortExit"]].itertuples(index=False)):
            atr = None if atr is None or np.isnan(atr) else atr
            weight = 0.0
            if n:
                r = c / was - 1
                var = r * r if var is None else 0.94 * var + 0.06 * r * r
                out = False
                if side:
                    out = level is not None and (c <= level if side == 1 else c >= level)
                    best = max(best, c) if side == 1 else min(best, c)
                    if risk.get("trailActivate") and risk.get("trailOffset"):
                        gain, back = (c / entry - 1, best / c - 1) if side == 1 else (entry / c - 1, c / best - 1)
                        armed = armed or gain >= risk["trailActivate"]
                        out = out or (armed and back >= risk["trailOffset"])
                    if risk.get("trailAtrMult") and atr is not None:
                        moved = best - side * risk["trailAtrMult"] * atr
                        level = moved if level is None else max(level, moved) if side == 1 else min(level, moved)
                held = 0 if side and (out or (leave if side == 1 else cover)) else side
                new = held or (1 if enter else -1 if short else 0)
                if new != side and new:
                    entry = best = c
                    armed, level = False, c - new * risk["stopAtrMult"] * atr if risk.get("stopAtrMult") and atr is not None else None
                    traded += 1
                side = new
                if side:
                    weight = side * min(risk["maxLeverage"], (risk["volTargetAnnual"] ** 2 / 365 / var) ** 0.5 if var > 1e-12 else 1.0)
            was = c
            assert got[symbol, f"{ts:%Y-%m-%d}"] == (side, pytest.approx(weight, abs=1e-6))
    assert traded > 10


def test_equal_ratios_of_permuted_markets_count_however_they_were_summed(spark):
    seen = -0.4616949407769154
    sharpes = spark.createDataFrame([("a", k, x) for k, x in enumerate([seen, float(np.nextafter(seen, -1)), float(np.nextafter(seen, 1)), seen - 1e-6])], "symbol string, perm int, sharpe double")
    observed = spark.createDataFrame([("a", seen)], "symbol string, observed double")
    assert statistics.permutation_p(sharpes, observed).first()["p"] == pytest.approx(4 / 5)
