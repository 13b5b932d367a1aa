"""Forward steps: the stream equals the replay of a table, whatever order bars come in and wherever it stops."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sleeves
from tidemark.sources import panels
from tidemark.streaming import forward

PLANS = [
    ("trend", None, 20, 0, None, None, 1.5, 1, None, 8e-4, None),
    ("implied", "index_high", 20, 30, 0.3, None, 1.0, 1, None, 7e-4, None),
    ("implied", "gap_low", 10, 30, 0.3, None, 1.0, 1, None, 7e-4, None),
    ("blend", None, 30, 0, None, 0.7, 1.0, 1, None, 8e-4, 0.04),
    ("coins", None, 20, 0, 55.0, None, 1.45, 5, 0.5, 9e-4, None),
]


def feed_of(spark, sf_dir, most=260):
    daily = panels.bars_1d(spark, sf_dir).where(f"i < {most}")
    squeeze = lambda c: F.exp(F.ln(c) / 50)
    kinds = "candidate string, " + forward.PLAN_KINDS
    plans = spark.createDataFrame([(f"{p[0]} {p[1]}", *p) for p in PLANS], kinds)
    own = daily.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *[squeeze(c).alias(c) for c in "hlc"], (F.col("v") % 3 / 1e4).alias("rate"), (1 + F.col("v") / 4).alias("x"))
    own = own.crossJoin(F.broadcast(plans)).withColumn("candidate", F.when(F.col("kind") == "coins", F.col("candidate")).otherwise(F.concat_ws("|", "symbol", "candidate")))
    return own.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in forward.FEED.split(", ")])


def rows_of(df):
    return sorted((r["candidate"], str(r["ts"]), *[round(r[c], 9) for c in ("ret", "equity", "weight")], r["trades"], r["halted"], r["reason"]) for r in df.collect())


@pytest.fixture(scope="module")
def rocks(spark):
    was = {k: spark.conf.get(k, None) for k in forward.ROCKS}
    for k, v in forward.ROCKS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_stream_equals_replay_with_batches_twice_late_and_a_restart(rocks, sf_dir, tmp_path):
    spark = rocks
    feed = feed_of(spark, sf_dir, 70).toPandas()
    feed["ts"] = feed["ts"].astype("datetime64[us]")
    days = np.array(sorted(feed["ts"].unique()))
    rng = np.random.default_rng(1)
    batch = np.searchsorted(days, feed["ts"].to_numpy()) // 90
    late = rng.random(len(feed)) < 0.2  # a fifth of the rows come a batch later
    path = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, forward.FEED).coalesce(1).write.mode("append").parquet(path)

    def drain():
        stream = spark.readStream.schema(forward.FEED).option("maxFilesPerTrigger", 1).parquet(path)
        query = forward.stepped(stream, "500 days").writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    for k in range(int(batch.max()) + 2):
        rows = feed[(batch == k) & ~late | (batch == k - 1) & late]
        if len(rows):
            write(rows)
            if k == 1:
                write(rows)  # again
        if k in (1, 3):
            drain()  # a restart from the checkpoint in the middle
    end = feed.iloc[:1].assign(ts=feed["ts"].max() + pd.Timedelta(days=600), candidate="end", symbol="end")
    write(end)
    write(end.assign(ts=end["ts"] + pd.Timedelta(days=1)))
    drain()
    got = rows_of(spark.read.parquet(str(tmp_path / "out")).where("candidate <> 'end'"))
    want = rows_of(forward.replayed(spark.createDataFrame(feed, forward.FEED)))
    assert len(want) > 300 and got == want
    assert len({r[0] for r in want}) == 21 and any(r[5] for r in want)


def test_blend_steps_hold_the_weights_of_the_batch(spark, sf_dir):
    feed = feed_of(spark, sf_dir, 2000).where("kind = 'blend'")
    steps = forward.replayed(feed).select("candidate", "ts", "weight", "halted").toPandas()
    daily = feed.withColumn("i", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("symbol").orderBy("ts")) - 1)
    batch = sleeves.blend(daily.withColumnRenamed("x", "value"), "value", n_trend=30).select("candidate", "ts", "w").toPandas()
    both = steps.merge(batch, on=["candidate", "ts"])
    assert len(both) == len(steps) and (both["w"] > 0).any()
    held, name = 0.0, None
    for r in both.sort_values(["candidate", "ts"]).itertuples(index=False):
        held = 0.0 if r.candidate != name else held
        name, held = r.candidate, r.w if abs(r.w - held) > forward.BAND else held
        assert r.halted or r.weight == pytest.approx(held, abs=1e-9)


def account(kind="trend", n=2, lever=1.0, coins=1, cost=0.0, edge=101.0, vol=10.0, signal=None):
    return forward.Account((kind, signal, n, 20, edge, 0.7, lever, coins, vol, cost, 0.0))


def bar(c, low=None, rate=0.0, x=None):
    return (c, c if low is None else low, c, rate, x)


def test_a_step_by_hand():
    a = account(cost=0.01)
    day = forward.DAY_MS
    assert a.step(day, {"A": bar(10.0)})[0] == 0
    assert a.step(2 * day, {"A": bar(11.0)})[0] == pytest.approx(-0.01)  # above the mean of two: bought
    assert a.step(3 * day, {"A": bar(11.1, rate=0.001)})[0] == pytest.approx(11.1 / 11 - 1 - 0.001)
    assert a.step(3 * day, {"A": bar(50.0)}) is None
    ret, equity, weight, trades, halted, reason = a.step(4 * day, {"A": bar(11.0)})
    assert (ret, weight, trades, halted) == (pytest.approx(11 / 11.1 - 1 - 0.01), 0.0, 1, False)


def test_a_leveraged_long_is_lost_where_the_low_passes_the_margin():
    a = account(lever=2.0)
    for k, c in enumerate((10.0, 11.0), 1):
        a.step(k * forward.DAY_MS, {"A": bar(c)})
    ret, _, weight, _, halted, reason = a.step(3 * forward.DAY_MS, {"A": bar(11.5, low=11 * (0.5 + 0.004))})
    assert ret == pytest.approx(-(0.5 - 0.005)) and weight == 0 and halted and reason == "daily fall"
    assert a.step(4 * forward.DAY_MS, {"A": bar(12.0)}) is None


def test_limits_look_1_7_and_30_days_back():
    a, out = account(), None
    c, day = 100.0, 0
    for k in range(6):
        day += 1
        a.step(day * forward.DAY_MS, {"A": bar(c := c + 1)})
    for k in range(12):  # 1.5 percent a day: a tenth in a week
        a.plan["n"] = 1
        a.target = lambda symbol, weight: 1.0
        day += 1
        out = a.step(day * forward.DAY_MS, {"A": bar(c := c * 0.985)})
        if out[4]:
            break
    assert out[5] == "weekly fall"


def test_core_of_coins_by_plain_loops():
    rng = np.random.default_rng(4)
    prices = {s: 100 * np.exp(np.cumsum(rng.normal(0.001, 0.01, 90))) for s in ("A", "B")}
    a = account("coins", n=10, lever=1.45, coins=2, cost=0.001, edge=60.0, vol=0.1)
    held, equity = {"A": 0.0, "B": 0.0}, 1.0
    for k in range(90):
        got = a.step((k + 1) * forward.DAY_MS, {s: bar(p[k]) for s, p in prices.items()})
        ret = 0.0
        for s, p in prices.items():
            moved = held[s] * (p[k] / p[k - 1] - 1) if k else 0.0
            mean = p[k - 9 : k + 1].mean() if k >= 9 else math.nan
            moves = np.abs(np.diff(p[: k + 1]))
            chop = 100 * math.log10(moves[-14:].sum() / (p[k - 13 : k + 1].max() - p[k - 13 : k + 1].min())) / math.log10(14) if k >= 14 else math.nan
            var = None
            for r in np.diff(p[: k + 1]) / p[:k]:
                var = r * r if var is None else 0.94 * var + 0.06 * r * r
            up = (held[s] > 0 and not p[k] < mean) or (p[k] > mean and chop < 60)
            to = min(1.0, 0.1 / math.sqrt(365 * var)) if up else 0.0
            ret += 1.45 / 2 * moved
            if abs(to - held[s]) > 0.02:
                ret -= 1.45 / 2 * abs(to - held[s]) * 0.001
                held[s] = to
        ret -= 0.45 * 0.1 / 365 if any(held.values()) else 0.0
        equity *= 1 + ret
        assert got[0] == pytest.approx(ret, abs=1e-12) and got[1] == pytest.approx(equity)
        if got[4]:
            break
    assert equity != 1.0


def test_nothing_and_rows_without_values(spark):
    none = spark.createDataFrame([], forward.FEED)
    assert forward.replayed(none).isEmpty()
    rows = [("a", *PLANS[1], s, datetime(2020, 1, 1), None, None, c, None, None) for s, c in (("A", None), (None, 1.0), ("A", 2.0), ("A", 2.0))]
    assert [r["ret"] for r in forward.replayed(spark.createDataFrame(rows, forward.FEED)).collect()] == [0.0]
