"""Nulls, ties and empty tables of the lifecycle operators, and windows of replays."""

from pyspark.sql import functions as F

from tidemark.operators import lifecycle, portfolio
from tidemark.plans import validation


def test_faults_name_what_is_null_or_out_of_bounds(spark):
    rows = spark.createDataFrame([(100, 50.0), (None, 50.0), (100, 99.0)], "s int, t double")
    got = rows.select(lifecycle.faults("block", {"smaWin": F.col("s"), "chopThr": F.col("t")}).alias("f")).collect()
    assert [r.f for r in got] == [[], ["smaWin"], ["chopThr"]]


def test_digest_tells_null_from_other_values(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string").select(lifecycle.digest(F.col("x"), F.col("y")).alias("h")).collect()
    assert rows[0].h == rows[2].h != rows[1].h


def test_graduated_without_figures(spark):
    rows = spark.createDataFrame([(1, 40.0, None, None, None, None), (2, None, False, 3.0, 0.0, True), (3, 40.0, True, 3.0, 0.0, True), (4, 40.0, False, 0.5, 1.0, None)], "id int, days double, halted boolean, live double, p5 double, diversifies boolean")
    got = {r.id: (r.next, r.why) for r in lifecycle.graduated(rows, 30).collect()}
    assert got == {1: ("failed", "below"), 2: ("incubating", "early"), 3: ("failed", "halted"), 4: ("eligible", "band")}


def test_promoted_without_champion_and_without_eligible(spark):
    some = spark.createDataFrame([(2, 1.0), (1, 1.0), (3, None)], "id int, composite double")
    none = some.where("false")
    assert [r.id for r in lifecycle.promoted(some, none).collect()] == [1]
    assert lifecycle.promoted(none, some).count() == 0
    assert lifecycle.promoted(some, spark.createDataFrame([(9, 0.95)], "id int, composite double")).count() == 0


def test_recorded_keeps_what_has_no_runs_and_the_highest_equity(spark):
    deployed = spark.createDataFrame([(1, "dryrun", 10.0, 10.0), (2, "dryrun", 10.0, 12.0)], "id int, mode string, equity double, peak double")
    runs = spark.createDataFrame([(2, 1, 15.0, None), (2, 2, 11.0, True)], "id int, ts int, equity double, halt boolean")
    got = {r.id: (r.mode, r.equity, r.peak) for r in lifecycle.recorded(deployed, runs).collect()}
    assert got == {1: ("dryrun", 10.0, 10.0), 2: ("halted", 11.0, 15.0)}


def test_signal_weights_without_a_signal_of_any_family(spark):
    ranked = spark.createDataFrame([("close", 1.0, False), ("oi_x", 2.0, True)], "signal string, ir double, redundant boolean")
    assert lifecycle.signal_weights(ranked, {"oi": "oi"}).count() == 0


def test_ranking_text_of_nothing(spark):
    none = spark.createDataFrame([], "signal string, ir double, redundant boolean, native boolean")
    assert [r.text for r in lifecycle.ranking_text(none).collect()] == [""]


def test_crisis_counts_only_the_window_and_begins_flat(spark):
    n = 120
    rows = [("a", i, 100.0 + i, 100.0 + i, i % 2 == 0, False) for i in range(n)]
    own = spark.createDataFrame(rows, "symbol string, i int, c double, h double, longEntry boolean, longExit boolean").withColumn("ts", F.timestamp_seconds(F.col("i") * 86_400).cast("timestamp_ntz"))
    cal = spark.createDataFrame([("w", "1970-02-20", "1970-04-21"), ("short", "1970-02-20", "1970-03-01")], "window string, start string, end string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    runs = validation.replay(own, cal, 0.0, runway=10)
    live = runs.where("live")
    assert live.select("window").distinct().collect()[0].window == "w" and live.count() == 60
    want = 209 / 149 - 1
    got = validation.crisis(runs).collect()[0]
    assert abs(got.ret - want) < 1e-9 and got.max_dd == 0 and got.survives
    report = validation.sealed(runs, 365).collect()[0]
    assert report.trades == 0 and report.reason == "trades"
    assert validation.sealed(runs.where("false"), 365).collect()[0].reason == "no data"


def test_panel_walk_forward_on_an_empty_panel(spark):
    none = spark.createDataFrame([], "symbol string, ts timestamp_ntz, c double, score double")
    windows, stream = portfolio.panel_walk_forward(none, "score", [(1, 1)], 2, 3)
    assert windows.count() == 0 and stream.count() == 0
