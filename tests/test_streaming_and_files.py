"""Streams give what batches give; files read back what was written."""

import gzip
import json

from pyspark.sql import functions as F

from tidemark.sources import files, panels
from tidemark.streaming import bars as live
from tidemark.streaming import paper


def event_files(spark, sf_dir, path, n=4):
    events = panels.table(spark, sf_dir, "events").orderBy("ts")
    rows = events.withColumn("part", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy("ts"))).persist()
    for k in range(1, n + 1):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return events


def test_closed_bars_equal_the_batch(spark, sf_dir, tmp_path):
    events = event_files(spark, sf_dir, str(tmp_path / "in"))
    stream = live.closed_bars(live.ticks(spark, str(tmp_path / "in"), events.schema), "1 hour", "365 days")
    query = live.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    forming = live.forming_bars(live.ticks(spark, str(tmp_path / "in"), events.schema), "1 hour")
    q = forming.writeStream.format("memory").queryName("forming").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("select symbol, ts, max_by(c, v) as c, max(v) as v from forming group by symbol, ts")
    want = panels.bars_1h(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "c", "v")
    assert last.count() == want.count() and last.join(want, ["symbol", "ts", "v"]).count() == want.count()


def test_paper_account_ignores_bars_delivered_again(spark, sf_dir, tmp_path):
    b = panels.bars_1h(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "c").persist()
    path = str(tmp_path / "bars")
    b.coalesce(1).write.parquet(path)
    b.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = paper.step(stream, 5).writeStream.format("memory").queryName("paper").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.sql("select * from paper")
    assert out.count() == b.count() and out.where("equity <= 0 or peak < equity - 1e-9").isEmpty()


def test_files(spark, sf_dir, tmp_path):
    b = panels.bars_1d(spark, sf_dir).withColumn("tf", F.lit("1d"))
    path = str(tmp_path / "bars")
    assert files.write_bars(b, path) and not files.write_bars(b.limit(0), path)
    assert files.read_bars(spark, path, "1-URGENT", "1d").count() == b.where("symbol = '1-URGENT'").count()
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        json.dump({"symbol": "A/B", "tf": "1h", "t": [1600000000000, 1600003600000000], "o": [1, 2], "h": [1, 2], "l": [1, 2], "c": [1, 2], "v": [1, 2]}, f)
    got = files.read_column_json(spark, str(tmp_path / "x.json.gz")).orderBy("ts").collect()
    assert len(got) == 2 and (got[1]["ts"] - got[0]["ts"]).seconds == 3600
    (tmp_path / "k.csv").write_text("open_time,open,high,low,close,volume,close_time,q,n,t,tq,ignore\n1600000000000,1,2,0.5,1.5,10,1,1,1,1,1,0\n1600003600000000,2,3,1,2.5,10,1,1,1,1,1,0\n")
    assert [r["c"] for r in files.read_candles(spark, str(tmp_path / "k.csv"), "A").orderBy("ts").collect()] == [1.5, 2.5]
    (tmp_path / "s.csv").write_text("date,close\n2020-01-01,10.5\n2020-01-02,.\n2020-01-03,-1\n")
    assert files.read_closes(spark, str(tmp_path / "s.csv")).count() == 1
