"""A shuffled feed of corrections ends with the last values; months that a batch doesn't touch keep their files."""

import glob
import os
import random
from datetime import date, timedelta

from tidemark.streaming import revisions


def rows_of(df):
    return sorted(tuple(r[c] for c in revisions.COLUMNS) for r in df.collect())


def corrections(seed=2):
    rng, rows, rev = random.Random(seed), [], 0
    for d in range(70):
        for late in range(4):  # the same day again up to three days later
            if late == 0 or rng.random() < 0.4:
                for key in ("A", "B"):
                    rev += 1
                    rows.append((d + late, (key, date(2020, 1, 1) + timedelta(days=d), rng.choice(["x", "y"]), float(rng.randint(0, 99)), rev)))
    return rows


def test_stream_of_shuffled_corrections_equals_the_last_values(spark, tmp_path):
    rows = corrections()
    came = {}
    for at, row in rows:
        came.setdefault(at // 2, []).append(row)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(3)
    for k in sorted(came):
        own = came[k] + came.get(k - 1, [])[:3]  # some again
        rng.shuffle(own)
        spark.createDataFrame(own, revisions.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(revisions.SCHEMA).option("maxFilesPerTrigger", 6).parquet(path)
    query = revisions.follow(stream, out, str(tmp_path / "check"))
    query.awaitTermination(300)
    assert query.exception() is None
    last = {}
    for _, row in rows:
        if row[4] >= last.get(row[:3], (0,) * 5)[4]:
            last[row[:3]] = row
    assert rows_of(spark.read.parquet(out)) == sorted(last.values())


def test_other_months_are_untouched_and_old_corrections_dropped(spark, tmp_path):
    out = str(tmp_path / "t")
    day = date(2020, 3, 3)
    revisions.store(spark.createDataFrame([("A", date(2020, 1, 9), "x", 1.0, 1), ("A", date(2020, 2, 28), "x", 2.0, 1), ("A", day, "x", 3.0, 1)], revisions.SCHEMA), out, 0)
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/month=2020-01/*.parquet")}
    feed = spark.createDataFrame([("A", date(2020, 1, 9), "x", 9.0, 2), ("A", date(2020, 2, 28), "x", 9.0, 2), ("A", day, "x", 7.0, 0), ("A", day, "y", 5.0, None), (None, day, "x", 1.0, 9), ("A", day, "x", None, 9)], revisions.SCHEMA)
    for _ in range(2):  # again
        revisions.store(feed, out, 1)
    assert rows_of(spark.read.parquet(out).fillna(-1, ["rev"])) == [("A", date(2020, 1, 9), "x", 1.0, 1), ("A", date(2020, 2, 28), "x", 9.0, 2), ("A", day, "x", 3.0, 1), ("A", day, "y", 5.0, -1)]
    assert files == {f: os.path.getmtime(f) for f in glob.glob(f"{out}/month=2020-01/*.parquet")}
    revisions.store(feed.limit(0), out, 2)
    assert spark.read.parquet(out).count() == 4
