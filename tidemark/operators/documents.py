"""Tables of documents: lookups, lists, upserts, retention, summaries. Writes give the new table; sinks store it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, at: str, n: int, tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def leaderboard(rows: DataFrame, score: str, n: int, dead: tuple[str, ...] = ("failed", "archived"), tie: str = "id") -> DataFrame:
    return rows.where(F.col(score).isNotNull() & ~F.col("stage").isin(*dead)).orderBy(F.desc(score), tie).limit(n)


def latest(rows: DataFrame, key: tuple[str, ...], at: str) -> DataFrame:
    """One row for each key: the one loaded last."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Every key of either side; a column that the new row doesn't know keeps its old value."""
    rest = [c for c in old.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in rest if c in new.columns])
    joined = old.join(n, list(key), "full")
    return joined.select(*key, *[(F.coalesce(F.col(f"_{c}"), F.col(c)) if c in new.columns else F.col(c)).alias(c) for c in rest])


def append_new(old: DataFrame, new: DataFrame, by: tuple[str, ...], ts: str = "ts", closed: Column | None = None) -> DataFrame:
    """The new rows after the last stored one of their key; rows that `closed` doesn't hold for are left out."""
    last = old.groupBy(*by).agg(F.max(ts).alias("_last"))
    own = new if closed is None else new.where(closed)
    return own.join(last, list(by), "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key isn't stored, one for each key."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def counters(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.sum("amount").alias("value"))


def stripped(rows: DataFrame, column: str, at: str, before: Column, score: str, top: int, tie: str = "id") -> DataFrame:
    """rows without the column's value where failed before a date, except the best `top` by score."""
    best = rows.where(F.col(score).isNotNull()).orderBy(F.desc(score), tie).limit(top).select(F.col(tie).alias("_best"))
    own = rows.join(F.broadcast(best), F.col(tie) == F.col("_best"), "left")
    old = (F.col("stage") == "failed") & (F.col(at) < before) & F.col("_best").isNull()
    return own.withColumn(column, F.when(~old, F.col(column))).drop("_best")


def with_last_children(parents: DataFrame, children: DataFrame, key: str, at: str, n: int, columns: tuple[str, ...]) -> DataFrame:
    """parents with an array of their last n children, newest first. A parent's children are cut before they meet."""
    w = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in columns])
    last = children.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    own = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("children"))
    return parents.join(own, key, "left")


def rollback(rows: DataFrame) -> DataFrame:
    """The archived row to bring back: the newest by its update."""
    return rows.where(F.col("stage") == "archived").agg(F.max_by(F.struct(*rows.columns), F.struct("updated", "id")).alias("r")).select("r.*")


def union_of_modes(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def json_score(metrics: Column, *paths: str) -> Column:
    """The first number of several places of a JSON text."""
    return F.coalesce(*[F.get_json_object(metrics, p).cast("double") for p in paths])


def reason(note: Column) -> Column:
    """A note's kind, by how it begins, with the number that it names."""
    number = F.regexp_extract(note, r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(F.startswith(note, F.lit("stop")), F.concat(F.lit("stopped at "), number)).when(F.startswith(note, F.lit("flip")), F.lit("turned")).when(note.rlike("(?i)kill"), F.lit("killed")).otherwise(F.coalesce(F.nullif(note, F.lit("")), F.lit("held")))


def stage_name(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern that fits."""
    out = F.lit("other")
    for pattern, name in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out
