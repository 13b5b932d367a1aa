"""Batches of candidates: validated, deduplicated within and against what is registered, capped by family, registered once.

A batch is rows (lane, name, document as JSON). Registration is a commit on a versioned table under the batch's id, which
is a hash of its rows: the same batch again, also after a run that broke off, adds nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import expr
from tidemark.sources.versioned import Conflict, Versioned

BATCH = "lane string, name string, document string"
REGISTERED = "batch string, lane string, name string, document string, hash string, family string"
OUTCOME = "lane string, name string, document string, hash string, family string, reason string"


def identified(batch: DataFrame) -> DataFrame:
    """OUTCOME of each row's document: its hashes, and reason where it isn't one or isn't well formed. Documents are read row by row."""
    kinds = "hash string, family string, reason string"

    @F.pandas_udf(kinds)
    def told(documents: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                doc = json.loads(text)
                problems = expr.problems(doc)
                return (None, None, "; ".join(problems)) if problems else (expr.exact_hash(doc), expr.family_hash(doc), None)
            except (TypeError, ValueError, KeyError, AttributeError) as e:
                return None, None, f"not a document: {type(e).__name__}"

        return pd.DataFrame([one(t) for t in documents], columns=["hash", "family", "reason"])

    return batch.select("lane", "name", "document", told(F.col("document")).alias("t")).select("lane", "name", "document", "t.*")


def screened(batch: DataFrame, registered: DataFrame, cap: int = 4) -> DataFrame:
    """OUTCOME of every row: reason is NULL for those to register.

    Of equal documents the first by (lane, name) counts. A family, registered and new ones together, has `cap` members.
    """
    rows = identified(batch)
    first = F.row_number().over(Window.partitionBy("hash").orderBy("lane", "name", "document"))
    rows = rows.withColumn("_twice", F.col("hash").isNotNull() & (first > 1))
    known = registered.select("hash", F.lit(True).alias("_known")).distinct()
    taken = registered.groupBy("family").agg(F.count("*").alias("_taken"))
    rows = rows.join(known, "hash", "left").join(taken, "family", "left")
    fresh = F.col("hash").isNotNull() & ~F.col("_twice") & F.col("_known").isNull()
    place = F.sum(fresh.cast("int")).over(Window.partitionBy("family").orderBy("lane", "name", "document").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_place", place + F.coalesce("_taken", F.lit(0)))
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_known"), "registered").when(F.col("_twice"), "twice in the batch").when(F.col("_place") > cap, "family is full")
    return rows.select("lane", "name", "document", "hash", "family", why.alias("reason"))


def batch_id() -> Column:
    """A hash of the rows in any order, as an aggregate."""
    sums = [F.sum(F.xxhash64(F.lit(seed), "lane", "name", "document").cast("decimal(20,0)")) for seed in (1, 2)]
    return F.sha2(F.concat_ws("|", *sums, F.count("*")), 256)


def register(batch: DataFrame, table: Versioned, cap: int = 4) -> DataFrame:
    """Registers a batch and returns its rows that are registered now, by this run or an earlier one of the same batch."""
    own = batch.select(*[F.col(c.split()[0]) for c in BATCH.split(", ")])
    name = own.agg(batch_id().alias("b")).first()["b"]
    while True:
        version, there = table.read(REGISTERED)
        if not there.where(F.col("batch") == name).isEmpty():
            return there.where(F.col("batch") == name)
        new = screened(own, there, cap).where("reason is null").select(F.lit(name).alias("batch"), "lane", "name", "document", "hash", "family")
        try:
            version = table.append(new, version)
        except Conflict:
            continue
        return table.read(REGISTERED, version)[1].where(F.col("batch") == name)
