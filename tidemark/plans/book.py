"""Admission into a book, one candidate after the other: each acceptance changes what the next one is held against.

Admitted streams are a versioned table (tidemark.sources.versioned): an admission is a commit on the version that it was
judged against, so that of two writers one has to judge again. A run that broke off goes on from the table's last version;
candidates that are in it aren't judged again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import portfolio
from tidemark.sources.versioned import Conflict, Versioned

STREAM = "id string, ts timestamp_ntz, ret double"
VERDICT = "id string, admitted boolean, forward_only boolean, reason string, marginal double, max_corr double, book_sharpe double, members int"


def admit(spark: SparkSession, candidates: DataFrame, order: list[str], store: Versioned, per_year: float = 365.0, least_marginal: float = 0.05, most_corr: float = 0.6, least_sharpe: float = 1.0, least_p5: float = 1.0, most_mean_corr: float = 0.5, forward_paper: bool = True, forward_most: int = 12, reps: int = 1000) -> DataFrame:
    """VERDICT of the candidates (id, ts, ret) in order; admitted streams are in the store afterwards.

    Gate A is one job for all. Gates B and C of a candidate are one job against the members so far: B for every candidate
    but the first, C for the book with it. A book below C admits forward only, up to forward_most members. A book has few
    members, so that the driver goes from one to the next.
    """
    own = candidates.select(F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("ret").cast("double").alias("ret")).where(F.col("ret").isNotNull())
    significant = {r["id"]: r["passes"] for r in portfolio.significant(own, per_year, reps).select("id", "passes").collect()}
    out: list[tuple] = []
    for name in order:
        while True:
            version, members = store.read(STREAM)
            there = [r["id"] for r in members.select("id").distinct().collect()]
            row = _judge(own.where(F.col("id") == name), members, name, there, significant.get(name), per_year, (least_marginal, most_corr), (least_sharpe, least_p5, most_mean_corr), forward_paper, forward_most, reps)
            try:
                if row[1] and name not in there:
                    store.append(own.where(F.col("id") == name), version)
                break
            except Conflict:
                continue  # somebody else's member came first: judged again against the new book
        out.append(row)
    return spark.createDataFrame(out, VERDICT)


def _judge(candidate: DataFrame, members: DataFrame, name: str, there: list[str], passes_a: bool | None, per_year: float, b: tuple[float, float], c: tuple[float, float, float], forward_paper: bool, forward_most: int, reps: int) -> tuple:
    if name in there:
        return name, True, None, "already a member", None, None, None, len(there)
    if not passes_a:
        return name, False, None, "not significant", None, None, None, len(there)
    book = members.unionByName(candidate)
    gate = portfolio.book_gate(book, per_year, reps, *c).select("passes", "reasons", "sharpe")
    if there:
        marginal = portfolio.admitted(portfolio.marginal_ratio(book, name, per_year, "erc"), *b)
    else:
        marginal = candidate.sparkSession.range(1).select(F.lit(True).alias("admits"), F.lit("first member").alias("reason"), F.lit(None).cast("double").alias("marginal"), F.lit(None).cast("double").alias("max_corr"))
    r = marginal.crossJoin(gate).first()
    if not r["admits"]:
        return name, False, None, r["reason"], r["marginal"], r["max_corr"], r["sharpe"], len(there)
    if not r["passes"] and not (forward_paper and len(there) < forward_most):
        return name, False, None, r["reasons"], r["marginal"], r["max_corr"], r["sharpe"], len(there)
    return name, True, not r["passes"], r["reason"], r["marginal"], r["max_corr"], r["sharpe"], len(there) + 1
