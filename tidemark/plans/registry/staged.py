"""The staged validation, perturbed parameters, admission into a book and registration of batches as queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import batches, book, gauntlet
from tidemark.plans.registry.alignment import streams
from tidemark.plans.registry.base import BARS_1D, over, r
from tidemark.plans.registry.returns import CLOSE, COST, DRAW, RETURNS_SQL, _sharpe_sql, const, two
from tidemark.session import shared_folder
from tidemark.sources import panels
from tidemark.sources.versioned import Versioned

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def with_length(op: str, default: float) -> tuple[dict, dict]:
    """A kernel of the close with a length n as parameter, and the parameter."""
    return {"op": op, "src": CLOSE, "period": {"op": "param", "name": "n"}}, {"n": {"min": 2.0, "max": 100.0, "default": default, "int": True}}


def document(enter: Callable[[dict], dict], leave: Callable[[dict], dict], op: str) -> dict:
    kernel, params = with_length(op, 20.0)
    return {"longEntry": enter(kernel), "longExit": leave(kernel), "params": params, "risk": {"volTargetAnnual": 0.5, "maxLeverage": 1.0}, "tf": "1d", "hypothesis": "closes relative to their own past"}


def above(k: dict) -> dict:
    return two("gt", CLOSE, k)


def below(k: dict) -> dict:
    return two("lt", CLOSE, k)


LENGTHS = (10, 20, 40)
CONFIGS = [{"n": float(n)} for n in LENGTHS]
CANDIDATES = [
    gauntlet.Candidate("trend", document(above, below, "sma"), CONFIGS),
    gauntlet.Candidate("reversal", document(below, above, "sma"), CONFIGS),
    gauntlet.Candidate("momentum", document(lambda k: two("gt", k, const(0)), lambda k: two("lt", k, const(0)), "roc"), CONFIGS),
    gauntlet.Candidate("channel", document(lambda k: two("lt", CLOSE, {"op": "lag", "src": k, "period": const(1)}), above, "lowest"), CONFIGS),
    gauntlet.Candidate("unsound", {**document(above, below, "sma"), "hypothesis": "none"}, CONFIGS),
]
FIRST, SEAL, PRIMARY = "1995-01-01", "2000-06-01", "1-URGENT"


def squeezed(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars with prices drawn together: moves of the orders' bars are far above a market's."""
    return panels.bars_1d(spark, d).withColumns({x: F.exp(F.ln(x) / 50) for x in "ohlc"})


def setting(spark: SparkSession, d: str) -> gauntlet.Setting:
    return gauntlet.Setting(squeezed(spark, d), PRIMARY, FIRST, SEAL, cost=COST)


def judged(spark: SparkSession, d: str, stages: tuple[str, ...]) -> DataFrame:
    own = gauntlet.Gauntlet(spark, CANDIDATES, setting(spark, d), shared_folder(spark), f"batch-{uuid.uuid4().hex}")
    if stages[-1] == "S4":
        out = own.spark.createDataFrame([(n,) for n, why in own.static.items()], "candidate string")
        failed = F.when(F.col("candidate").isin([n for n, why in own.static.items() if why]), "S0")
        for s in stages:
            out = out.join(own.stage(s).withColumnRenamed("reason", f"_{s}"), "candidate", "left")
            failed = failed.when(F.col(f"_{s}").isNotNull(), F.concat_ws(" ", F.lit(s), f"_{s}"))
        return out.withColumn("failed", failed)
    return own.judged()


FIGURES = [f for s in ("S2", "S3", "S4") for f in gauntlet.STAGES[s] if f not in ("config", "wf_windows")]
QUERIES["vld_gauntlet"] = lambda spark, d: judged(spark, d, ("S2", "S3", "S4")).select("candidate", "failed", "config", "wf_windows", *[r(c, 5).alias(c) for c in FIGURES])
QUERIES["vld_gauntlet_whole"] = lambda spark, d: judged(spark, d, tuple(gauntlet.STAGES))

_KERNEL = {
    "trend": lambda n: (f"CASE WHEN count(c) OVER {over(n)} = {n} THEN avg(c) OVER {over(n)} END", "c > k", "c < k"),
    "reversal": lambda n: (f"CASE WHEN count(c) OVER {over(n)} = {n} THEN avg(c) OVER {over(n)} END", "c < k", "c > k"),
    "momentum": lambda n: (f"CASE WHEN lag(c, {n}) OVER (PARTITION BY symbol ORDER BY ts) <> 0 THEN c / lag(c, {n}) OVER (PARTITION BY symbol ORDER BY ts) - 1 END", "k > 0", "k < 0"),
    "channel": lambda n: (f"CASE WHEN count(c) OVER {over(n)} = {n} THEN min(c) OVER {over(n)} END", "c < lag(k) OVER (PARTITION BY symbol ORDER BY ts)", "c > k"),
}
BASE = f"""{BARS_1D}, b0 AS (SELECT symbol, ts, i, exp(ln(c) / 50) AS c FROM bars_1d WHERE ts < TIMESTAMP '{SEAL}'),
ev AS ({" UNION ALL ".join(f"SELECT '{name}|' || symbol || '|{k}' AS symbol, ts, i, c, coalesce({enter}, false) AS enter, coalesce({leave}, false) AS leave FROM (SELECT *, {kernel} AS k FROM b0)" for name, of in _KERNEL.items() for k, n in enumerate(LENGTHS) for kernel, enter, leave in [of(n)])}),
p AS (SELECT *, CAST(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INTEGER) AS dir FROM (SELECT *, CASE WHEN i = 0 THEN 0 WHEN enter THEN 1 WHEN leave THEN 0 END AS e FROM ev)),
{RETURNS_SQL},
ru AS (SELECT split_part(x.symbol, '|', 1) AS candidate, split_part(x.symbol, '|', 2) AS sym, CAST(split_part(x.symbol, '|', 3) AS INTEGER) AS config, ts, i, ret, CAST(dir <> 0 AND dir <> coalesce(lag(dir) OVER (PARTITION BY x.symbol ORDER BY ts), 0) AS INTEGER) AS entry FROM x)"""


def _fall(table: str, by: str) -> str:
    paths = f"SELECT {by}, ts, sum(ln(1 + ret)) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM {table}"
    tops = f"SELECT {by}, l, max(l) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS t FROM ({paths})"
    return f"(SELECT {by}, least(0, min(exp(l - greatest(0, t)) - 1)) AS f FROM ({tops}) GROUP BY {by})"


SQL["vld_gauntlet"] = f"""WITH {BASE},
tr AS (SELECT * FROM ru WHERE sym = '{PRIMARY}' AND i >= 1 AND i <= floor(0.7::DOUBLE * (SELECT max(i) FROM b0 WHERE symbol = '{PRIMARY}'))),
t1 AS (SELECT candidate, config, {_sharpe_sql("ret")} AS train_sharpe, sum(entry) / greatest(0.1, max(i) / 365.0) AS trades FROM tr GROUP BY candidate, config QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY round(train_sharpe, 12) DESC, config) = 1),
s2 AS (SELECT *, CASE WHEN NOT train_sharpe >= 0.8 THEN 'S2 train_sharpe' WHEN NOT trades >= ceil(30 * 0.35) THEN 'S2 train_trades_per_year' WHEN NOT f >= -0.35 THEN 'S2 train_max_dd' END AS bad FROM t1 JOIN {_fall("tr", "candidate, config")} USING (candidate, config)),
cal AS (SELECT row_number() OVER (ORDER BY t) - 1 AS k, t - INTERVAL 360 DAY AS a, t AS b, t + INTERVAL 30 DAY AS e FROM (SELECT unnest(generate_series(TIMESTAMP '{FIRST}' + INTERVAL 360 DAY, TIMESTAMP '{SEAL}' - INTERVAL 30 DAY, INTERVAL 30 DAY)) AS t)),
wf AS (SELECT candidate, sym, k, config, CASE WHEN stddev_pop(ret) FILTER (WHERE ts < b - INTERVAL 10 DAY) > 1e-12 THEN avg(ret) FILTER (WHERE ts < b - INTERVAL 10 DAY) / stddev_pop(ret) FILTER (WHERE ts < b - INTERVAL 10 DAY) ELSE 0 END AS s, exp(coalesce(sum(ln(1 + ret)) FILTER (WHERE ts >= b), 0)) - 1 AS g, count(*) FILTER (WHERE ts >= b) AS n FROM ru JOIN cal ON ts >= a AND ts < e GROUP BY candidate, sym, k, config QUALIFY row_number() OVER (PARTITION BY candidate, sym, k ORDER BY s DESC, config) = 1),
ch AS (SELECT * FROM wf WHERE n > 0), oo AS (SELECT candidate, sym, ts, ret FROM ru JOIN ch USING (candidate, sym, config) JOIN cal USING (k) WHERE ts >= b AND ts < e),
fi AS (SELECT * FROM (SELECT candidate, sym, count(*) AS wf_windows, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS wf_positive, min(g) AS wf_worst FROM ch GROUP BY ALL) JOIN (SELECT candidate, sym, {_sharpe_sql("ret")} AS wf_sharpe FROM oo GROUP BY ALL) USING (candidate, sym) JOIN {_fall("oo", "candidate, sym")} USING (candidate, sym)),
s3 AS (SELECT *, CASE WHEN wf_windows < 12 THEN 'S3 wf_windows' WHEN NOT wf_sharpe >= 0.2 THEN 'S3 wf_sharpe' WHEN NOT wf_positive >= 0.4 THEN 'S3 wf_positive' WHEN NOT wf_worst >= -0.22 THEN 'S3 wf_worst' WHEN NOT f >= -0.35 THEN 'S3 wf_max_dd' END AS bad FROM fi WHERE sym = '{PRIMARY}'),
po AS (SELECT candidate, ts, sum(ret) / any_value(n) AS ret FROM oo JOIN (SELECT candidate, count(DISTINCT sym) AS n FROM oo GROUP BY candidate) USING (candidate) GROUP BY candidate, ts),
mo AS (SELECT candidate, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS port_positive, min(g) AS port_worst FROM (SELECT candidate, exp(sum(ln(1 + ret))) - 1 AS g FROM po GROUP BY candidate, strftime(ts, '%Y-%m')) GROUP BY candidate),
s4 AS (SELECT *, CASE WHEN NOT symbols_positive >= 3 THEN 'S4 symbols_positive' WHEN NOT port_sharpe >= 0.7 THEN 'S4 port_sharpe' WHEN NOT port_positive >= 0.55 THEN 'S4 port_positive' WHEN NOT port_worst >= -0.12 THEN 'S4 port_worst' END AS bad
  FROM (SELECT candidate, count(*) FILTER (WHERE sym = '{PRIMARY}' OR wf_sharpe > 0 AND wf_positive >= 0.5) AS symbols_positive FROM fi GROUP BY candidate) JOIN (SELECT candidate, {_sharpe_sql("ret")} AS port_sharpe FROM po GROUP BY candidate) USING (candidate) JOIN mo USING (candidate) JOIN {_fall("po", "candidate")} USING (candidate)),
al AS (SELECT unnest(['trend', 'reversal', 'momentum', 'channel', 'unsound']) AS candidate)
SELECT candidate, CASE WHEN candidate = 'unsound' THEN 'S0' ELSE coalesce(s2.bad, s3.bad, s4.bad) END AS failed, s2.config, round(s2.train_sharpe, 5) + 0.0 AS train_sharpe, round(s2.trades, 5) AS train_trades_per_year, round(s2.f, 5) + 0.0 AS train_max_dd,
  CASE WHEN s2.bad IS NULL THEN s3.wf_windows END AS wf_windows, {", ".join(f"CASE WHEN s2.bad IS NULL THEN round(s3.{a}, 5) + 0.0 END AS {b}" for a, b in (("wf_sharpe", "wf_sharpe"), ("wf_positive", "wf_positive"), ("wf_worst", "wf_worst"), ("f", "wf_max_dd")))},
  {", ".join(f"CASE WHEN s2.bad IS NULL AND s3.bad IS NULL THEN round(s4.{a}, 5) + 0.0 END AS {b}" for a, b in (("symbols_positive", "symbols_positive"), ("port_sharpe", "port_sharpe"), ("port_positive", "port_positive"), ("port_worst", "port_worst"), ("f", "port_max_dd")))}
FROM al LEFT JOIN s2 USING (candidate) LEFT JOIN s3 USING (candidate) LEFT JOIN s4 USING (candidate)"""

QUERIES["vld_perturbed"] = lambda spark, d: gauntlet.perturbed(squeezed(spark, d), CANDIDATES[1].doc, {"n": 20.0}, COST, 365).select("symbol", r("base").alias("base"), r("mean").alias("mean"), "survives")
SQL["vld_perturbed"] = f"""WITH {BARS_1D}, b0 AS (SELECT symbol AS s0, ts, i, exp(ln(c) / 50) AS c FROM bars_1d), dw AS (SELECT unnest(range(8)) AS k), {DRAW.format(seed=99, draw="k", table="dw")},
le AS (SELECT k + 1 AS config, CAST(floor(least(100, greatest(2, 20 * (1 + (2 * u - 1) * 0.15))) + 0.5) AS BIGINT) AS n FROM u UNION ALL SELECT 0, 20),
cu AS (SELECT s0, i, sum(c) OVER (PARTITION BY s0 ORDER BY i ROWS UNBOUNDED PRECEDING) AS z FROM b0 UNION ALL SELECT DISTINCT s0, -1, 0 FROM b0),
ev AS (SELECT b0.s0 || '|' || config AS symbol, b0.ts, b0.i, b0.c, (x.z - y.z) / n AS k FROM b0 CROSS JOIN le JOIN cu x ON x.s0 = b0.s0 AND x.i = b0.i LEFT JOIN cu y ON y.s0 = b0.s0 AND y.i = b0.i - n),
p AS (SELECT *, CAST(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INTEGER) AS dir FROM (SELECT *, CASE WHEN i = 0 THEN 0 WHEN coalesce(c < k, false) THEN 1 WHEN coalesce(c > k, false) THEN 0 END AS e FROM ev)),
{RETURNS_SQL}, sh AS (SELECT split_part(x.symbol, '|', 1) AS symbol, CAST(split_part(x.symbol, '|', 2) AS INTEGER) AS config, {_sharpe_sql("ret")} AS s FROM x GROUP BY x.symbol),
me AS (SELECT symbol, max(s) FILTER (WHERE config = 0) AS base, avg(s) FILTER (WHERE config > 0) AS mean FROM sh GROUP BY symbol)
SELECT symbol, round(base, 6) + 0.0 AS base, round(mean, 6) + 0.0 AS mean, base > 0 AND mean > 0.6 * base AS survives FROM me"""


def admission(spark: SparkSession, d: str) -> DataFrame:
    """Streams offered to a new book one after the other."""
    own = streams(spark, d)
    order = [r["id"] for r in own.select("id").distinct().orderBy("id").collect()]
    store = Versioned(spark, f"{shared_folder(spark)}/book-{uuid.uuid4().hex}")
    return book.admit(spark, own, order, store).select("id", "admitted", "forward_only", "reason", *[r(c, 5).alias(c) for c in ("marginal", "max_corr", "book_sharpe")], "members")


QUERIES["pip_admission"] = admission


def parts_as_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document for every part: one of three kernels over its size; some are no documents, some have no hypothesis."""
    op = F.element_at(F.array(*map(F.lit, ("sma", "highest", "median"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    kernel = lambda: F.struct(op.alias("op"), F.struct(F.lit("price").alias("op"), F.lit("close").alias("field")).alias("src"), F.struct(F.lit("const").alias("op"), F.col("p_size").cast("double").alias("value")).alias("period"))
    close = lambda: F.struct(F.lit("price").alias("op"), F.lit("close").alias("field"))
    risk = F.struct(F.lit(0.5).alias("volTargetAnnual"), F.lit(1.0).alias("maxLeverage"))
    why = F.when(F.col("p_partkey") % 11 == 0, "none").otherwise("closes against their past")
    doc = F.to_json(F.struct(F.struct(F.lit("gt").alias("op"), close().alias("a"), kernel().alias("b")).alias("longEntry"), F.struct(F.lit("lt").alias("op"), close().alias("a"), kernel().alias("b")).alias("longExit"), risk.alias("risk"), why.alias("hypothesis")))
    doc = F.when(F.col("p_partkey") % 13 != 0, doc).otherwise("no document")
    return panels.table(spark, d, "part").select(F.concat(F.lit("lane"), F.col("p_partkey") % 2).alias("lane"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("name"), doc.alias("document"), "p_partkey")


def batch(spark: SparkSession, d: str) -> DataFrame:
    """Three parts in four as a batch, against a table in which the others of up to 40 are registered."""
    every = parts_as_documents(spark, d)
    old = batches.screened(every.where("p_partkey % 4 = 0").drop("p_partkey"), spark.createDataFrame([], batches.REGISTERED), 30).where("reason is null").withColumn("batch", F.lit("old"))
    out = batches.screened(every.where("p_partkey % 4 <> 0").drop("p_partkey"), old, 40)
    return out.select("lane", "name", F.regexp_extract("reason", "^(no hypothesis|not a document|registered|twice in the batch|family is full)", 1).alias("reason"))


QUERIES["gen_batch"] = batch
_SCREEN = """SELECT *, CASE WHEN key IS NULL THEN CASE WHEN k % 13 = 0 THEN 'not a document' ELSE 'no hypothesis' END WHEN known THEN 'registered' WHEN again > 1 THEN 'twice in the batch' WHEN place > {cap} THEN 'family is full' END AS reason
  FROM (SELECT *, taken + sum(CASE WHEN key IS NOT NULL AND NOT known AND again = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY lane, name ROWS UNBOUNDED PRECEDING) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lane, name) AS again FROM {rows}))"""
SQL["gen_batch"] = f"""WITH al AS (SELECT 'lane' || (p_partkey % 2) AS lane, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS name, p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN (p_partkey % 3) || '|' || p_size END AS key, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN p_partkey % 3 END AS family FROM part),
o0 AS (SELECT *, false AS known, 0 AS taken FROM al WHERE k % 4 = 0), old AS (SELECT * FROM ({_SCREEN.format(cap=30, rows="o0")}) WHERE reason IS NULL),
n0 AS (SELECT al.*, coalesce(al.key IN (SELECT key FROM old), false) AS known, coalesce((SELECT count(*) FROM old WHERE old.family = al.family), 0) AS taken FROM al WHERE k % 4 <> 0)
SELECT lane, name, reason FROM ({_SCREEN.format(cap=40, rows="n0")})"""
