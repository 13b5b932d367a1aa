"""Forward steps and targets as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans import targets
from tidemark.plans.registry.base import BARS_1D, DAY, day, over, r
from tidemark.plans.registry.returns import CLOSE, const, ind, two
from tidemark.sources import panels
from tidemark.streaming import forward, revisions

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: name, kind, signal, n, z_n, edge, share, lever, vol, cost, idle of the accounts of every symbol.
ACCOUNTS = [
    ("trend", "trend", None, 50, 0, None, None, 1.0, None, 8e-4, None),
    ("index_high", "implied", "index_high", 20, 60, 0.5, None, 1.0, None, 7e-4, None),
    ("index_low", "implied", "index_low", 20, 60, 0.5, None, 1.0, None, 7e-4, None),
    ("gap_high", "implied", "gap_high", 20, 60, 0.5, None, 1.0, None, 7e-4, None),
    ("gap_low", "implied", "gap_low", 20, 60, 0.5, None, 1.0, None, 7e-4, None),
]
BLENDS = [("blend", "blend", None, 30, 0, None, 0.7, 1.0, None, 8e-4, 0.04)]
COINS = [("coins", "coins", None, 30, 0, 55.0, None, 1.45, 0.5, 9e-4, None)]
NAMES = ("candidate", "kind", "signal", "n", "z_n", "edge", "share", "lever", "vol", "cost", "idle")


def feed(spark: SparkSession, d: str, accounts: list[tuple], whole: bool = False) -> DataFrame:
    """Every symbol's daily bars for each account; whole: one account holds all symbols.

    Daily moves of the orders' bars are far above a market's: prices are drawn together. Volumes stand for the index, their
    remainder for funding.
    """
    kinds = dict(c.split() for c in forward.PLAN_KINDS.split(", ")) | {"candidate": "string"}
    plans = F.inline(F.array(*[F.struct(*[F.lit(v).cast(kinds[n]).alias(n) for n, v in zip(NAMES, a, strict=True)]) for a in accounts]))
    daily = panels.bars_1d(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), *[F.exp(F.ln(c) / 50).alias(c) for c in "hlc"], (F.col("v") % 3 / 1e4).alias("rate"), F.col("v").alias("x"))
    own = daily.select("*", plans)
    coins = F.size(F.collect_set("symbol").over(Window.partitionBy("candidate"))) if whole else F.lit(1)
    return own.withColumns({"coins": coins.cast("int"), "candidate": F.col("candidate") if whole else F.concat_ws("|", "symbol", "candidate")})


def steps(df: DataFrame) -> DataFrame:
    return forward.replayed(df).select("candidate", day(), r("ret").alias("ret"), r("equity").alias("equity"), r("weight").alias("weight"), "trades", "halted", "reason")


QUERIES["stm_forward"] = lambda spark, d: steps(feed(spark, d, ACCOUNTS))
QUERIES["stm_forward_blend"] = lambda spark, d: steps(feed(spark, d, BLENDS).withColumn("x", 1 + F.col("x") / 4))
QUERIES["stm_forward_coins"] = lambda spark, d: steps(feed(spark, d, COINS, whole=True))


def _account_sql(a: tuple) -> str:
    name, kind, signal, n, z_n, edge, _, lever, _, cost, _ = a
    if kind == "trend":
        want = f"coalesce(CASE WHEN i >= {n - 1} THEN CAST(c > avg(c) OVER {over(n)} AS DOUBLE) END, 0)"
    else:
        x = "gap" if signal.startswith("gap") else "x"
        z = f"CASE WHEN count({x}) OVER {over(z_n, 1)} >= 20 THEN ({x} - avg({x}) OVER {over(z_n, 1)}) / greatest(stddev_pop({x}) OVER {over(z_n, 1)}, 1e-6) ELSE 0 END"
        want = f"CAST({z} > {edge} AS DOUBLE)" if signal.endswith("high") else f"CAST({z} < -{edge} AS DOUBLE)"
    return f"SELECT symbol || '|{name}' AS candidate, symbol, ts, c, m, rate, {cost} AS cost, {lever} * {want} AS w FROM b2"


SQL["stm_forward"] = f"""WITH {BARS_1D}, b0 AS (SELECT symbol, ts, i, exp(ln(c) / 50) AS c, v AS x, v % 3 / 1e4 AS rate FROM bars_1d),
b1 AS (SELECT *, c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m FROM b0),
b2 AS (SELECT *, x - CASE WHEN count(m) OVER {over(21)} > 5 THEN stddev_pop(m) OVER {over(21)} * sqrt(365) * 100 ELSE 0 END AS gap FROM b1),
ws AS ({" UNION ALL ".join(_account_sql(a) for a in ACCOUNTS)}),
re AS (SELECT *, w <> coalesce(lag(w) OVER o, 0) AS traded, coalesce(lag(w) OVER o, 0) * (coalesce(m, 0) - rate) - abs(w - coalesce(lag(w) OVER o, 0)) * cost AS ret FROM ws WINDOW o AS (PARTITION BY candidate ORDER BY ts)),
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY candidate ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM re),
fa AS (SELECT *, {", ".join(f"equity / max(equity) OVER (PARTITION BY candidate ORDER BY ts RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW) - 1 AS {name}" for days, name, _ in forward.LIMITS)} FROM eq),
ha AS (SELECT *, CASE {" ".join(f"WHEN {name} < {most} THEN '{name} fall'" for _, name, most in forward.LIMITS)} END AS reason FROM fa),
fi AS (SELECT *, coalesce(count(reason) OVER (PARTITION BY candidate ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM ha)
SELECT candidate, {DAY}, round(ret, 6) + 0.0 AS ret, round(equity, 6) AS equity, CASE WHEN reason IS NULL THEN round(w, 6) ELSE 0.0 END AS weight, CAST(traded AS INTEGER) AS trades, reason IS NOT NULL AS halted, reason FROM fi WHERE ended = 0"""

#: A document of both sides without kernels that depend on their own past but for the stops' true range.
BOTH = {
    "longEntry": two("gt", ind("roc", CLOSE, 10), const(0.3)), "longExit": two("lt", CLOSE, ind("sma", CLOSE, 20)), "shortEntry": two("lt", ind("roc", CLOSE, 10), const(-0.3)), "shortExit": two("gt", CLOSE, ind("sma", CLOSE, 20)),
    "risk": {"volTargetAnnual": 0.6, "maxLeverage": 2.0, "stopAtrMult": 1.5, "trailActivate": 0.2, "trailOffset": 0.1},
}
KEPT = 900


def cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bars up to each of eight ends, and positions opened 3, 7, 12... bars before at that bar's close, in turn long and short."""
    b = panels.bars_1d(spark, d)
    ends = b.withColumn("n", F.max("i").over(Window.partitionBy("symbol"))).withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(7))))
    name = F.concat_ws("|", "symbol", "cut")
    own = ends.where(F.col("i") <= F.col("n") - 40 * F.col("cut")).select(name.alias("symbol"), "ts", "i", "o", "h", "l", "c", "v")
    last = Window.partitionBy("symbol")
    held = own.withColumn("k", F.max("i").over(last) - F.col("i")).withColumn("cut", F.split("symbol", r"\|")[1].cast("int"))
    held = held.where((F.col("cut") > 0) & (F.col("k") == 2 + 3 * F.col("cut")))
    return own, held.select("symbol", F.when(F.col("cut") % 2 == 1, 1).otherwise(-1).alias("dir"), F.col("c").alias("price"))


def wanted(spark: SparkSession, d: str) -> DataFrame:
    own, held = cases(spark, d)
    return targets.targets(own, BOTH, held, 365, keep=KEPT).select("symbol", day(), "dir", r("weight").alias("weight"), "reason")


QUERIES["stm_targets"] = wanted
SQL["stm_targets"] = f"""WITH RECURSIVE {BARS_1D}, en AS (SELECT *, max(i) OVER (PARTITION BY symbol) AS n, unnest(range(8)) AS cut FROM bars_1d),
a0 AS (SELECT symbol || '|' || cut AS symbol, cut, ts, h, l, c, row_number() OVER (PARTITION BY symbol, cut ORDER BY ts DESC) - 1 AS k FROM en WHERE i <= n - 40 * cut),
he AS (SELECT symbol, CASE WHEN cut % 2 = 1 THEN 1 ELSE -1 END AS was, c AS price FROM a0 WHERE cut > 0 AND k = 2 + 3 * cut),
a1 AS (SELECT symbol, ts, h, l, c, k, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM a0 WHERE k < {KEPT}),
a2 AS (SELECT *, CASE WHEN lag(c, 10) OVER s <> 0 THEN c / lag(c, 10) OVER s - 1 END AS roc, CASE WHEN count(c) OVER {over(20)} = 20 THEN avg(c) OVER {over(20)} END AS m, c / lag(c) OVER s - 1 AS q,
  CASE WHEN i = 0 THEN 0 ELSE greatest(h - l, abs(h - lag(c) OVER s), abs(l - lag(c) OVER s)) END AS tr FROM a1 WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
wi AS (SELECT symbol, i, avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM a2 QUALIFY i = 14
  UNION ALL SELECT a2.symbol, a2.i, (wi.atr * 13 + a2.tr) / 14 FROM wi JOIN a2 ON a2.symbol = wi.symbol AND a2.i = wi.i + 1),
a3 AS (SELECT a2.*, was, price, atr, max(a2.i) OVER (PARTITION BY a2.symbol) AS n FROM a2 LEFT JOIN he USING (symbol) LEFT JOIN wi ON wi.symbol = a2.symbol AND wi.i = a2.i),
a4 AS (SELECT *, coalesce(max(CASE WHEN i >= greatest(1, n - 800) AND abs(c - price) / price < 1e-4 THEN i END) OVER (PARTITION BY symbol), greatest(1, n - 1)) AS e FROM a3),
la AS (SELECT symbol, max(ts) AS ts, max(c) FILTER (WHERE i = n) AS c, coalesce(any_value(was), 0) AS was, any_value(price) AS price, max(roc) FILTER (WHERE i = n) AS roc, max(m) FILTER (WHERE i = n) AS m, max(atr) FILTER (WHERE i = e) AS atr,
  max(c) FILTER (WHERE i >= e) AS top, min(c) FILTER (WHERE i >= e) AS bottom, sum(CASE WHEN i = greatest(1, n - 500) THEN 0.94 ** k * q * q WHEN i > n - 500 THEN 0.06 * 0.94 ** k * q * q END) AS var FROM a4 GROUP BY symbol),
rs AS (SELECT *, CASE WHEN was = 1 AND c < m OR was = -1 AND c > m THEN 'exit' WHEN was <> 0 AND was * c <= was * (price - was * 1.5 * atr) THEN 'stop'
  WHEN was <> 0 AND CASE WHEN was = 1 THEN c / price - 1 ELSE price / c - 1 END >= 0.2 AND CASE WHEN was = 1 THEN top / c - 1 ELSE c / bottom - 1 END >= 0.1 THEN 'trail' END AS reason FROM la),
di AS (SELECT *, CASE WHEN was <> 0 AND reason IS NULL THEN was WHEN roc > 0.3 THEN 1 WHEN roc < -0.3 THEN -1 ELSE 0 END AS dir FROM rs)
SELECT symbol, {DAY}, CAST(dir AS INTEGER) AS dir, round(dir * CASE WHEN var > 1e-12 THEN least(2.0, sqrt(0.6 ** 2 / 365 / var)) ELSE 1 END, 6) + 0.0 AS weight, reason FROM di"""


def corrected(spark: SparkSession, d: str) -> DataFrame:
    """Events as corrections of a value of their kind, day and quarter of hours: two in three of most days are stored, the others come late."""
    e = panels.table(spark, d, "events").select(F.col("event_type").alias("key"), F.to_date("ts").alias("day"), F.concat(F.lit("h"), F.hour("ts") % 4).alias("metric"), F.col("value").cast("double").alias("value"), F.col("event_id").cast("long").alias("rev"))
    first = e.where(F.col("rev") % 3 != 0)
    stored = revisions.merged(first.limit(0), first.where(F.datediff("day", F.lit("1970-01-01")) % 30 < 25))
    return revisions.revised(stored, e.where(F.col("rev") % 3 == 0)).select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), "metric", r("value").alias("value"), "rev")


QUERIES["stm_revisions"] = corrected
SQL["stm_revisions"] = """WITH e AS (SELECT event_type AS key, CAST(ts AS DATE) AS day, 'h' || (hour(ts) % 4) AS metric, CAST(value AS DOUBLE) AS value, CAST(event_id AS BIGINT) AS rev FROM events),
old AS (SELECT * FROM e WHERE rev % 3 <> 0 AND date_diff('day', DATE '1970-01-01', day) % 30 < 25), la AS (SELECT key, max(day) AS last FROM old GROUP BY key),
al AS (SELECT * FROM old UNION ALL SELECT e.* FROM e LEFT JOIN la USING (key) WHERE rev % 3 = 0 AND (last IS NULL OR day >= last - INTERVAL 5 DAY))
SELECT key, strftime(day, '%Y-%m-%d') AS day, metric, round(arg_max(value, (rev, value)), 6) + 0.0 AS value, max(rev) AS rev FROM al GROUP BY ALL"""
