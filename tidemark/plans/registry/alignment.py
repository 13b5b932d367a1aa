"""Alignment of streams as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.plans import expr
from tidemark.plans.registry.base import BARS_1D, BARS_1H, DAY, HOUR, STAMPS, day, hour, r
from tidemark.sources import panels

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def _hours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = panels.bars_1h(spark, d)
    return b, panels.stamps(spark, d), b.select("symbol").distinct()


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    b, s, keys = _hours(spark, d)
    out = joins.asof_backward(b, joins.for_each_key(s, keys), ["rate"], ["symbol"], ["event_id"])
    return out.select("symbol", hour(), r("rate", 9).alias("rate"))


QUERIES["jon_asof_backward"] = asof_backward
LAST = "s AS (SELECT ts, arg_max(rate, event_id) AS rate FROM stamps GROUP BY ts)"
SQL["jon_asof_backward"] = f"WITH {BARS_1H}, {STAMPS}, {LAST} SELECT symbol, strftime(b.ts, '%Y-%m-%d %H:%M') AS hour, round(s.rate, 9) + 0.0 AS rate FROM bars_1h b ASOF LEFT JOIN s ON b.ts >= s.ts"


def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    b, s, keys = _hours(spark, d)
    return joins.asof_forward_sum(b, joins.for_each_key(s, keys), "rate", ["symbol"]).select("symbol", hour(), r("rate", 9).alias("rate"))


QUERIES["jon_asof_forward"] = asof_forward
SQL["jon_asof_forward"] = f"""WITH {BARS_1H}, {STAMPS}, keys AS (SELECT DISTINCT symbol FROM bars_1h), e AS (SELECT symbol, ts, rate FROM stamps CROSS JOIN keys),
m AS (SELECT e.symbol, b.ts, sum(e.rate) AS rate FROM e ASOF JOIN bars_1h b ON e.symbol = b.symbol AND e.ts <= b.ts GROUP BY ALL)
SELECT symbol, {HOUR}, round(coalesce(rate, 0), 9) + 0.0 AS rate FROM bars_1h LEFT JOIN m USING (symbol, ts)"""


def funding(spark: SparkSession, d: str) -> DataFrame:
    b, s, keys = _hours(spark, d)
    names = ["funding", "fundroc", "fundaccel", "fundzscore", "fundmom"]
    return expr.with_funding(b, s, keys).select("symbol", hour(), *[r(c, 8).alias(c) for c in names])


QUERIES["leaf_funding"] = funding
SQL["leaf_funding"] = f"""WITH {BARS_1H}, {STAMPS}, a AS (SELECT *, coalesce(rate - lag(rate) OVER o, 0) AS roc, row_number() OVER o AS k FROM stamps WINDOW o AS (ORDER BY ts, event_id)),
z AS (SELECT ts, event_id, rate AS funding, roc AS fundroc, CASE WHEN k > 2 THEN roc - lag(roc) OVER o ELSE 0 END AS fundaccel,
  CASE WHEN count(rate) OVER q >= 10 AND stddev_pop(rate) OVER q > 1e-12 THEN (rate - avg(rate) OVER q) / stddev_pop(rate) OVER q ELSE 0 END AS fundzscore, sum(rate) OVER q AS fundmom
  FROM a WINDOW o AS (ORDER BY ts, event_id), q AS (ORDER BY ts, event_id ROWS 20 PRECEDING)),
s AS (SELECT ts, arg_max(funding, event_id) AS funding, arg_max(fundroc, event_id) AS fundroc, arg_max(fundaccel, event_id) AS fundaccel, arg_max(fundzscore, event_id) AS fundzscore, arg_max(fundmom, event_id) AS fundmom FROM z GROUP BY ts)
SELECT symbol, strftime(b.ts, '%Y-%m-%d %H:%M') AS hour, {", ".join(f"round(coalesce({c}, 0), 8) + 0.0 AS {c}" for c in ("funding", "fundroc", "fundaccel", "fundzscore", "fundmom"))} FROM bars_1h b ASOF LEFT JOIN s ON b.ts >= s.ts"""

QUERIES["leaf_clock"] = lambda spark, d: expr.evaluate(panels.bars_1h(spark, d), {"hourutc": {"op": "hourutc"}, "dowutc": {"op": "dowutc"}}).select("symbol", hour(), "hourutc", "dowutc")
SQL["leaf_clock"] = f"WITH {BARS_1H} SELECT symbol, {HOUR}, CAST(hour(ts) AS DOUBLE) AS hourutc, CAST(dayofweek(ts) AS DOUBLE) AS dowutc FROM bars_1h"


def basis(spark: SparkSession, d: str) -> DataFrame:
    """Closes against another venue's, taken from the line items' bars of the same day."""
    spot = panels.bars_li(spark, d).where("symbol = 'N'").select("ts", F.col("c").alias("spot"))
    value = F.when(F.col("spot") > 0, (F.col("c") - F.col("spot")) / F.col("spot")).otherwise(0.0)
    return panels.bars_1d(spark, d).join(spot, "ts", "left").select("symbol", day(), r(value).alias("basis"))


QUERIES["leaf_basis"] = basis
SQL["leaf_basis"] = f"""WITH {BARS_1D}, spot AS (SELECT CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS spot FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
SELECT symbol, {DAY}, round(CASE WHEN spot > 0 THEN (c - spot) / spot ELSE 0 END, 6) + 0.0 AS basis FROM bars_1d LEFT JOIN spot USING (ts)"""

QUERIES["jon_intersection"] = lambda spark, d: joins.intersection(panels.bars_1h(spark, d)).select("symbol", hour(), r("c").alias("c"))
SQL["jon_intersection"] = f"WITH {BARS_1H} SELECT symbol, {HOUR}, round(c, 6) AS c FROM bars_1h WHERE ts IN (SELECT ts FROM bars_1h GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars_1h))"


def streams(spark: SparkSession, d: str) -> DataFrame:
    """Daily returns of each symbol as streams: id, ts, ret, scaled down and floored as returns are."""
    o = Window.partitionBy("symbol").orderBy("ts")
    own = panels.bars_1d(spark, d).withColumn("ret", F.col("c") / F.lag("c").over(o) - 1)
    return own.where("ret is not null").select(F.col("symbol").alias("id"), "ts", F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("ret") / 50)).alias("ret"))


STREAMS = f"""{BARS_1D}, streams AS (SELECT symbol AS id, ts, greatest(-0.05, least(0.05, x / 50)) AS ret FROM (SELECT symbol, ts, c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x FROM bars_1d) WHERE x IS NOT NULL)"""

QUERIES["jon_portfolio_of_all"] = lambda spark, d: joins.mean_of_all(streams(spark, d)).select(day(), r("ret", 9).alias("ret"))
SQL["jon_portfolio_of_all"] = f"WITH {STREAMS} SELECT {DAY}, round(sum(ret) / (SELECT count(DISTINCT id) FROM streams), 9) + 0.0 AS ret FROM streams GROUP BY ts"
QUERIES["jon_portfolio_of_present"] = lambda spark, d: joins.mean_of_present(streams(spark, d)).select(day(), r("ret", 9).alias("ret"))
SQL["jon_portfolio_of_present"] = f"WITH {STREAMS} SELECT {DAY}, round(avg(ret), 9) + 0.0 AS ret FROM streams GROUP BY ts"
QUERIES["jon_pairwise_correlation"] = lambda spark, d: joins.pairwise(streams(spark, d)).select("a", "b", F.col("n").cast("long").alias("n"), r("corr").alias("corr"))
SQL["jon_pairwise_correlation"] = f"WITH {STREAMS} SELECT x.id AS a, y.id AS b, count(*) AS n, round(corr(x.ret, y.ret), 6) + 0.0 AS corr FROM streams x JOIN streams y ON x.ts = y.ts AND x.id < y.id GROUP BY ALL HAVING count(*) > 30"


def lead_lag(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of every stream's return of the row before with every other stream's."""
    s = streams(spark, d)
    o = Window.partitionBy("id").orderBy("ts")
    left = s.select("ts", F.col("id").alias("a"), F.lag("ret").over(o).alias("x")).where("x is not null")
    both = left.join(s.select("ts", F.col("id").alias("b"), F.col("ret").alias("y")), "ts").where("a <> b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), r(F.corr("x", "y")).alias("corr"))


QUERIES["jon_lead_lag"] = lead_lag
SQL["jon_lead_lag"] = f"WITH {STREAMS}, l AS (SELECT id, ts, lag(ret) OVER (PARTITION BY id ORDER BY ts) AS x FROM streams) SELECT l.id AS a, s.id AS b, count(*) AS n, round(corr(x, ret), 6) + 0.0 AS corr FROM l JOIN streams s ON l.ts = s.ts AND l.id <> s.id WHERE x IS NOT NULL GROUP BY ALL"

WINDOWS = [("1996-01-01", "1996-07-01"), ("1996-04-01", "1997-04-01"), ("1998-02-01", "1998-02-15")]


def windows(spark: SparkSession, d: str) -> DataFrame:
    cal = spark.createDataFrame([(k, *x) for k, x in enumerate(WINDOWS)], "window int, start string, end string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    inside = joins.within(panels.bars_1d(spark, d), cal)
    return inside.groupBy("window", "symbol").agg(F.count("*").alias("n"), r(F.max_by("c", "ts") / F.min_by("c", "ts") - 1).alias("ret"))


QUERIES["jon_windows"] = windows
CAL = "cal AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, (a, b) in enumerate(WINDOWS)) + ") AS t(window_no, a, b))"
SQL["jon_windows"] = f'WITH {BARS_1D}, {CAL} SELECT CAST(window_no AS INTEGER) AS "window", symbol, count(*) AS n, round(arg_max(c, ts) / arg_min(c, ts) - 1, 6) + 0.0 AS ret FROM bars_1d JOIN cal ON ts >= a AND ts < b GROUP BY ALL'


def on_day(spark: SparkSession, d: str) -> DataFrame:
    vol = panels.bars_li(spark, d).where("symbol = 'A'").select("ts", F.col("c").alias("vol"))
    return joins.covered(joins.on_day(panels.bars_1d(spark, d), vol, ["vol"]), "vol").select("symbol", day(), r("c").alias("c"), r(F.col("vol") + 2e-9).alias("vol"))


QUERIES["jon_on_day"] = on_day
SQL["jon_on_day"] = f"""WITH {BARS_1D}, v AS (SELECT CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS vol FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT symbol, {DAY}, round(c, 6) AS c, round(vol + 2e-9, 6) AS vol FROM bars_1d JOIN v USING (ts) WHERE vol IS NOT NULL AND vol <> 0"""


def anti(spark: SparkSession, d: str) -> DataFrame:
    o = panels.table(spark, d, "orders")
    seen = panels.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.unseen(o, seen, "o_orderkey").select("o_orderkey", "o_orderpriority")


QUERIES["jon_unseen"] = anti
SQL["jon_unseen"] = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def family_cap(spark: SparkSession, d: str) -> DataFrame:
    c = panels.table(spark, d, "customer")
    return joins.below_family_cap(c, panels.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", 10).select("c_custkey", "c_mktsegment")


QUERIES["jon_family_cap"] = family_cap
SQL["jon_family_cap"] = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10)"


def penalty(spark: SparkSession, d: str) -> DataFrame:
    box = panels.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("until"))
    return joins.penalised(panels.table(spark, d, "customer"), box, "c_custkey", F.lit("2001-01-01").cast("timestamp_ntz")).select("c_custkey", "c_name")


QUERIES["jon_penalty_box"] = penalty
SQL["jon_penalty_box"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01')"


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """A moving average of several lengths at once: parameters as rows, windows by (n, symbol)."""
    params = spark.createDataFrame([(n,) for n in (5, 10, 20)], "n int")
    own = joins.sweep(panels.bars_1d(spark, d), params)
    sums = F.sum("c").over(Window.partitionBy("n", "symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("s", sums).withColumn("past", F.collect_list("s").over(Window.partitionBy("n", "symbol").orderBy("ts").rowsBetween(-20, 0)))
    before = F.when(F.col("i") >= F.col("n"), F.try_element_at("past", -F.col("n") - 1)).otherwise(0.0)
    own = own.where(F.col("i") >= F.col("n") - 1).withColumn("x", (F.col("s") - before) / F.col("n"))
    return own.groupBy("n", "symbol").agg(F.count("*").alias("rows"), F.count_if(F.col("c") > F.col("x")).alias("above"))


QUERIES["jon_parameter_sweep"] = sweep
SQL["jon_parameter_sweep"] = f"""WITH {BARS_1D}, {", ".join(f"m{n} AS (SELECT symbol, i, c, avg(c) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING) AS x FROM bars_1d)" for n in (5, 10, 20))}
{" UNION ALL ".join(f'SELECT CAST({n} AS INTEGER) AS n, symbol, count(*) AS "rows", count(*) FILTER (WHERE c > x) AS above FROM m{n} WHERE i >= {n - 1} GROUP BY symbol' for n in (5, 10, 20))}"""


def lookups(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their nation, their newest order and their orders' number."""
    o = panels.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    n = panels.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookups(panels.table(spark, d, "customer"), {"nation": (n, "c_nationkey"), "orders": (o, "c_custkey")}).select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), "newest")


QUERIES["jon_lookups"] = lookups
SQL["jon_lookups"] = "SELECT c_custkey, n_name, coalesce(orders, 0) AS orders, newest FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS orders, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"
