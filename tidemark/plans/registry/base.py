"""Panels as SQL, and rounding on either side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BARS_1D = """bars_1d AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM (
    SELECT o_orderpriority AS symbol, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts,
      arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l,
      arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS c, CAST(count(*) AS DOUBLE) AS v
    FROM orders GROUP BY ALL))"""
BARS_1H = """bars_1h AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM (
    SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
      arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, CAST(count(*) AS DOUBLE) AS v
    FROM events GROUP BY event_type, date_trunc('hour', ts)))"""
BARS_LI = """bars_li AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM (
    SELECT l_returnflag AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
      arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS o, max(l_extendedprice / l_quantity) AS h, min(l_extendedprice / l_quantity) AS l,
      arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS c, sum(l_quantity) AS v
    FROM lineitem GROUP BY ALL))"""
STAMPS = """stamps AS (SELECT ts, event_id, value / 1e6 AS rate FROM events WHERE event_type = 'error')"""


def day(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd").alias("day")


def hour(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm").alias("hour")


DAY, HOUR = "strftime(ts, '%Y-%m-%d') AS day", "strftime(ts, '%Y-%m-%d %H:%M') AS hour"


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def over(n: int, end: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"
