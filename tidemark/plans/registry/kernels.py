"""Panels, rolling kernels and recursive kernels as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import recursive
from tidemark.operators import windows as w
from tidemark.plans.registry.base import BARS_1D, BARS_1H, BARS_LI, DAY, HOUR, day, hour, over, r
from tidemark.sources import panels

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


#: Moves values off the middle between two roundings, where engines differ.
NUDGE = 2e-9


def _panel(name: str, maker: Callable, cte: str, label: Callable[[], Column], sql_label: str) -> None:
    QUERIES[f"agg_{name}"] = lambda spark, d: maker(spark, d).select("symbol", label(), F.col("i").cast("int").alias("i"), *[r(F.col(c) + NUDGE).alias(c) for c in "ohlcv"])
    rounded = ", ".join(f"round({c} + {NUDGE}, 6) AS {c}" for c in "ohlcv")
    SQL[f"agg_{name}"] = f"WITH {cte} SELECT symbol, {sql_label}, CAST(i AS INTEGER) AS i, {rounded} FROM {name}"


_panel("bars_1d", panels.bars_1d, BARS_1D, day, DAY)
_panel("bars_1h", panels.bars_1h, BARS_1H, hour, HOUR)
_panel("bars_li", panels.bars_li, BARS_LI, day, DAY)



def close() -> Column:
    return F.col("c")


TR_SQL = "greatest(h - l, abs(h - lag(c) OVER s), abs(l - lag(c) OVER s))"


def _kernel(name: str, value: Callable[[DataFrame], DataFrame], sql: str, extra: str = "", digits: int = 6) -> None:
    """A kernel over daily bars: value gives the column x; sql the same, over named window s, in the CTE k."""
    QUERIES[name] = lambda spark, d: value(panels.bars_1d(spark, d)).select("symbol", day(), r("x", digits).alias("x"))
    SQL[name] = f"WITH {BARS_1D}{extra}, k AS (SELECT symbol, ts, {sql} AS x FROM {'b' if extra else 'bars_1d'} WINDOW s AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, {DAY}, round(x, {digits}) + 0.0 AS x FROM k"


def _column(name: str, column: Callable[[], Column], sql: str, extra: str = "", digits: int = 6) -> None:
    _kernel(name, lambda b: b.withColumn("x", column()), sql, extra, digits)


def _full(n: int, value: str, x: str = "c") -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN {value} END"


_column("win_sma", lambda: w.sma(close(), 20), _full(20, f"avg(c) OVER {over(20)}"))
_column("win_wma", lambda: w.wma(close(), 10), _full(10, "(" + " + ".join(f"lag(c, {j}) OVER s * {10 - j}" for j in range(1, 10)) + " + c * 10) / 55.0"))
_column("win_stdev", lambda: w.stdev(close(), 20), _full(20, f"stddev_pop(c) OVER {over(20)}"), digits=4)
_column("win_highest", lambda: w.highest(F.col("h"), 20), _full(20, f"max(h) OVER {over(20)}", "h"))
_column("win_lowest", lambda: w.lowest(F.col("l"), 20), _full(20, f"min(l) OVER {over(20)}", "l"))
_column("win_lag", lambda: w.lag(close(), 5), "lag(c, 5) OVER s")
_column("win_roc", lambda: w.roc(close(), 10), "CASE WHEN lag(c, 10) OVER s <> 0 THEN c / lag(c, 10) OVER s - 1 END")
_column("win_zscore", lambda: w.zscore(close(), 20), _full(20, f"CASE WHEN stddev_pop(c) OVER {over(20)} > 1e-12 THEN (c - avg(c) OVER {over(20)}) / stddev_pop(c) OVER {over(20)} END"))
_column("win_slope", lambda: w.slope(close(), 15), _full(15, f"CASE WHEN c <> 0 THEN regr_slope(c, CAST(i AS DOUBLE)) OVER {over(15)} / abs(c) END"))
_column("win_pctrank", lambda: w.pctrank(close(), 20), _full(20, f"len(list_filter(list(c) OVER {over(20)}, lambda v: v <= c)) / 20.0"))
_column("win_median", lambda: w.median(close(), 20), _full(20, f"quantile_cont(c, 0.5) OVER {over(20)}"))
_column("win_effratio", lambda: w.effratio(close(), 10), f"CASE WHEN lag(c, 10) OVER s IS NOT NULL THEN CASE WHEN sum(m) OVER {over(10)} > 1e-12 THEN abs(c - lag(c, 10) OVER s) / sum(m) OVER {over(10)} ELSE 0 END END", ", b AS (SELECT *, abs(c - lag(c) OVER (PARTITION BY symbol ORDER BY ts)) AS m FROM bars_1d)")
_column("win_true_range", lambda: w.true_range(), TR_SQL)
_kernel(
    "win_choppiness", lambda b: b.withColumn("tr", w.true_range()).withColumn("x", w.choppiness(14)),
    f"CASE WHEN i >= 14 THEN CASE WHEN max(h) OVER {over(14)} - min(l) OVER {over(14)} > 1e-12 AND sum(tr) OVER {over(14)} > 0 THEN 100 * log10(sum(tr) OVER {over(14)} / (max(h) OVER {over(14)} - min(l) OVER {over(14)})) / log10(14) ELSE 50 END END",
    f", b AS (SELECT *, {TR_SQL} AS tr FROM bars_1d WINDOW s AS (PARTITION BY symbol ORDER BY ts))",
)
_column("win_rangepos", lambda: w.rangepos(20), _full(20, f"CASE WHEN max(h) OVER {over(20)} - min(l) OVER {over(20)} > 1e-12 THEN (c - min(l) OVER {over(20)}) / (max(h) OVER {over(20)} - min(l) OVER {over(20)}) END", "l"))
_column("win_forward_return", lambda: w.forward_return(5), "lead(c, 5) OVER s / c - 1")
_column("win_past_zscore", lambda: w.past_zscore(close(), 60), f"CASE WHEN count(c) OVER {over(60, 1)} >= 20 THEN (c - avg(c) OVER {over(60, 1)}) / greatest(stddev_pop(c) OVER {over(60, 1)}, 1e-6) ELSE 0 END", digits=4)

RET = ", b AS (SELECT *, c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts)) AS lret FROM bars_1d)"


def _with_ret(b: DataFrame) -> DataFrame:
    was = F.lag("c").over(w.order())
    return b.withColumns({"ret": close() / was - 1, "lret": F.ln(close() / was)})


_kernel("win_realised_vol", lambda b: _with_ret(b).withColumn("x", w.realised_vol(F.col("ret"), 30)), f"CASE WHEN count(ret) OVER {over(31)} > 5 THEN stddev_pop(ret) OVER {over(31)} * sqrt(365) * 100 END", RET, 4)
_kernel("win_log_vol", lambda b: _with_ret(b).withColumn("x", w.log_vol(F.col("lret"), 30)), f"CASE WHEN count(lret) OVER {over(30)} >= 15 THEN stddev_pop(lret) OVER {over(30)} END", RET)
_kernel("win_sigma", lambda b: _with_ret(b).withColumn("x", w.sigma_and_volume(F.col("ret"), 20)[0]), f"CASE WHEN count(ret) OVER {over(20)} >= 10 THEN stddev_pop(ret) OVER {over(20)} END", RET)
_kernel("win_adv", lambda b: _with_ret(b).withColumn("x", w.sigma_and_volume(F.col("ret"), 20)[1] / 1e6), f"CASE WHEN count(v * c) OVER {over(20)} >= 5 THEN avg(v * c) OVER {over(20)} / 1e6 END", RET)
_kernel("win_equity", lambda b: _with_ret(b).withColumn("x", F.ln(w.equity(F.col("ret") / 100))), "sum(ln(1 + greatest(coalesce(ret / 100, 0), -0.95))) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)", RET)
_column("win_drawdown", lambda: w.drawdown(close()), "c / max(c) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1")
_column("win_rebased", lambda: w.rebased(close()), "c / first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_column("win_drawdown_within", lambda: w.drawdown_within(close(), 30), "c / max(c) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) - 1")
_kernel("win_carried", lambda b: b.withColumn("y", F.when(F.col("i") % 7 == 0, close())).withColumn("x", w.lag(w.carried(F.col("y")), 1)), "lag(x0) OVER s", ", b0 AS (SELECT *, CASE WHEN i % 7 = 0 THEN c END AS y FROM bars_1d), b AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS x0 FROM b0)")
_kernel("rnk_average_rank", lambda b: b.withColumn("x", w.average_rank(F.col("v"))), "rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0")

MARKET = ", m AS (SELECT *, c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars_1d), b AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS mkt FROM m)"


def _with_market(b: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return _with_ret(b).withColumn("mkt", F.avg("ret").over(Window.partitionBy("ts")))


_kernel(
    "win_past_beta", lambda b: _with_market(b).withColumn("x", w.past_beta(F.col("ret"), F.col("mkt"), 60)),
    f"least(greatest(coalesce(CASE WHEN count(ret) OVER {over(60, 1)} >= 2 AND abs(var_pop(mkt) OVER {over(60, 1)}) >= 1e-12 THEN covar_pop(ret, mkt) OVER {over(60, 1)} / var_pop(mkt) OVER {over(60, 1)} END, 1), 0), 3)", MARKET, 4,
)
_kernel(
    "win_past_lead_lag", lambda b: _with_market(b).withColumn("lm", w.lag(F.col("mkt"), 1)).withColumn("x", w.past_lead_lag(F.col("lm"), F.col("ret"), 60)),
    f"CASE WHEN count(CASE WHEN lm IS NOT NULL AND ret IS NOT NULL THEN 1 END) OVER {over(60, 1)} > 30 AND stddev_pop(lm) OVER {over(60, 1)} > 0 AND stddev_pop(ret) OVER {over(60, 1)} > 0 THEN corr(lm, ret) OVER {over(60, 1)} ELSE 0 END",
    MARKET.replace(", b AS", ", b1 AS") + ", b AS (SELECT *, lag(mkt) OVER (PARTITION BY symbol ORDER BY ts) AS lm FROM b1)", 4,
)

LEADS = {"ema": 20, "rsi": 14, "atr": 14, "adx": 14}


def _recursive(name: str, of: Callable, sql: str, digits: int = 4) -> None:
    QUERIES[name] = lambda spark, d: recursive.apply(panels.bars_1d(spark, d), {"x": of}).select("symbol", day(), r("x", digits).alias("x"))
    SQL[name] = f"WITH RECURSIVE {BARS_1D}, {sql} SELECT symbol, {DAY}, round(x, {digits}) + 0.0 AS x FROM k"


_recursive("rec_ema", recursive.of("ema", "c", n=20), """e AS (
  SELECT symbol, i, avg(c) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) AS x FROM bars_1d QUALIFY i = 19
  UNION ALL SELECT e.symbol, b.i, b.c * (2.0 / 21) + e.x * (1 - 2.0 / 21) FROM e JOIN bars_1d b ON b.symbol = e.symbol AND b.i = e.i + 1),
k AS (SELECT b.symbol, b.ts, e.x FROM bars_1d b LEFT JOIN e USING (symbol, i))""")  # fmt: skip
MOVES = "d AS (SELECT symbol, ts, i, c - lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS m, greatest(h - l, abs(h - lag(c) OVER (PARTITION BY symbol ORDER BY ts)), abs(l - lag(c) OVER (PARTITION BY symbol ORDER BY ts))) AS tr FROM bars_1d)"
_recursive("rec_rsi", recursive.of("rsi", "c", n=14), MOVES + """, e AS (
  SELECT symbol, i, avg(greatest(m, 0)) OVER q AS up, avg(greatest(-m, 0)) OVER q AS down FROM d WHERE i > 0 WINDOW q AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) QUALIFY i = 14
  UNION ALL SELECT e.symbol, d.i, (e.up * 13 + greatest(d.m, 0)) / 14, (e.down * 13 + greatest(-d.m, 0)) / 14 FROM e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1),
k AS (SELECT b.symbol, b.ts, CASE WHEN e.down = 0 THEN 100 ELSE 100 - 100 / (1 + e.up / e.down) END AS x FROM bars_1d b LEFT JOIN e USING (symbol, i))""")  # fmt: skip
_recursive("rec_atr", recursive.of("atr", "h", "l", "c", n=14), MOVES + """, e AS (
  SELECT symbol, i, avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS x FROM d WHERE i > 0 QUALIFY i = 14
  UNION ALL SELECT e.symbol, d.i, (e.x * 13 + d.tr) / 14 FROM e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1),
k AS (SELECT b.symbol, b.ts, e.x FROM bars_1d b LEFT JOIN e USING (symbol, i))""")  # fmt: skip
_recursive("rec_ewma_variance", lambda pdf: recursive.ewma_variance(pdf["c"].pct_change().fillna(0.0).to_numpy()), """d AS (SELECT symbol, i, coalesce(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS ret FROM bars_1d), e AS (
  SELECT symbol, i, ret * ret AS x FROM d WHERE i = 0
  UNION ALL SELECT e.symbol, d.i, 0.94 * e.x + (1 - 0.94) * d.ret * d.ret FROM e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1),
k AS (SELECT b.symbol, b.ts, e.x FROM bars_1d b LEFT JOIN e USING (symbol, i))""")  # fmt: skip
_recursive("rec_adx", recursive.of("adx", "h", "l", "c", n=14), """d0 AS (SELECT symbol, i, h - lag(h) OVER s AS up, lag(l) OVER s - l AS down, greatest(h - l, abs(h - lag(c) OVER s), abs(l - lag(c) OVER s)) AS tr FROM bars_1d WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
d AS (SELECT symbol, i, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m FROM d0 WHERE i > 0),
e AS (
  SELECT symbol, i, sum(tr) OVER q AS tr, sum(p) OVER q AS p, sum(m) OVER q AS m FROM d WINDOW q AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) QUALIFY i = 14
  UNION ALL SELECT e.symbol, d.i, e.tr - e.tr / 14 + d.tr, e.p - e.p / 14 + d.p, e.m - e.m / 14 + d.m FROM e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1),
dx AS (SELECT symbol, i, CASE WHEN tr > 1e-12 AND p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx FROM e),
a AS (
  SELECT symbol, i, avg(dx) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS x FROM dx QUALIFY i = 27
  UNION ALL SELECT a.symbol, dx.i, (a.x * 13 + dx.dx) / 14 FROM a JOIN dx ON dx.symbol = a.symbol AND dx.i = a.i + 1),
k AS (SELECT b.symbol, b.ts, a.x FROM bars_1d b LEFT JOIN a USING (symbol, i))""")  # fmt: skip

QUERIES["agg_upsample"] = lambda spark, d: panels.upsample(panels.bars_1h(spark, d), F.window("ts", "4 hours")["start"].cast("timestamp_ntz"), 4).select("symbol", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("hour"), *[r(c).alias(c) for c in "ohlcv"])
SQL["agg_upsample"] = f"""WITH {BARS_1H}, b AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(o, ts) AS o, max(h) AS h, min(l) AS l, arg_max(c, ts) AS c, sum(v) AS v, count(*) AS n FROM bars_1h GROUP BY symbol, time_bucket(INTERVAL '4 hours', ts)),
m AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS last FROM b)
SELECT symbol, {HOUR}, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v FROM m WHERE ts < last OR n >= 4"""
QUERIES["val_gaps_and_outliers"] = lambda spark, d: panels.gaps_and_outliers(panels.bars_1h(spark, d), 3600)
SQL["val_gaps_and_outliers"] = f"""WITH {BARS_1H}, m AS (SELECT symbol, epoch(ts) - epoch(lag(ts) OVER s) > 5400 AS gap, abs(c / lag(c) OVER s - 1) > 0.35 AS jump FROM bars_1h WINDOW s AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE jump) AS outliers FROM m GROUP BY symbol"""
