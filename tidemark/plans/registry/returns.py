"""Strategies, statistics, validation and portfolios as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators import aggregates, joins, portfolio, sleeves, statistics
from tidemark.operators import windows as w
from tidemark.plans import backtest, expr, validation
from tidemark.plans.registry.alignment import STREAMS, streams
from tidemark.plans.registry.base import BARS_1D, BARS_LI, DAY, day, over, r
from tidemark.sources import panels

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
COST = 13e-4


def const(v: float) -> dict:
    return {"op": "const", "value": v}


def price(f: str) -> dict:
    return {"op": "price", "field": f}


def ind(op: str, src: dict, n: float) -> dict:
    return {"op": op, "src": src, "period": const(n)}


def two(op: str, a: dict, b: dict) -> dict:
    return {"op": op, "a": a, "b": b}


CLOSE = price("close")
#: Documents without kernels that depend on their own past.
DOCS: dict[str, dict[str, dict]] = {
    "average_cross": {"longEntry": two("crossover", ind("sma", CLOSE, 5), ind("sma", CLOSE, 20)), "longExit": two("crossunder", ind("sma", CLOSE, 5), ind("sma", CLOSE, 20))},
    "channel_breakout": {"longEntry": two("gt", CLOSE, ind("lag", ind("highest", price("high"), 20), 1)), "longExit": two("lt", CLOSE, ind("lag", ind("lowest", price("low"), 10), 1))},
    "momentum": {"longEntry": two("gt", ind("roc", CLOSE, 10), const(0)), "longExit": two("lt", ind("roc", CLOSE, 10), const(0))},
    "reversion": {"longEntry": two("and", two("lt", ind("zscore", CLOSE, 20), const(-1)), {"op": "not", "a": two("lt", CLOSE, ind("sma", CLOSE, 50))}), "longExit": two("gt", ind("zscore", CLOSE, 20), const(0))},
    "squeeze": {"longEntry": two("and", two("lt", ind("lag", ind("pctrank", ind("stdev", CLOSE, 10), 20), 1), const(0.5)), two("gt", CLOSE, ind("sma", CLOSE, 10))), "longExit": two("lt", CLOSE, ind("sma", CLOSE, 10))},
    "overreaction": {"longEntry": two("and", two("lt", ind("zscore", ind("roc", CLOSE, 1), 20), const(-1)), two("lt", {"op": "abs", "a": ind("slope", CLOSE, 20)}, const(0.05))), "longExit": two("gt", ind("zscore", ind("roc", CLOSE, 1), 20), const(0))},
}


def _full(n: int, value: str, x: str = "c") -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} = {n} THEN {value} END"


def _avg(n: int, x: str = "c") -> str:
    return _full(n, f"avg({x}) OVER {over(n)}", x)


def _z(n: int, x: str) -> str:
    return _full(n, f"CASE WHEN stddev_pop({x}) OVER {over(n)} > 1e-12 THEN ({x} - avg({x}) OVER {over(n)}) / stddev_pop({x}) OVER {over(n)} END", x)


#: By document: columns of stages, and the conditions over the last.
DOC_SQL = {
    "average_cross": ([f"{_avg(5)} AS a, {_avg(20)} AS b", "lag(a) OVER s AS pa, lag(b) OVER s AS pb"], "coalesce(pa <= pb AND a > b, false)", "coalesce(pa >= pb AND a < b, false)"),
    "channel_breakout": ([f"{_full(20, f'max(h) OVER {over(20)}', 'h')} AS a, {_full(10, f'min(l) OVER {over(10)}', 'l')} AS b", "lag(a) OVER s AS pa, lag(b) OVER s AS pb"], "coalesce(c > pa, false)", "coalesce(c < pb, false)"),
    "momentum": (["CASE WHEN lag(c, 10) OVER s <> 0 THEN c / lag(c, 10) OVER s - 1 END AS a"], "coalesce(a > 0, false)", "coalesce(a < 0, false)"),
    "reversion": ([f"{_z(20, 'c')} AS a, {_avg(50)} AS b"], "coalesce(a < -1, false) AND NOT coalesce(c < b, false)", "coalesce(a > 0, false)"),
    "squeeze": ([f"{_full(10, f'stddev_pop(c) OVER {over(10)}')} AS sd, {_avg(10)} AS b", f"{_full(20, f'len(list_filter(list(sd) OVER {over(20)}, lambda v: v <= sd)) / 20.0', 'sd')} AS p", "lag(p) OVER s AS pp"], "coalesce(pp < 0.5, false) AND coalesce(c > b, false)", "coalesce(c < b, false)"),
    "overreaction": (["CASE WHEN lag(c) OVER s <> 0 THEN c / lag(c) OVER s - 1 END AS a, " + _full(20, f"CASE WHEN c <> 0 THEN regr_slope(c, CAST(i AS DOUBLE)) OVER {over(20)} / abs(c) END") + " AS sl", f"{_z(20, 'a')} AS z"], "coalesce(z < -1, false) AND coalesce(abs(sl) < 0.05, false)", "coalesce(z > 0, false)"),
}


def _stages(name: str, table: str = "bars_1d") -> str:
    """CTEs d0, d1, ...; e: conditions; p: positions."""
    stages, enter, leave = DOC_SQL[name]
    out, last = [], table
    for k, columns in enumerate(stages):
        out.append(f"d{k} AS (SELECT *, {columns} FROM {last} WINDOW s AS (PARTITION BY symbol ORDER BY ts))")
        last = f"d{k}"
    out.append(f"e AS (SELECT *, {enter} AS enter, {leave} AS leave FROM {last})")
    out.append("""p AS (SELECT *, CAST(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INTEGER) AS dir FROM (SELECT *, CASE WHEN i = 0 THEN 0 WHEN enter THEN 1 WHEN leave THEN 0 END AS ev FROM e))""")
    return ", ".join(out)


RETURNS_SQL = f"""g AS (SELECT *, coalesce(lag(dir) OVER s, 0) AS held, abs(coalesce(lag(dir) OVER s, 0) - coalesce(lag(dir, 2) OVER s, 0)) AS turn, coalesce(c / lag(c) OVER s - 1, 0) AS r FROM p WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
x0 AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE greatest(-0.95, held * r - turn * {COST}) END AS ret0 FROM g),
x1 AS (SELECT *, exp(sum(ln(1 + ret0)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS eq0 FROM x0),
x AS (SELECT *, CASE WHEN coalesce(max(eq0 <= 0.05) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 0 ELSE ret0 END AS ret FROM x1)"""


def run_doc(spark: SparkSession, d: str, name: str, bars: Callable = panels.bars_1d) -> DataFrame:
    """A document's long and flat positions, and what they return."""
    own = expr.evaluate(bars(spark, d), DOCS[name])
    return backtest.returns(backtest.long_flat(own), COST)


for _name in DOCS:
    QUERIES[f"plan_{_name}"] = lambda spark, d, name=_name: expr.evaluate(panels.bars_1d(spark, d), DOCS[name]).select("symbol", day(), F.col("longEntry").alias("enter"), F.col("longExit").alias("leave"))
    SQL[f"plan_{_name}"] = f"WITH {BARS_1D}, {_stages(_name)} SELECT symbol, {DAY}, enter, leave FROM e"
    QUERIES[f"bck_{_name}"] = lambda spark, d, name=_name: run_doc(spark, d, name).select("symbol", day(), F.col("dir").cast("int").alias("dir"), r("ret").alias("ret"))
    SQL[f"bck_{_name}"] = f"WITH {BARS_1D}, {_stages(_name)}, {RETURNS_SQL} SELECT symbol, {DAY}, dir, round(ret, 6) + 0.0 AS ret FROM x"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the crossing averages on line items' bars: bars, windows, positions, returns, figures, all native."""
    own = aggregates.metrics(run_doc(spark, d, "average_cross", panels.bars_li), 365)
    return own.select("symbol", "bars", *[r(c).alias(c) for c in ("sharpe", "sortino", "max_dd", "exposure", "turnover_per_year")])


QUERIES["agg_metrics"] = flagship
METRICS_SQL = """m AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lg FROM x),
n AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM m)"""
SQL["agg_metrics"] = f"""WITH {BARS_LI}, {_stages("average_cross", "bars_li")}, {RETURNS_SQL}, {METRICS_SQL}
SELECT symbol, count(*) AS bars, round(CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END, 6) + 0.0 AS sharpe,
  round(CASE WHEN sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(*)) > 1e-12 THEN avg(ret) / sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(*)) * sqrt(365) ELSE 0 END, 6) + 0.0 AS sortino,
  round(min(dd), 6) + 0.0 AS max_dd, round(avg(CASE WHEN held <> 0 THEN 1.0 ELSE 0.0 END), 6) AS exposure, round(sum(turn) / count(*) * 365, 6) AS turnover_per_year FROM n GROUP BY symbol"""

QUERIES["bck_trades"] = lambda spark, d: backtest.trades(run_doc(spark, d, "momentum")).select("symbol", F.date_format("entry_ts", "yyyy-MM-dd").alias("entry"), F.date_format("exit_ts", "yyyy-MM-dd").alias("exit"), F.col("dir").cast("int").alias("dir"))
SQL["bck_trades"] = f"""WITH {BARS_1D}, {_stages("momentum")}, t AS (SELECT *, sum(CASE WHEN dir <> coalesce(pd, dir) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT symbol, ts, dir, lag(dir) OVER (PARTITION BY symbol ORDER BY ts) AS pd, coalesce(lead(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS nx FROM p))
SELECT symbol, strftime(min(ts), '%Y-%m-%d') AS entry, strftime(max(nx), '%Y-%m-%d') AS "exit", CAST(1 AS INTEGER) AS dir FROM t WHERE dir <> 0 GROUP BY symbol, k"""

#: A document with shorts, stops and sizing; its state machine is a grouped map.
FULL_DOC = {
    "name": "crossing averages", "hypothesis": "levels that cross keep their direction for a while", "tf": "1d",
    "longEntry": two("crossover", ind("ema", CLOSE, 5), ind("ema", CLOSE, 20)), "longExit": two("crossunder", ind("ema", CLOSE, 5), ind("ema", CLOSE, 20)),
    "shortEntry": two("crossunder", ind("ema", CLOSE, 5), ind("ema", CLOSE, 20)), "shortExit": two("crossover", ind("ema", CLOSE, 5), ind("ema", CLOSE, 20)),
    "params": {}, "risk": {"stopAtrMult": 2.0, "trailAtrMult": 3.0, "volTargetAnnual": 0.3, "maxLeverage": 2.0},
}
QUERIES["rec_state_machine"] = lambda spark, d: backtest.backtest(panels.bars_1d(spark, d), FULL_DOC).select("symbol", day(), "dir", r("w").alias("w"), r("ret").alias("ret"))

SMALL = "streams"
QUERIES["agg_monthly"] = lambda spark, d: aggregates.monthly(streams(spark, d), ("id",)).select("id", "ym", r("ret").alias("ret"))
SQL["agg_monthly"] = f"WITH {STREAMS} SELECT id, strftime(ts, '%Y-%m') AS ym, round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS ret FROM streams GROUP BY ALL"
QUERIES["agg_series_stats"] = lambda spark, d: aggregates.series_stats(streams(spark, d), 365, ("id",)).select("id", *[r(c).alias(c) for c in ("positive_months", "worst_month", "cagr")])
SQL["agg_series_stats"] = f"""WITH {STREAMS}, m AS (SELECT id, strftime(ts, '%Y-%m') AS ym, exp(sum(ln(1 + ret))) - 1 AS ret FROM streams GROUP BY ALL), g AS (SELECT id, count(*) AS n, sum(ln(1 + ret)) AS g FROM streams GROUP BY id)
SELECT id, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_months, round(min(ret), 6) + 0.0 AS worst_month, round(any_value(CASE WHEN n / 365.0 < 0.2 THEN 0 ELSE exp(g / (n / 365.0)) - 1 END), 6) + 0.0 AS cagr FROM m JOIN g USING (id) GROUP BY id"""


def moments(spark: SparkSession, d: str) -> DataFrame:
    return streams(spark, d).groupBy("id").agg(*[c.alias(n) for n, c in aggregates.moments(F.col("ret")).items()])


QUERIES["agg_moments"] = lambda spark, d: moments(spark, d).select("id", "n", *[r(c).alias(c) for c in ("mean", "sd", "skew", "kurt")])
MOMENTS = """a AS (SELECT id, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS sd FROM streams GROUP BY id),
mo AS (SELECT s.id, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, avg((ret - mean) ** 3) / any_value(sd) ** 3 AS skew, avg((ret - mean) ** 4) / any_value(sd) ** 4 AS kurt FROM streams s JOIN a ON a.id = s.id GROUP BY s.id)"""
SQL["agg_moments"] = f"WITH {STREAMS}, {MOMENTS} SELECT id, n, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, round(skew, 6) + 0.0 AS skew, round(kurt, 6) AS kurt FROM mo"


def psr(spark: SparkSession, d: str) -> DataFrame:
    m = moments(spark, d)
    best = aggregates.expected_best(F.lit(40), F.lit(365))
    return m.select("id", r(aggregates.probabilistic_sharpe(F.lit(0.0))).alias("psr"), r(aggregates.probabilistic_sharpe(best)).alias("dsr"), r(best, 9).alias("benchmark"))


QUERIES["agg_psr_dsr"] = psr


def _cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def _horner_sql(x: str, c) -> str:
    out = str(c[0])
    for k in c[1:]:
        out = f"({out} * {x} + {k})"
    return out


def _quantile_sql(p: str) -> str:
    """For p in the middle and upper region, which are all that trial numbers reach."""
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(1 - {p}))"
    mid = f"{_horner_sql(f'({q} * {q})', maths.QUANTILE_A)} * {q} / {_horner_sql(f'({q} * {q})', (*maths.QUANTILE_B, 1.0))}"
    return f"CASE WHEN {p} <= 1 - 0.02425 THEN {mid} ELSE -({_horner_sql(t, maths.QUANTILE_C)} / {_horner_sql(t, (*maths.QUANTILE_D, 1.0))}) END"


BEST_SQL = f"sqrt(0.25 / 365) * ((1 - {aggregates.EULER}) * ({_quantile_sql('(1 - 1 / 40.0)')}) + {aggregates.EULER} * ({_quantile_sql('(1 - 1 / (40.0 * exp(1)))')}))"
SQL["agg_psr_dsr"] = f"""WITH {STREAMS}, {MOMENTS}, b AS (SELECT *, mean / sd AS sr, 1 - skew * mean / sd + (kurt - 1) / 4 * (mean / sd) ** 2 AS spread, {BEST_SQL} AS best FROM mo),
z AS (SELECT *, sr * sqrt(n - 1) / sqrt(spread) AS z0, (sr - best) * sqrt(n - 1) / sqrt(spread) AS z1 FROM b)
SELECT id, round(CASE WHEN sd > 1e-12 AND n >= 10 AND spread > 0 THEN {_cdf_sql("z0")} ELSE 0 END, 6) AS psr, round(CASE WHEN sd > 1e-12 AND n >= 10 AND spread > 0 THEN {_cdf_sql("z1")} ELSE 0 END, 6) AS dsr, round(best, 9) AS benchmark FROM z"""

QUERIES["agg_covariance"] = lambda spark, d: aggregates.covariances(joins.intersection(streams(spark, d), "id")).select("a", "b", r(F.col("cov") * 1e6).alias("cov"))
SHARED = "sh AS (SELECT * FROM streams WHERE ts IN (SELECT ts FROM streams GROUP BY ts HAVING count(DISTINCT id) = (SELECT count(DISTINCT id) FROM streams)))"
SQL["agg_covariance"] = f"WITH {STREAMS}, {SHARED} SELECT x.id AS a, y.id AS b, round(covar_pop(x.ret, y.ret) * 1e6, 6) + 0.0 AS cov FROM sh x JOIN sh y ON x.ts = y.ts AND x.id <= y.id GROUP BY ALL"
QUERIES["agg_mean_abs_correlation"] = lambda spark, d: aggregates.mean_abs_correlation(joins.intersection(streams(spark, d), "id")).select(r("mean_abs_corr").alias("mean_abs_corr"))
SQL["agg_mean_abs_correlation"] = f"WITH {STREAMS}, {SHARED} SELECT round(avg(abs(corr)), 6) AS mean_abs_corr FROM (SELECT corr(x.ret, y.ret) AS corr FROM sh x JOIN sh y ON x.ts = y.ts AND x.id < y.id GROUP BY x.id, y.id)"


def ic_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = panels.bars_1d(spark, d).withColumns({"momentum": w.roc(F.col("c"), 5), "z": w.zscore(F.col("c"), 20), "y": w.forward_return(3)})
    return b.select("symbol", "ts", "y", F.expr("stack(2, 'momentum', momentum, 'z', z) as (signal, x)"))


QUERIES["agg_information_coefficient"] = lambda spark, d: aggregates.information_coefficients(ic_pairs(spark, d), ("symbol", "signal")).select("symbol", "signal", F.col("blocks").cast("long").alias("blocks"), *[r(c).alias(c) for c in ("mean_ic", "sd_ic", "ir", "t")])
IC = f"""{BARS_1D}, i0 AS (SELECT symbol, ts, CASE WHEN lag(c, 5) OVER s <> 0 THEN c / lag(c, 5) OVER s - 1 END AS momentum, {_z(20, "c")} AS z, lead(c, 3) OVER s / c - 1 AS y FROM bars_1d WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
i1 AS (SELECT symbol, ts, 'momentum' AS signal, momentum AS x, y FROM i0 UNION ALL SELECT symbol, ts, 'z', z, y FROM i0),
i2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, signal ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol, signal) AS n FROM i1 WHERE x IS NOT NULL AND y IS NOT NULL),
i3 AS (SELECT *, greatest(1, least(60, n // 20)) AS bl FROM i2), i4 AS (SELECT *, least(k // (n // bl), bl - 1) AS block FROM i3),
i5 AS (SELECT symbol, signal, block, rank() OVER (PARTITION BY symbol, signal, block ORDER BY x) + (count(*) OVER (PARTITION BY symbol, signal, block, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, signal, block ORDER BY y) + (count(*) OVER (PARTITION BY symbol, signal, block, y) - 1) / 2.0 AS ry FROM i4),
i6 AS (SELECT symbol, signal, block, coalesce(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 0) AS ic FROM i5 GROUP BY ALL),
i7 AS (SELECT symbol, signal, count(*) AS blocks, avg(ic) AS mean_ic, stddev_pop(ic) AS sd_ic FROM i6 GROUP BY ALL),
i8 AS (SELECT *, least(greatest(CASE WHEN sd_ic > 1e-12 THEN mean_ic / sd_ic WHEN abs(mean_ic) <= 1e-12 THEN 0 ELSE sign(mean_ic) * 99 END, -99), 99) AS ir FROM i7)"""
SQL["agg_information_coefficient"] = f"WITH {IC} SELECT symbol, signal, blocks, round(mean_ic, 6) + 0.0 AS mean_ic, round(sd_ic, 6) AS sd_ic, round(ir, 6) + 0.0 AS ir, round(least(greatest(ir * sqrt(blocks), -99), 99), 6) + 0.0 AS t FROM i8"

QUANTILE_SQL = {"floor_n": "least(n - 1, floor(n * p))", "round_n1": "floor((n - 1) * p + 0.5)", "floor_n1": "floor((n - 1) * p)", "upper_median": "floor(n / 2)"}
for _m in QUANTILE_SQL:
    QUERIES[f"agg_quantile_{_m}"] = lambda spark, d, m=_m: aggregates.exact_quantiles(streams(spark, d), "ret", [0.05, 0.5, 0.95], m, ("id",)).select("id", "p", r("ret", 9).alias("ret"))
    SQL[f"agg_quantile_{_m}"] = f"WITH {STREAMS}, k AS (SELECT id, ret, row_number() OVER (PARTITION BY id ORDER BY ret) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM streams), ps AS (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS p) SELECT id, p, round(ret, 9) + 0.0 AS ret FROM k, ps WHERE i = {QUANTILE_SQL[_m]}"


def regimes(spark: SparkSession, d: str) -> DataFrame:
    b = panels.bars_1d(spark, d)
    was = F.lag("c").over(w.order())
    b = b.withColumn("lret", F.ln(F.col("c") / was)).withColumns({"vol": w.log_vol(F.col("lret"), 48), "trend": w.roc(F.col("c"), 96), "ret": F.col("c") / was - 1})
    cuts = aggregates.exact_quantiles(b, "vol", [1 / 3, 2 / 3], "floor_n1", ("symbol",)).groupBy("symbol").agg(F.min("vol").alias("low"), F.max("vol").alias("high"))
    own = aggregates.regime_labels(b.join(F.broadcast(cuts), "symbol"), "vol", "trend", F.col("low"), F.col("high"))
    return aggregates.regime_stats(own, 365).select(F.col("regime").cast("int").alias("regime"), "n", r("sharpe").alias("sharpe"), r("pnl").alias("pnl"), r("share").alias("share"), "concentrated", "counts")


QUERIES["agg_regimes"] = regimes
SQL["agg_regimes"] = f"""WITH {BARS_1D}, b0 AS (SELECT *, ln(c / lag(c) OVER s) AS lret, c / lag(c) OVER s - 1 AS ret, CASE WHEN lag(c, 96) OVER s <> 0 THEN c / lag(c, 96) OVER s - 1 END AS trend FROM bars_1d WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
b1 AS (SELECT *, CASE WHEN count(lret) OVER {over(48)} >= 24 THEN stddev_pop(lret) OVER {over(48)} END AS vol FROM b0),
q AS (SELECT symbol, vol, row_number() OVER (PARTITION BY symbol ORDER BY vol) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM b1 WHERE vol IS NOT NULL),
cuts AS (SELECT symbol, min(vol) FILTER (WHERE k = floor((n - 1) * (1.0::DOUBLE / 3))) AS low, max(vol) FILTER (WHERE k = floor((n - 1) * (2.0::DOUBLE / 3))) AS high FROM q GROUP BY symbol),
l AS (SELECT ret, CASE WHEN vol IS NOT NULL AND trend IS NOT NULL THEN CASE WHEN vol <= low THEN 0 WHEN vol <= high THEN 1 ELSE 2 END * 2 + CASE WHEN trend >= 0 THEN 1 ELSE 0 END END AS regime FROM b1 JOIN cuts USING (symbol)),
s AS (SELECT CAST(regime AS INTEGER) AS regime, count(*) AS n, CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END AS sharpe, sum(ret) AS pnl FROM l WHERE regime IS NOT NULL GROUP BY regime)
SELECT regime, n, round(sharpe, 6) + 0.0 AS sharpe, round(pnl, 6) + 0.0 AS pnl, round(greatest(pnl, 0) / sum(greatest(pnl, 0)) OVER (), 6) AS share, greatest(pnl, 0) / sum(greatest(pnl, 0)) OVER () > 0.8 AS concentrated, n >= 30 AS counts FROM s"""

# draws of the 32-bit generator in SQL, as a chain of columns over (seed, draw)
DRAW = """u0 AS (SELECT *, ({seed} + ({draw} + 1) * 1831565813) & 4294967295 AS s FROM {table}),
u1 AS (SELECT *, xor(s, s >> 15) AS a1, s | 1 AS b1 FROM u0),
u2 AS (SELECT *, (a1 * (b1 & 65535) + (((a1 * (b1 >> 16)) & 65535) << 16)) & 4294967295 AS t FROM u1),
u3 AS (SELECT *, xor(t, t >> 7) AS a2, t | 61 AS b2 FROM u2),
u4 AS (SELECT *, xor(t, (t + ((a2 * (b2 & 65535) + (((a2 * (b2 >> 16)) & 65535) << 16)) & 4294967295)) & 4294967295) AS t2 FROM u3),
u AS (SELECT *, xor(t2, t2 >> 14) / 4294967296.0::DOUBLE AS u FROM u4)"""
QUERIES["mth_uniform"] = lambda spark, d: panels.table(spark, d, "nation").select("n_nationkey", r(maths.uniform(F.lit(42), F.col("n_nationkey")), 9).alias("u"))
SQL["mth_uniform"] = "WITH " + DRAW.format(seed=42, draw="n_nationkey::BIGINT", table="nation") + " SELECT n_nationkey, round(u, 9) AS u FROM u"
QUERIES["mth_normal"] = lambda spark, d: panels.table(spark, d, "customer").select("c_custkey", r(maths.normal_cdf(F.col("c_acctbal") / 3000), 9).alias("cdf"), r(maths.normal_quantile(F.least(F.lit(0.999), F.lit(0.5) + F.abs("c_acctbal") / 20500)), 6).alias("q"), r(maths.logit(F.abs("c_acctbal") / 10000), 6).alias("logit"))
SQL["mth_normal"] = f"SELECT c_custkey, round({_cdf_sql('(c_acctbal / 3000)')}, 9) AS cdf, round({_quantile_sql('least(0.999, 0.5 + abs(c_acctbal) / 20500)')}, 6) + 0.0 AS q, round(ln(least(greatest(abs(c_acctbal) / 10000, 1e-9), 1 - 1e-9) / (1 - least(greatest(abs(c_acctbal) / 10000, 1e-9), 1 - 1e-9))), 6) + 0.0 AS logit FROM customer"

REPS = 1000
QUERIES["rsm_block_bootstrap"] = lambda spark, d: statistics.block_bootstrap(streams(spark, d), 365, by=("id",)).select("id", "rep", r("sharpe").alias("sharpe"))
SQL["rsm_block_bootstrap"] = f"""WITH {STREAMS}, o AS (SELECT id, ret, row_number() OVER (PARTITION BY id ORDER BY ts) - 1 AS k FROM streams), z AS (SELECT id, count(*) AS n, CAST(ceil(count(*) / 24.0) AS BIGINT) AS nb FROM o GROUP BY id HAVING count(*) >= 72),
d AS (SELECT id, n, nb, rep, unnest(range(nb)) AS b FROM (SELECT *, unnest(range({REPS})) AS rep FROM z)), {DRAW.format(seed=42, draw="(rep * nb + b)", table="d")},
e AS (SELECT id, n, rep, CAST(floor(u * n) AS BIGINT) AS st, b, unnest(range(24)) AS j FROM u),
f AS (SELECT id, rep, (st + j) % n AS k FROM e WHERE b * 24 + j < n)
SELECT id, CAST(rep AS INTEGER) AS rep, round(CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END, 6) + 0.0 AS sharpe FROM f JOIN o USING (id, k) GROUP BY ALL"""
QUERIES["rsm_bootstrap_interval"] = lambda spark, d: statistics.bootstrap_interval(statistics.block_bootstrap(streams(spark, d), 365, by=("id",)), ("id",)).select("id", *[r(c).alias(c) for c in ("lo", "hi", "p5", "median")])
SQL["rsm_bootstrap_interval"] = SQL["rsm_block_bootstrap"].replace("\nSELECT id, CAST", ", sh AS (SELECT id, CAST") + "), q AS (SELECT id, list_sort(list(sharpe)) AS s FROM sh GROUP BY id) SELECT id, s[26] AS lo, s[976] AS hi, s[51] AS p5, s[501] AS median FROM q"
QUERIES["rsm_monte_carlo"] = lambda spark, d: statistics.monte_carlo_summary(statistics.monte_carlo(streams(spark, d), 365, by=("id",)), ("id",))
QUERIES["rsm_shuffled_falls"] = lambda spark, d: statistics.shuffled_falls(streams(spark, d), by=("id",)).select("id", r("share").alias("share"))
SQL["rsm_shuffled_falls"] = f"""WITH {STREAMS}, o AS (SELECT id, ret, row_number() OVER (PARTITION BY id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM streams),
d AS (SELECT *, unnest(range(500)) AS rep FROM o), {DRAW.format(seed=7, draw="(rep * n + k)", table="d")},
ps AS (SELECT id, rep, u AS pos, k, ret FROM u UNION ALL SELECT id, -1, k, k, ret FROM o),
l AS (SELECT id, rep, pos, k, sum(ln(1 + ret)) OVER (PARTITION BY id, rep ORDER BY pos, k ROWS UNBOUNDED PRECEDING) AS l FROM ps),
dd AS (SELECT id, rep, exp(l - greatest(0, max(l) OVER (PARTITION BY id, rep ORDER BY pos, k ROWS UNBOUNDED PRECEDING))) - 1 AS f FROM l),
mi AS (SELECT id, rep, least(0, min(f)) AS f FROM dd GROUP BY id, rep)
SELECT id, round(avg(CASE WHEN x.f <= y.f + 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS share FROM mi x JOIN (SELECT id, f FROM mi WHERE rep = -1) y USING (id) WHERE rep >= 0 GROUP BY id"""
QUERIES["rsm_reality_check"] = lambda spark, d: statistics.reality_check(streams(spark, d)).select("best", r("p_reality").alias("p_reality"), r("p_spa").alias("p_spa"))
QUERIES["rsm_family_wise"] = lambda spark, d: statistics.family_wise(streams(spark, d)).select("id", r("stat").alias("stat"), r("p").alias("p"))


def _maxima_sql(reps: int, seed: int) -> str:
    return f"""WITH {STREAMS}, o AS (SELECT id, ret, row_number() OVER (PARTITION BY id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM streams WHERE ret IS NOT NULL),
st AS (SELECT *, sqrt(n) * mean / sd AS stat, mean >= -sd / sqrt(n) * sqrt(2 * ln(greatest(3, ln(greatest(3, n))))) AS kept FROM (SELECT id, any_value(n) AS n, avg(ret) AS mean, greatest(stddev_pop(ret), 1e-9) AS sd FROM o WHERE n >= 5 GROUP BY id)),
d0 AS (SELECT n, rep, unnest(range(n)) AS i FROM (SELECT n, unnest(range({reps})) AS rep FROM (SELECT DISTINCT n FROM st))), d AS (SELECT *, unnest([0, 1]) AS second FROM d0),
{DRAW.format(seed=seed, draw="(2 * (rep * n + i) + second)", table="d")},
dr AS (SELECT n, rep, i, max(u) FILTER (WHERE second = 0) AS u0, max(u) FILTER (WHERE second = 1) AS u1 FROM u GROUP BY ALL),
pl AS (SELECT n, rep, i, last_value(CASE WHEN i = 0 OR u0 < 0.05 THEN CAST(floor(u1 * n) AS BIGINT) - i END IGNORE NULLS) OVER (PARTITION BY n, rep ORDER BY i ROWS UNBOUNDED PRECEDING) AS shift FROM dr),
ct AS (SELECT n, rep, (shift + i) % n AS k, count(*) AS m FROM pl GROUP BY ALL),
ag AS (SELECT rep, id, sum(m * ret) / sum(m) AS b, sum(m * ret * ret) / sum(m) AS q FROM ct JOIN o USING (n, k) GROUP BY rep, id),
ma AS (SELECT rep, max(v) AS plain, max(v) FILTER (WHERE kept) AS spa FROM (SELECT rep, kept, sqrt(n) * (b - mean) / sqrt(greatest(1e-18, q - b * b)) AS v FROM ag JOIN st USING (id)) GROUP BY rep)"""


SQL["rsm_reality_check"] = f"""{_maxima_sql(1000, 9176)}, be AS (SELECT arg_max(id, (stat, id)) AS best, max(stat) AS best_stat FROM st)
SELECT any_value(best) AS best, round((count(*) FILTER (WHERE plain >= best_stat) + 1) / 1001.0, 6) AS p_reality, round((count(*) FILTER (WHERE spa >= best_stat) + 1) / 1001.0, 6) AS p_spa FROM ma, be"""
SQL["rsm_family_wise"] = f"""{_maxima_sql(600, 9176 ^ 0x5BD1E995)}
SELECT id, round(stat, 6) + 0.0 AS stat, round((count(*) FILTER (WHERE plain >= stat) + 1) / 601.0, 6) AS p FROM st, ma GROUP BY id, stat"""


def permutation(spark: SparkSession, d: str) -> DataFrame:
    """Chance that shuffled markets do as well, for the momentum document."""
    b = panels.bars_1d(spark, d)
    seen = run_doc(spark, d, "momentum").groupBy("symbol").agg(aggregates.sharpe(F.col("ret"), 365).alias("observed"))
    many = statistics.permuted_markets(b, 200).withColumn("symbol", F.concat_ws("|", "symbol", "perm")).drop("perm")
    runs = backtest.returns(backtest.long_flat(expr.evaluate(many, DOCS["momentum"])), COST)
    sharpes = runs.groupBy("symbol").agg(aggregates.sharpe(F.col("ret"), 365).alias("sharpe")).withColumn("symbol", F.substring_index("symbol", "|", 1))
    return statistics.permutation_p(sharpes, seen).select("symbol", r("p").alias("p"))


QUERIES["rsm_permutation"] = permutation
_SHUFFLED = f"""{BARS_1D}, m0 AS (SELECT symbol, i, ts, c, count(*) OVER (PARTITION BY symbol) AS n, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM bars_1d),
m1 AS (SELECT *, unnest(range(200)) AS perm FROM m0), {DRAW.format(seed=1337, draw="(perm * (n - 1) + i - 1)", table="m1")},
m2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, perm ORDER BY CASE WHEN i > 0 THEN u ELSE -1 END, i) - 1 AS pos FROM u),
m3 AS (SELECT symbol, perm, pos, first_value(c) OVER w * exp(coalesce(sum(lr) OVER w, 0)) AS c FROM m2 WINDOW w AS (PARTITION BY symbol, perm ORDER BY pos ROWS UNBOUNDED PRECEDING)),
market AS (SELECT symbol || '|' || perm AS symbol, pos AS i, ts, m3.c FROM m3 JOIN (SELECT symbol, i AS pos, ts FROM m0) USING (symbol, pos) UNION ALL SELECT symbol, i, ts, c FROM m0)"""
SQL["rsm_permutation"] = f"""WITH {_SHUFFLED}, {_stages("momentum", "market")}, {RETURNS_SQL},
sh AS (SELECT split_part(symbol, '|', 1) AS symbol, contains(symbol, '|') AS drawn, CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END AS sharpe FROM x GROUP BY x.symbol)
SELECT symbol, round((count(*) FILTER (WHERE drawn AND sharpe >= seen) + 1) / (count(*) FILTER (WHERE drawn) + 1), 6) AS p FROM sh JOIN (SELECT symbol, sharpe AS seen FROM sh WHERE NOT drawn) USING (symbol) GROUP BY symbol"""

GRID = (10, 20, 40, 80)


def grid_runs(spark: SparkSession, d: str) -> DataFrame:
    """Returns of the trend sleeve for each length of a grid: one projection for all, then unpivoted."""
    b = panels.bars_1d(spark, d)
    o = w.order()
    small = (F.coalesce(F.col("c") / F.lag("c").over(o) - 1, F.lit(0.0)) / 50).alias("r")
    own = b.select("symbol", "ts", "i", "c", small, *[F.when(F.col("i") >= n, F.coalesce((F.col("c") > w.sma(F.col("c"), n)).cast("double"), F.lit(0.0))).otherwise(0.0).alias(f"w{n}") for n in GRID])
    own = own.select("symbol", "ts", *[(F.coalesce(F.lag(f"w{n}").over(o), F.lit(0.0)) * F.col("r")).alias(f"x{n}") for n in GRID])
    return own.select("symbol", "ts", F.expr(f"stack({len(GRID)}, {', '.join(f'{n}, x{n}' for n in GRID)}) as (config, ret)"))


GRID_SQL = f"""{BARS_1D}, g0 AS (SELECT symbol, ts, i, c, coalesce(c / lag(c) OVER s - 1, 0) / 50 AS r, {", ".join(f"CASE WHEN i >= {n} THEN coalesce(CAST(c > {_avg(n)} AS DOUBLE), 0) ELSE 0 END AS w{n}" for n in GRID)} FROM bars_1d WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
g1 AS (SELECT symbol, ts, {", ".join(f"coalesce(lag(w{n}) OVER s, 0) * r AS x{n}" for n in GRID)} FROM g0 WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
runs AS ({" UNION ALL ".join(f"SELECT symbol, ts, {n} AS config, x{n} AS ret FROM g1" for n in GRID)})"""


def _sharpe_sql(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) > 1e-12 THEN avg({x}) / stddev_pop({x}) * sqrt(365) ELSE 0 END"


QUERIES["vld_block_ratios"] = lambda spark, d: statistics.block_ratios(grid_runs(spark, d), 8, 365, ("symbol", "config")).select("symbol", "config", "block", r("value").alias("value"))
BLOCKS = f"""{GRID_SQL}, k AS (SELECT symbol, config, ret, row_number() OVER (PARTITION BY symbol, config ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol, config) AS n FROM runs),
bl AS (SELECT symbol, config, CAST(least(k // greatest(n // 8, 1), 7) AS INTEGER) AS block, {_sharpe_sql("ret")} AS value FROM k GROUP BY ALL)"""
SQL["vld_block_ratios"] = f"WITH {BLOCKS} SELECT symbol, config, block, round(value, 6) + 0.0 AS value FROM bl"
QUERIES["vld_overfitting"] = lambda spark, d: statistics.overfitting(statistics.block_ratios(grid_runs(spark, d), 8, 365, ("symbol", "config")), spark, by=("symbol",)).select("symbol", r("pbo").alias("pbo"), "splits", r("median_logit").alias("median_logit"))
SQL["vld_overfitting"] = f"""WITH {BLOCKS}, masks AS (SELECT m FROM (SELECT unnest(range(256)) AS m) WHERE bit_count(m) = 4),
me AS (SELECT symbol, m, config, avg(value) FILTER (WHERE (m >> block) & 1 = 1) AS ins, avg(value) FILTER (WHERE (m >> block) & 1 = 0) AS oos FROM masks, bl GROUP BY ALL),
be AS (SELECT symbol, m, arg_max(oos, (ins, -config)) AS chosen FROM me GROUP BY symbol, m),
ra AS (SELECT symbol, m, count(*) FILTER (WHERE oos > chosen) AS better, count(*) FILTER (WHERE oos = chosen) AS equal, count(*) AS n FROM me JOIN be USING (symbol, m) GROUP BY symbol, m),
la AS (SELECT symbol, ln(o / (1 - o)) AS lam FROM (SELECT symbol, least(greatest(1 - (better + (equal - 1) / 2.0) / (n - 1), 1e-9), 1 - 1e-9) AS o FROM ra))
SELECT symbol, round(avg(CASE WHEN lam <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS splits, round(list_sort(list(lam))[CAST(count(*) // 2 + 1 AS BIGINT)], 6) + 0.0 AS median_logit FROM la GROUP BY symbol"""


def walk(spark: SparkSession, d: str) -> DataFrame:
    cal = statistics.calendar(spark, "1995-01-01", "2001-08-01", 360, 90)
    out = statistics.walk_forward(grid_runs(spark, d), cal, 365, 5)
    return out.select("symbol", F.col("window").cast("int").alias("window"), "config", "n", r("train_sharpe").alias("train_sharpe"), r("sharpe").alias("sharpe"), r("ret").alias("ret"))


QUERIES["vld_walk_forward"] = walk
SQL["vld_walk_forward"] = f"""WITH {GRID_SQL}, cal AS (SELECT row_number() OVER (ORDER BY t) - 1 AS k, t - INTERVAL 360 DAY AS a, t AS b, t + INTERVAL 90 DAY AS e FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01' + INTERVAL 360 DAY, TIMESTAMP '2001-08-01' - INTERVAL 90 DAY, INTERVAL 90 DAY)) AS t)),
f AS (SELECT symbol, k, config, {_sharpe_sql("CASE WHEN ts < b - INTERVAL 5 DAY THEN ret END")} AS train_sharpe, {_sharpe_sql("CASE WHEN ts >= b THEN ret END")} AS sharpe, count(*) FILTER (WHERE ts >= b) AS n, exp(sum(CASE WHEN ts >= b THEN ln(1 + ret) ELSE 0 END)) - 1 AS ret FROM runs JOIN cal ON ts >= a AND ts < e GROUP BY ALL)
SELECT symbol, CAST(k AS INTEGER) AS "window", config, n, round(train_sharpe, 6) + 0.0 AS train_sharpe, round(sharpe, 6) + 0.0 AS sharpe, round(ret, 6) + 0.0 AS ret FROM f QUALIFY row_number() OVER (PARTITION BY symbol, k ORDER BY train_sharpe DESC, config) = 1"""
QUERIES["tun_grid_argmax"] = lambda spark, d: grid_runs(spark, d).groupBy("symbol", "config").agg(aggregates.sharpe(F.col("ret"), 365).alias("s")).groupBy("symbol").agg(F.max_by("config", F.struct("s", -F.col("config"))).alias("config"), r(F.max("s")).alias("sharpe"))
SQL["tun_grid_argmax"] = f"WITH {GRID_SQL}, s AS (SELECT symbol, config, {_sharpe_sql('ret')} AS s FROM runs GROUP BY ALL) SELECT symbol, arg_max(config, (s, -config)) AS config, round(max(s), 6) + 0.0 AS sharpe FROM s GROUP BY symbol"
QUERIES["tun_robust_objective"] = lambda spark, d: grid_runs(spark, d).groupBy("symbol", "config").agg(aggregates.sharpe(F.col("ret"), 365).alias("s")).groupBy("config").agg(r(aggregates.robust_objective(F.col("s"))).alias("objective"))
SQL["tun_robust_objective"] = f"WITH {GRID_SQL}, s AS (SELECT symbol, config, {_sharpe_sql('ret')} AS s FROM runs GROUP BY ALL) SELECT config, round(0.6 * median(s) + 0.4 * avg(s), 6) + 0.0 AS objective FROM s GROUP BY config"
QUERIES["tun_random_params"] = lambda spark, d: statistics.random_params(spark, {"a": {"min": 5, "max": 50, "default": 20, "int": True}, "b": {"min": 0.5, "max": 2.5, "default": 1.0}}, 50, 7).select("trial", "a", r("b").alias("b"))
SQL["tun_random_params"] = f"""WITH tr AS (SELECT unnest(range(50)) AS trial), x AS (SELECT trial, unnest([0, 1]) AS j FROM tr), {DRAW.format(seed=7, draw="(trial * 2 + j)", table="x")}
SELECT CAST(trial AS INTEGER) AS trial, CASE WHEN trial = 0 THEN 20.0 ELSE round(5 + max(u) FILTER (WHERE j = 0) * 45) END AS a, round(CASE WHEN trial = 0 THEN 1.0 ELSE 0.5 + max(u) FILTER (WHERE j = 1) * 2.0 END, 6) AS b FROM u GROUP BY trial"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    b = joins.intersection(panels.bars_1d(spark, d).withColumn("score", w.roc(F.col("c"), 10)))
    return portfolio.top_k(b, "score", 2, 5, 20)


QUERIES["top_k_weights"] = lambda spark, d: ranked(spark, d).select("symbol", day(), r("w").alias("w"))
TOP = f"""{BARS_1D}, t0 AS (SELECT *, CASE WHEN lag(c, 10) OVER s <> 0 THEN c / lag(c, 10) OVER s - 1 END AS score FROM bars_1d WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
t1 AS (SELECT * FROM t0 WHERE ts IN (SELECT ts FROM bars_1d GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars_1d))),
t2 AS (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS bar, row_number() OVER (PARTITION BY ts ORDER BY score IS NOT NULL DESC, score DESC, symbol) AS rk, least(2, count(score) OVER (PARTITION BY ts)) AS picks FROM t1),
t3 AS (SELECT *, CASE WHEN bar >= 20 AND (bar - 20) % 5 = 0 THEN CASE WHEN score IS NOT NULL AND rk <= 2 THEN 1.0 / picks ELSE 0 END END AS w0 FROM t2),
t4 AS (SELECT *, coalesce(last_value(w0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS w FROM t3)"""
SQL["top_k_weights"] = f"WITH {TOP} SELECT symbol, {DAY}, round(w, 6) AS w FROM t4"
QUERIES["prt_panel_returns"] = lambda spark, d: portfolio.panel_returns(ranked(spark, d), COST).select(day(), r("raw").alias("raw"), r("ret").alias("ret"))
SQL["prt_panel_returns"] = f"""WITH {TOP}, q AS (SELECT ts, coalesce(lag(w) OVER s, 0) * coalesce(c / lag(c) OVER s - 1, 0) - abs(coalesce(lag(w) OVER s, 0) - coalesce(lag(w, 2) OVER s, 0)) * {COST} AS x FROM t4 WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT ts, sum(x) AS raw FROM q GROUP BY ts), z AS (SELECT CASE WHEN stddev_pop(raw) * sqrt(365) > 1e-9 THEN least(3.0, 0.4 / (stddev_pop(raw) * sqrt(365))) ELSE 1 END AS lev FROM y)
SELECT {DAY}, round(raw, 6) + 0.0 AS raw, round(greatest(-0.95, raw * lev), 6) + 0.0 AS ret FROM y, z"""
QUERIES["prt_trend_sleeve"] = lambda spark, d: portfolio.trend_sleeve(panels.bars_1d(spark, d), 30).select("symbol", day(), r("w").alias("w"), r("ret").alias("ret"))
SQL["prt_trend_sleeve"] = f"""WITH {BARS_1D}, a AS (SELECT *, CASE WHEN i >= 31 THEN coalesce(CAST(c > {_avg(30)} AS DOUBLE), 0) ELSE 0 END AS w FROM bars_1d)
SELECT symbol, {DAY}, w, round(coalesce(lag(w) OVER s, 0) * coalesce(c / lag(c) OVER s - 1, 0) - abs(coalesce(lag(w) OVER s, 0) - coalesce(lag(w, 2) OVER s, 0)) * 7e-4, 6) + 0.0 AS ret FROM a WINDOW s AS (PARTITION BY symbol ORDER BY ts)"""
QUERIES["prt_timing_sleeve"] = lambda spark, d: portfolio.timing_sleeve(panels.bars_1d(spark, d), "v", 40, 0.5).select("symbol", day(), r("w").alias("w"), r("ret").alias("ret"))
SQL["prt_timing_sleeve"] = f"""WITH {BARS_1D}, a AS (SELECT *, CASE WHEN i >= 41 THEN CAST(CASE WHEN count(v) OVER {over(40, 1)} >= 20 THEN (v - avg(v) OVER {over(40, 1)}) / greatest(stddev_pop(v) OVER {over(40, 1)}, 1e-6) ELSE 0 END > 0.5 AS DOUBLE) ELSE 0 END AS w FROM bars_1d)
SELECT symbol, {DAY}, w, round(coalesce(lag(w) OVER s, 0) * coalesce(c / lag(c) OVER s - 1, 0) - abs(coalesce(lag(w) OVER s, 0) - coalesce(lag(w, 2) OVER s, 0)) * 7e-4, 6) + 0.0 AS ret FROM a WINDOW s AS (PARTITION BY symbol ORDER BY ts)"""
QUERIES["prt_book_erc"] = lambda spark, d: portfolio.book_weights(streams(spark, d)).select("id", r("weight").alias("weight"), r("risk").alias("risk"))
SQL["prt_book_erc"] = f"""WITH RECURSIVE {STREAMS}, {SHARED}, cv AS (SELECT x.id AS a, y.id AS b, covar_pop(x.ret, y.ret) AS c FROM sh x JOIN sh y ON x.ts = y.ts GROUP BY ALL),
al AS (SELECT DISTINCT id FROM streams), few AS (SELECT count(DISTINCT ts) < 2 AS few FROM sh),
it AS (SELECT 0 AS k, list(id ORDER BY id) AS ids, list(x ORDER BY id) AS x FROM (SELECT id, 1 / stddev_pop(ret) AS x FROM sh GROUP BY id HAVING (SELECT NOT few FROM few))
  UNION ALL SELECT k + 1, ids, list(x * sqrt(mean / risk) ORDER BY id) FROM (SELECT *, avg(risk) OVER () AS mean FROM (
    SELECT k, ids, id, x, x * sum(c * y) AS risk FROM (SELECT k, ids, unnest(ids) AS id, unnest(x) AS x, x AS own FROM it WHERE k < 200 AND len(ids) > 0) p
    JOIN (SELECT a, b, c FROM cv) ON a = id, LATERAL (SELECT own[list_position(ids, b)] AS y) GROUP BY k, ids, id, x)) GROUP BY k, ids),
la AS (SELECT unnest(ids) AS id, unnest(x) AS x FROM it WHERE k = 200), ri AS (SELECT p.id, p.x, p.x * sum(c * q.x) AS risk FROM la p JOIN cv ON a = p.id JOIN la q ON q.id = b GROUP BY p.id, p.x)
SELECT id, round(x / sum(x) OVER (), 6) AS weight, round(risk / sum(risk) OVER (), 6) AS risk FROM ri
UNION ALL SELECT id, round(1 / (count(*) OVER ())::DOUBLE, 6), round(1 / (count(*) OVER ())::DOUBLE, 6) FROM al WHERE (SELECT few FROM few)"""
QUERIES["prt_book_inverse_vol"] = lambda spark, d: portfolio.book_weights(streams(spark, d), "invvol").select("id", r("weight").alias("weight"))
SQL["prt_book_inverse_vol"] = f"WITH {STREAMS}, {SHARED}, v AS (SELECT id, 1 / stddev_pop(ret) AS x FROM sh GROUP BY id) SELECT id, round(x / sum(x) OVER (), 6) AS weight FROM v"


def equal_book(spark: SparkSession, d: str) -> DataFrame:
    s = streams(spark, d)
    return portfolio.book_stats(portfolio.book_returns(s, portfolio.book_weights(s, "equal")), 365).select("n_bars", *[r(c).alias(c) for c in ("sharpe", "vol", "max_dd", "mean_ret")])


QUERIES["prt_book_stats"] = equal_book
SQL["prt_book_stats"] = f"""WITH {STREAMS}, {SHARED}, b AS (SELECT ts, avg(ret) AS ret FROM sh GROUP BY ts), l AS (SELECT ret, sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l, ts FROM b), e AS (SELECT ret, exp(l - greatest(max(l) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)) - 1 AS dd FROM l)
SELECT count(*) AS n_bars, round({_sharpe_sql("ret")}, 6) + 0.0 AS sharpe, round(stddev_pop(ret) * sqrt(365), 6) AS vol, round(least(min(dd), 0), 6) + 0.0 AS max_dd, round(avg(ret), 6) + 0.0 AS mean_ret FROM e"""


def diversification(spark: SparkSession, d: str) -> DataFrame:
    s = streams(spark, d)
    return portfolio.diversification_ratio(s, portfolio.book_weights(s, "equal")).select(r("ratio").alias("ratio"))


QUERIES["prt_diversification"] = diversification
SQL["prt_diversification"] = f"WITH {STREAMS}, {SHARED}, v AS (SELECT stddev_pop(ret) AS sd FROM sh GROUP BY id), b AS (SELECT avg(ret) AS ret FROM sh GROUP BY ts) SELECT round(CASE WHEN stddev_pop(ret) > 0 THEN (SELECT avg(sd) FROM v) / stddev_pop(ret) ELSE 1 END, 6) AS ratio FROM b"
QUERIES["prt_marginal"] = lambda spark, d: portfolio.marginal_ratio(streams(spark, d), "5-LOW", 365).select(*[r(c).alias(c) for c in ("with_it", "without", "marginal", "max_corr")])
SQL["prt_marginal"] = f"""WITH {STREAMS}, {SHARED}, rest AS (SELECT * FROM streams WHERE id <> '5-LOW'), rsh AS (SELECT * FROM rest WHERE ts IN (SELECT ts FROM rest GROUP BY ts HAVING count(DISTINCT id) = (SELECT count(DISTINCT id) FROM rest))),
wi AS (SELECT CASE WHEN stddev_pop(ret) > 1e-15 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END AS s FROM (SELECT ts, avg(ret) AS ret FROM sh GROUP BY ts)),
wo AS (SELECT CASE WHEN stddev_pop(ret) > 1e-15 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END AS s FROM (SELECT ts, avg(ret) AS ret FROM rsh GROUP BY ts)),
ne AS (SELECT max(c) AS c FROM (SELECT corr(x.ret, y.ret) AS c FROM streams x JOIN streams y ON x.ts = y.ts WHERE x.id = '5-LOW' AND y.id <> '5-LOW' GROUP BY y.id HAVING count(*) > 2))
SELECT round(wi.s, 6) + 0.0 AS with_it, round(wo.s, 6) + 0.0 AS without, round(wi.s - wo.s, 6) + 0.0 AS marginal, round(ne.c, 6) + 0.0 AS max_corr FROM wi, wo, ne"""


#: Account sizes of a capacity curve.
AUM = [1e4, 2.5e4, 5e4, 1e5, 2.5e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2.5e7, 5e7, 1e8]


def capacity(spark: SparkSession, d: str) -> DataFrame:
    run = run_doc(spark, d, "momentum").withColumn("ret", F.col("ret") / 50)
    return portfolio.capacity(run, AUM, 365, vol_rows=20, volume_rows=60).select("symbol", "aum", *[r(c, 5).alias(c) for c in ("net_sharpe", "participation")])


QUERIES["prt_capacity"] = capacity
SQL["prt_capacity"] = f"""WITH {BARS_1D}, {_stages("momentum")}, {RETURNS_SQL}, a AS (SELECT *, c / lag(c) OVER s - 1 AS rr FROM x WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
b AS (SELECT *, CASE WHEN count(rr) OVER {over(20)} >= 10 THEN stddev_pop(rr) OVER {over(20)} END AS sg, CASE WHEN count(v * c) OVER {over(60)} >= 15 THEN avg(v * c) OVER {over(60)} END AS adv FROM a),
k AS (SELECT *, unnest([1e4, 2.5e4, 5e4, 1e5, 2.5e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2.5e7, 5e7, 1e8])::DOUBLE AS aum FROM b), p2 AS (SELECT *, CASE WHEN turn > 0 AND sg > 0 AND adv > 0 THEN turn * aum / adv END AS shr FROM k),
f AS (SELECT symbol, aum, shr, ret / 50 - coalesce(turn * 0.7 * sg * sqrt(shr), 0) AS net FROM p2)
SELECT symbol, aum, round({_sharpe_sql("net")}, 5) + 0.0 AS net_sharpe, round(coalesce(avg(shr), 0), 5) AS participation FROM f GROUP BY ALL"""
QUERIES["vld_stress"] = lambda spark, d: statistics.stress(run_doc(spark, d, "momentum")).select("symbol", "ramp", r("sharpe").alias("sharpe"))
SQL["vld_stress"] = f"""WITH {BARS_1D}, {_stages("momentum")}, {RETURNS_SQL}, k AS (SELECT symbol, unnest([1, 2, 3, 5]) AS ramp, ret, turn FROM x), f AS (SELECT symbol, ramp, greatest(-0.95, ret - turn * {COST} * (ramp - 1)) AS q FROM k) SELECT symbol, ramp, round({_sharpe_sql("q")}, 6) + 0.0 AS sharpe FROM f GROUP BY ALL"""
QUERIES["snk_downsample"] = lambda spark, d: statistics.equity_curve(streams(spark, d).withColumnRenamed("id", "symbol"), 50).select("symbol", day(), r("eq").alias("eq"))
SQL["snk_downsample"] = f"WITH {STREAMS}, e AS (SELECT id, ts, exp(sum(ln(1 + ret)) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS eq, row_number() OVER (PARTITION BY id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM streams) SELECT id AS symbol, {DAY}, round(eq, 6) AS eq FROM e WHERE k % CAST(ceil(n / 50.0) AS BIGINT) = 0 OR k = n - 1"
QUERIES["set_purge_embargo"] = lambda spark, d: statistics.purged(panels.bars_1d(spark, d), 500, 700, 30, 20).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("i").alias("checksum"))
SQL["set_purge_embargo"] = f"WITH {BARS_1D} SELECT symbol, count(*) AS n, CAST(sum(i) AS BIGINT) AS checksum FROM bars_1d WHERE i < 470 OR i > 720 GROUP BY symbol"


def blend(spark: SparkSession, d: str) -> DataFrame:
    daily = panels.bars_1d(spark, d).withColumn("value", 1 + F.col("v") / 4)
    return sleeves.blend(daily, "value", n_trend=30, n_long=40).select("symbol", day(), r("wa").alias("wa"), r("wb").alias("wb"), r("ret").alias("ret"))


QUERIES["slv_blend"] = blend
QUERIES["slv_trend_leg"] = lambda spark, d: blend(spark, d).select("symbol", "day", "wb")
SQL["slv_trend_leg"] = f"WITH {BARS_1D} SELECT symbol, {DAY}, CASE WHEN i > 42 THEN coalesce(CAST(c >= {_avg(30)} AS DOUBLE), 0) ELSE 0 END AS wb FROM bars_1d"
QUERIES["dly_funding"] = lambda spark, d: sleeves.with_daily_funding(panels.bars_1h(spark, d), panels.stamps(spark, d)).groupBy("symbol", day()).agg(r(F.max("funding"), 8).alias("funding"), F.count("*").alias("n"))
SQL["dly_funding"] = "WITH b AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events), f AS (SELECT CAST(ts AS DATE) AS d, sum(value / 1e6) AS funding FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, round(coalesce(max(funding), 0), 8) + 0.0 AS funding, count(*) AS n FROM b LEFT JOIN f ON d = CAST(ts AS DATE) GROUP BY ALL"
QUERIES["prt_beta_hedged"] = lambda spark, d: sleeves.hedged(streams(spark, d), joins.mean_of_present(streams(spark, d))).select("id", day(), r("beta", 5).alias("beta"), r("ret").alias("ret"))
SQL["prt_beta_hedged"] = f"""WITH {STREAMS}, mk AS (SELECT ts, avg(ret) AS m FROM streams GROUP BY ts), j AS (SELECT id AS symbol, ts, ret, m FROM streams JOIN mk USING (ts)),
b AS (SELECT *, least(greatest(coalesce(CASE WHEN count(ret) OVER {over(60, 1)} >= 2 AND abs(var_pop(m) OVER {over(60, 1)}) >= 1e-12 THEN covar_pop(ret, m) OVER {over(60, 1)} / var_pop(m) OVER {over(60, 1)} END, 1), 0), 3) AS beta FROM j)
SELECT symbol AS id, {DAY}, round(beta, 5) + 0.0 AS beta, round(ret - beta * m - abs(beta - coalesce(lag(beta) OVER (PARTITION BY symbol ORDER BY ts), 0)) * 7e-4, 6) + 0.0 AS ret FROM b"""


def network(spark: SparkSession, d: str) -> DataFrame:
    panel = joins.intersection(streams(spark, d), "id").withColumnRenamed("id", "symbol")
    return sleeves.network_scores(panel).select("symbol", day(), r(F.col("score") * 100, 5).alias("score"))


QUERIES["prt_network_momentum"] = network
SQL["prt_network_momentum"] = f"""WITH {STREAMS}, {SHARED}, rt AS (SELECT ts, id AS leader, ret AS x, lag(ret) OVER (PARTITION BY id ORDER BY ts) AS x1 FROM sh), bo AS (SELECT ts, id AS symbol, leader, ret AS y, x, x1 FROM sh JOIN rt USING (ts) WHERE id <> leader),
le AS (SELECT *, CASE WHEN count(x1) OVER p > 30 AND stddev_pop(x1) OVER p > 1e-12 AND stddev_pop(y) OVER p > 1e-12 THEN corr(x1, y) OVER p ELSE 0 END AS led FROM bo WINDOW p AS (PARTITION BY symbol, leader ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT symbol, {DAY}, round(sum(led * x) * 100, 5) + 0.0 AS score FROM le GROUP BY symbol, ts"""


def stability(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the trend grid as neighbours of the second one."""
    s = grid_runs(spark, d).groupBy(F.col("symbol").alias("candidate"), "config").agg(aggregates.sharpe(F.col("ret"), 365).alias("sharpe"))
    base = s.where(f"config = {GRID[1]}").select("candidate", F.col("sharpe").alias("base"))
    return validation.stability(s.where(f"config <> {GRID[1]}"), base).select("candidate", r("stability").alias("stability"))


QUERIES["vld_stability"] = stability
SQL["vld_stability"] = f"""WITH {GRID_SQL}, s AS (SELECT symbol AS candidate, config, {_sharpe_sql("ret")} AS sharpe FROM runs GROUP BY ALL), b AS (SELECT candidate, sharpe AS base FROM s WHERE config = {GRID[1]}),
k AS (SELECT candidate, avg(CASE WHEN CASE WHEN base > 1e-9 THEN sharpe >= 0.7 * base ELSE sharpe >= base - 0.1 END THEN 1.0 ELSE 0.0 END) AS near, sqrt(avg((sharpe - base) ** 2)) AS rms, any_value(base) AS base FROM s JOIN b USING (candidate) WHERE config <> {GRID[1]} GROUP BY candidate)
SELECT candidate, round(0.6 * near + 0.4 * greatest(0, 1 - rms / greatest(0.25, abs(base))), 6) AS stability FROM k"""


def _z_past(n: int, x: str = "v") -> str:
    return f"CASE WHEN count({x}) OVER {over(n, 1)} >= 20 THEN ({x} - avg({x}) OVER {over(n, 1)}) / greatest(stddev_pop({x}) OVER {over(n, 1)}, 1e-6) ELSE 0 END"


ZS, EDGES, LENGTHS = (60, 120, 250), (0.0, 0.5, 1.0), (100, 150, 200, 250)
#: By query: what is wanted by configuration (as a column, as SQL, first row), days of training and of a step, rows purged, target.
WALKS: dict[str, tuple[Callable, dict[int, tuple[str, int]], int, int, int, float | None]] = {
    "wfd_trend": (lambda k: F.col("c") > w.sma(F.col("c"), LENGTHS[k]), {k: (f"c > {_avg(n)}", n + 1) for k, n in enumerate(LENGTHS)}, 540, 90, 5, None),
    "wfd_timing": (lambda k: w.past_zscore(F.col("v"), ZS[k // 3]) > EDGES[k % 3], {k: (f"{_z_past(ZS[k // 3])} > {EDGES[k % 3]}", ZS[k // 3] + 2) for k in range(9)}, 360, 120, 20, 0.4),
    "wfd_implied": (lambda k: w.past_zscore(F.col("v"), ZS[k // 3]) < -EDGES[k % 3], {k: (f"{_z_past(ZS[k // 3])} < -{EDGES[k % 3]}", max(ZS[k // 3] + 1, 22)) for k in range(9)}, 360, 120, 25, 0.4),
    "wfd_implied_high": (lambda k: w.past_zscore(F.col("v"), ZS[k // 3]) > EDGES[k % 3], {k: (f"{_z_past(ZS[k // 3])} > {EDGES[k % 3]}", max(ZS[k // 3] + 1, 22)) for k in range(9)}, 360, 120, 25, 0.4),
    "wfd_implied_gap_low": (lambda k: w.past_zscore(F.col("gap"), ZS[k // 3]) < -EDGES[k % 3], {k: (f"{_z_past(ZS[k // 3], 'gap')} < -{EDGES[k % 3]}", max(ZS[k // 3] + 1, 22)) for k in range(9)}, 360, 120, 25, 0.4),
    "wfd_implied_gap_high": (lambda k: w.past_zscore(F.col("gap"), ZS[k // 3]) > EDGES[k % 3], {k: (f"{_z_past(ZS[k // 3], 'gap')} > {EDGES[k % 3]}", max(ZS[k // 3] + 1, 22)) for k in range(9)}, 360, 120, 25, 0.4),
}


def walked(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    want, grid, train, step, purge, target = WALKS[name]
    # daily returns of the orders' bars are far above a market's: prices are drawn together
    daily = panels.bars_1d(spark, d).withColumn("c", F.exp(F.ln("c") / 50))
    if "gap" in name:  # the index less realised volatility
        daily = daily.withColumn("_r", F.col("c") / F.lag("c").over(w.order()) - 1).withColumn("gap", F.col("v") - F.coalesce(w.realised_vol(F.col("_r"), 20), F.lit(0.0))).drop("_r")
    return portfolio.sleeve_walk_forward(daily, {k: (want(k), warm) for k, (_, warm) in grid.items()}, train, step, purge, target=target, most=3.0)


def _walk_sql(name: str) -> str:
    _, grid, train, step, purge, target = WALKS[name]
    lev = "1.0" if target is None else f"CASE WHEN coalesce(stddev_pop(q) FILTER (WHERE live), 0) * sqrt(365) > 1e-9 THEN least(3.0, {target} / (stddev_pop(q) FILTER (WHERE live) * sqrt(365))) ELSE 1 END"
    runs = " UNION ALL ".join(f"SELECT symbol, ts, i, r, {k} AS config, {warm} AS warm, coalesce(CAST(lag(w{k}) OVER s AS DOUBLE), 0) AS one, coalesce(CAST(lag(w{k}, 2) OVER s AS DOUBLE), 0) AS two FROM b1 WINDOW s AS (PARTITION BY symbol ORDER BY ts)" for k, (_, warm) in grid.items())
    return f"""{BARS_1D}, bq AS (SELECT symbol, ts, i, v, exp(ln(c) / 50) AS c FROM bars_1d), br AS (SELECT *, c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS q FROM bq),
b0 AS (SELECT * EXCLUDE (q), v - CASE WHEN count(q) OVER {over(21)} > 5 THEN stddev_pop(q) OVER {over(21)} * sqrt(365) * 100 ELSE 0 END AS gap FROM br),
b1 AS (SELECT symbol, ts, i, gap, coalesce(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS r, {", ".join(f"coalesce({x}, false) AS w{k}" for k, (x, _) in grid.items())} FROM b0), ru AS ({runs}),
st AS (SELECT symbol, ts0 + INTERVAL {train} DAY + INTERVAL {step} DAY * k AS t, k FROM (SELECT symbol, min(ts) AS ts0, max(ts) AS ts1, unnest(range(200)) AS k FROM b0 GROUP BY symbol) WHERE ts0 + INTERVAL {train} DAY + INTERVAL {step} DAY * k <= ts1),
bo AS (SELECT symbol, k, min(i) AS a, min(i) FILTER (WHERE ts >= t) AS s, max(i) AS e FROM b1 JOIN st USING (symbol) WHERE ts >= t - INTERVAL {train} DAY AND ts < t + INTERVAL {step} DAY GROUP BY ALL HAVING max(i) > min(i) FILTER (WHERE ts >= t) + 5 AND min(i) FILTER (WHERE ts >= t) - 1 - {purge} - min(i) >= 120),
o0 AS (SELECT *, CASE WHEN i - 1 >= greatest(warm, a) THEN one ELSE 0 END AS held, CASE WHEN i - 2 >= greatest(warm, a) THEN two ELSE 0 END AS was, i > greatest(warm, a) AS live FROM ru JOIN bo USING (symbol) WHERE i BETWEEN a AND e),
ou AS (SELECT *, CASE WHEN live THEN held * r - abs(held - was) * 7e-4 ELSE 0 END AS q FROM o0),
ju AS (SELECT symbol, k, config, {_sharpe_sql(f"CASE WHEN i > a AND i <= s - 1 - {purge} THEN q END")} AS train_sharpe, {lev} AS lev FROM ou GROUP BY ALL),
ch AS (SELECT * FROM ju QUALIFY row_number() OVER (PARTITION BY symbol, k ORDER BY round(train_sharpe, 12) DESC, config) = 1),
te AS (SELECT symbol, k, config, train_sharpe, lev, i, {"q" if target is None else "greatest(-0.95, q * lev)"} AS ret FROM ou JOIN ch USING (symbol, k, config) WHERE i >= s)"""


for _name in WALKS:
    QUERIES[_name] = lambda spark, d, name=_name: walked(spark, d, name)[0].select("symbol", F.col("window").cast("int").alias("window"), F.col("config").cast("int").alias("config"), r("train_sharpe", 5).alias("train_sharpe"), r("lev", 5).alias("lev"), "n", r("ret").alias("ret"))
    SQL[_name] = f"WITH {_walk_sql(_name)} SELECT symbol, CAST(k AS INTEGER) AS \"window\", CAST(config AS INTEGER) AS config, round(any_value(train_sharpe), 5) + 0.0 AS train_sharpe, round(any_value(lev), 5) AS lev, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS ret FROM te GROUP BY symbol, k, config"
QUERIES["wfd_pooled"] = lambda spark, d: portfolio.pooled_stats(walked(spark, d, "wfd_trend")[1]).select("symbol", "n", *[r(c).alias(c) for c in ("sharpe", "max_dd", "positive_months", "worst_month")])
SQL["wfd_pooled"] = f"""WITH {_walk_sql("wfd_trend")}, p AS (SELECT symbol, i, ret, row_number() OVER s - 1 AS k, sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS l FROM te WINDOW s AS (PARTITION BY symbol ORDER BY i)),
dd AS (SELECT *, exp(l - greatest(max(l) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING), 0)) - 1 AS d FROM p), m AS (SELECT symbol, k // 30 AS m, exp(sum(ln(1 + ret))) - 1 AS g FROM p GROUP BY ALL),
mm AS (SELECT symbol, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS positive_months, least(min(g), 0) AS worst_month FROM m GROUP BY symbol)
SELECT symbol, count(*) AS n, round({_sharpe_sql("ret")}, 6) + 0.0 AS sharpe, round(least(min(d), 0), 6) + 0.0 AS max_dd, round(any_value(positive_months), 6) AS positive_months, round(any_value(worst_month), 6) + 0.0 AS worst_month FROM dd JOIN mm USING (symbol) GROUP BY symbol"""
QUERIES["prt_gate_a"] = lambda spark, d: portfolio.significant(streams(spark, d), 365).select("id", r("sharpe").alias("sharpe"), r("lo").alias("lo"), r("p5").alias("p5"), "passes")
SQL["prt_gate_a"] = f"""WITH {STREAMS}, al AS (SELECT id, {_sharpe_sql("ret")} AS sharpe FROM streams GROUP BY id), bi AS ({SQL["rsm_bootstrap_interval"]})
SELECT id, round(sharpe, 6) + 0.0 AS sharpe, lo, p5, coalesce(lo > 0 AND p5 >= 0, false) AS passes FROM al LEFT JOIN bi USING (id)"""
QUERIES["prt_gate_b"] = lambda spark, d: portfolio.admitted(portfolio.marginal_ratio(streams(spark, d), "5-LOW", 365)).select(r("marginal").alias("marginal"), r("max_corr").alias("max_corr"), "admits", "reason")
SQL["prt_gate_b"] = f"SELECT marginal, max_corr, coalesce(max_corr, 0) < 0.6 AND marginal >= 0.05 AS admits, CASE WHEN coalesce(max_corr, 0) >= 0.6 THEN 'near-duplicate' WHEN marginal >= 0.05 THEN 'lifts the book' ELSE 'not accretive' END AS reason FROM ({SQL['prt_marginal']})"
QUERIES["prt_gate_c"] = lambda spark, d: portfolio.book_gate(streams(spark, d), 365).select("members", *[r(c, 4).alias(c) for c in ("sharpe", "p5", "mean_abs_corr", "diversification")], "reasons", "passes")
_ERC = SQL["prt_book_erc"].replace("round(x / sum(x) OVER (), 6) AS weight, round(risk / sum(risk) OVER (), 6) AS risk", "x / sum(x) OVER () AS weight, 0 AS risk").replace("round(1 / (count(*) OVER ())::DOUBLE, 6)", "1 / (count(*) OVER ())::DOUBLE")
SQL["prt_gate_c"] = f"""WITH wt AS ({_ERC}), bo AS (WITH {STREAMS}, {SHARED} SELECT ts, sum(weight * ret) AS ret FROM sh JOIN wt USING (id) GROUP BY ts), ma AS ({SQL["agg_mean_abs_correlation"]}),
lo AS (SELECT max(p5) AS p5 FROM ({SQL["rsm_bootstrap_interval"].replace("WITH " + STREAMS, "WITH streams AS (SELECT 'book' AS id, ts, ret FROM bo)", 1)})),
di AS (WITH {STREAMS}, {SHARED} SELECT sum(weight * sd) / (SELECT CASE WHEN stddev_pop(ret) > 0 THEN stddev_pop(ret) END FROM bo) AS diversification, (SELECT count(*) FROM wt) AS members FROM (SELECT id, stddev_pop(ret) AS sd FROM sh GROUP BY id) JOIN wt USING (id)),
st AS (SELECT CASE WHEN stddev_pop(ret) > 1e-15 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END AS sharpe FROM bo),
al AS (SELECT members, sharpe, coalesce(p5, -9) AS p5, coalesce(mean_abs_corr, 0) AS mean_abs_corr, coalesce(diversification, 1) AS diversification FROM st, lo, ma, di)
SELECT members, round(sharpe, 4) + 0.0 AS sharpe, round(p5, 4) + 0.0 AS p5, round(mean_abs_corr, 4) AS mean_abs_corr, round(diversification, 4) AS diversification,
  array_to_string(list_filter([CASE WHEN NOT sharpe >= 1 THEN 'sharpe' END, CASE WHEN NOT p5 >= 1 THEN 'p5' END, CASE WHEN NOT mean_abs_corr <= 0.5 THEN 'mean_abs_corr' END], lambda x: x IS NOT NULL), '; ') AS reasons, sharpe >= 1 AND p5 >= 1 AND mean_abs_corr <= 0.5 AS passes FROM al"""
