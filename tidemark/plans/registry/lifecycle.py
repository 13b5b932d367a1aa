"""Candidates after their birth, monitors, sealed and crisis replays as queries. Candidates are made of orders, documents of parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lifecycle, portfolio
from tidemark.operators import windows as w
from tidemark.plans import expr, validation
from tidemark.plans.registry.base import BARS_1D, DAY, day, r
from tidemark.plans.registry.documents import CANDIDATES, candidates
from tidemark.plans.registry.returns import COST, DOCS, _sharpe_sql, _stages
from tidemark.sources import panels

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
NOW = "2001-06-01"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def sleeves(spark: SparkSession, d: str) -> DataFrame:
    """A sleeve document for each part."""
    k = F.col("p_partkey")
    return panels.table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("symbol"), F.col("p_size").alias("lookback"), (k % 25).alias("top"), (k % 70).alias("every"), F.when(k % 9 != 0, F.lit("long-flat")).alias("side"))


QUERIES["val_sleeves"] = lambda spark, d: sleeves(spark, d).select("id", F.array_join(lifecycle.faults("xsection", {"topK": F.col("top"), "rebalEvery": F.col("every"), "lookback": F.col("lookback")}, side=F.col("side") == "long-flat"), ",").alias("faults"))
SQL["val_sleeves"] = """SELECT p_partkey AS id, concat_ws(',', CASE WHEN NOT p_partkey % 25 BETWEEN 1 AND 20 THEN 'topK' END, CASE WHEN NOT p_partkey % 70 BETWEEN 1 AND 60 THEN 'rebalEvery' END,
  CASE WHEN NOT p_size BETWEEN 5 AND 400 THEN 'lookback' END, CASE WHEN p_partkey % 9 = 0 THEN 'side' END) AS faults FROM part"""
QUERIES["str_sleeve_hash"] = lambda spark, d: sleeves(spark, d).select("id", lifecycle.digest(F.lit("xs"), F.col("symbol"), F.col("lookback"), F.col("side")).alias("hash"))
SQL["str_sleeve_hash"] = """SELECT p_partkey AS id, substr(sha256('["xs","' || p_brand || '","' || p_size || '",' || CASE WHEN p_partkey % 9 <> 0 THEN '"long-flat"' ELSE 'null' END || ']'), 1, 24) AS hash FROM part"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_mktsegment")
    text = F.when(k % 4 == 0, F.to_json(F.struct(name.alias("symbol")))).when(k % 4 == 1, F.to_json(F.struct(F.array(F.struct(name.alias("symbol"))).alias("coins")))).when(k % 4 == 2, "{broken")
    return panels.table(spark, d, "customer").select("c_custkey", lifecycle.symbol_of(text, "A/B").alias("symbol"))


QUERIES["jsn_symbol"] = symbols
SQL["jsn_symbol"] = "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_mktsegment ELSE 'A/B' END AS symbol FROM customer"
QUERIES["val_has_data"] = lambda spark, d: panels.table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(panels.has_data(F.when(F.col("l_tax") > 0.03, F.col("l_discount"))).alias("has"))
SQL["val_has_data"] = "SELECT l_suppkey, l_linenumber, coalesce(bool_or(l_tax > 0.03 AND l_discount <> 0), false) AS has FROM lineitem GROUP BY ALL"
QUERIES["set_distinct_configs"] = lambda spark, d: lifecycle.distinct_configs(panels.table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), "l_suppkey", (F.col("l_discount") + F.col("l_linenumber") * 1e-6).alias("a"), F.col("l_tax").alias("b")), ("a", "b"), "id", ("l_suppkey",), 2).select("l_suppkey", F.col("id.l_orderkey").alias("o"), F.col("id.l_linenumber").alias("n"))
SQL["set_distinct_configs"] = "SELECT l_suppkey, l_orderkey AS o, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, round(l_discount + l_linenumber * 1e-6, 2), round(l_tax, 2) ORDER BY l_orderkey, l_linenumber) = 1"
QUERIES["top_widest"] = lambda spark, d: lifecycle.widest(panels.table(spark, d, "lineitem").select("l_orderkey", F.format_string("p%d", "l_linenumber").alias("name"), F.lit(0.0).alias("min"), F.col("l_quantity").alias("max"), F.col("l_tax").alias("default")), ("l_orderkey",)).select("l_orderkey", "name")
SQL["top_widest"] = "SELECT l_orderkey, 'p' || l_linenumber AS name FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / greatest(1e-9, abs(l_tax)) DESC, 'p' || l_linenumber) <= 6"
QUERIES["doc_alive_by_name"] = lambda spark, d: lifecycle.alive_by_name(candidates(spark, d), panels.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.format_string("c%d", "l_orderkey").alias("name"))).select("id", "name", "stage")
SQL["doc_alive_by_name"] = f"WITH {CANDIDATES} SELECT id, name, stage FROM c WHERE stage = 'incubating' AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
QUERIES["doc_without_family"] = lambda spark, d: lifecycle.without_family(candidates(spark, d), spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "family string")).select("id", "family")
SQL["doc_without_family"] = f"WITH {CANDIDATES} SELECT id, family FROM c WHERE family NOT IN ('1-URGENT', '5-LOW')"


def sourced(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    metrics = F.when(k % 5 == 0, '{"userStrategy": 1}').when(k % 5 == 1, '{"userStrategy": 0}').when(k % 5 == 2, "broken")
    return candidates(spark, d).withColumns({"source": F.when(k % 4 == 0, "blend").when(k % 4 == 1, "regime").when(k % 4 == 2, "seed"), "symbol": F.col("family"), "metrics": metrics})


SOURCED = f"{CANDIDATES}, sc AS (SELECT *, CASE id % 4 WHEN 0 THEN 'blend' WHEN 1 THEN 'regime' WHEN 2 THEN 'seed' END AS source, family AS symbol FROM c)"
QUERIES["doc_users_own"] = lambda spark, d: lifecycle.users_own(sourced(spark, d), "regime").select("id", "source")
SQL["doc_users_own"] = f"WITH {SOURCED} SELECT id, source FROM sc WHERE stage = 'incubating' AND (coalesce(source = 'regime', false) OR id % 5 = 0)"
QUERIES["doc_watchable"] = lambda spark, d: lifecycle.watchable(panels.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("equity")), sourced(spark, d), "blend", "1-URGENT").select("id", "name", "priority", "equity")
SQL["doc_watchable"] = f"WITH {SOURCED} SELECT id, name, CAST(CASE WHEN source = 'blend' AND symbol = '1-URGENT' THEN 0 WHEN source = 'blend' THEN 1 ELSE 2 END AS INTEGER) AS priority, o_totalprice AS equity FROM sc JOIN orders ON o_orderkey = id WHERE o_orderstatus = 'O'"
QUERIES["top_strategies"] = lambda spark, d: lifecycle.ranking(candidates(spark, d).withColumn("alive", F.col("stage") == "incubating"), "composite", "stage_no").select("id", "alive").limit(100)
SQL["top_strategies"] = f"WITH {CANDIDATES} SELECT id, stage = 'incubating' AS alive FROM c ORDER BY alive DESC, composite DESC NULLS LAST, stage_no DESC NULLS LAST, id LIMIT 100"


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """By customer orders and their sum: stored for some of them, recomputed for the rest."""
    computed = panels.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    stored = panels.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(0).cast("long").alias("n"), F.col("c_acctbal").alias("top"))
    return lifecycle.with_fallback(stored, computed, "o_custkey")


QUERIES["doc_summaries"] = summaries
SQL["doc_summaries"] = "SELECT c_custkey AS o_custkey, CAST(0 AS BIGINT) AS n, c_acctbal AS top, true AS cached FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, count(*), max(o_totalprice), false FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey"
QUERIES["agg_snapshot"] = lambda spark, d: lifecycle.latest_known(candidates(spark, d), "composite", "created", 400, ("id", "name", "composite")).select("id", "name", r("composite", 7).alias("composite"))
SQL["agg_snapshot"] = f"WITH {CANDIDATES}, l AS (SELECT * FROM c ORDER BY created DESC, id DESC LIMIT 400) SELECT id, name, round(composite, 7) AS composite FROM l WHERE composite IS NOT NULL ORDER BY created DESC, id DESC LIMIT 1"


def deployed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    customers = panels.table(spark, d, "customer")
    known = customers.select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 6 != 0, F.col("c_mktsegment")).alias("symbol"))
    asked = customers.select(k.alias("id"), (F.col("c_acctbal") + 2000).alias("capital"), F.when(k % 2 == 0, k / 100).alias("max_weight"), F.when(k % 3 == 0, 0.05).alias("band"), F.lit(None).cast("double").alias("max_daily_loss"), F.lit(None).cast("double").alias("max_drawdown"), F.when(k % 12 == 0, "ASKED").alias("asked_symbol"))
    return lifecycle.deployments(customers.where("c_nationkey < 5").select(k.alias("id")), asked, known)


DEPLOYED = """dp AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 12 = 0 THEN 'ASKED' WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS symbol, 'dryrun' AS mode, c_acctbal + 2000 AS capital,
  least(1.0, greatest(0.0, CASE WHEN c_custkey % 2 = 0 THEN c_custkey / 100.0::DOUBLE ELSE 1 END)) AS max_weight, CASE WHEN c_custkey % 3 = 0 THEN 0.05::DOUBLE ELSE 0.02 END AS band FROM customer WHERE c_nationkey >= 5)"""
QUERIES["doc_deployments"] = lambda spark, d: deployed(spark, d).select("id", "name", "symbol", "mode", r("capital", 4).alias("capital"), r("max_weight").alias("max_weight"), "band", r("max_daily_loss").alias("max_daily_loss"))
SQL["doc_deployments"] = f"WITH {DEPLOYED} SELECT id, name, symbol, mode, round(capital, 4) AS capital, round(max_weight, 6) AS max_weight, CAST(band AS DOUBLE) AS band, 6.0::DOUBLE AS max_daily_loss FROM dp WHERE symbol IS NOT NULL"
QUERIES["doc_recorded_runs"] = lambda spark, d: lifecycle.recorded(deployed(spark, d), panels.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("ts"), (F.col("o_totalprice") / 100).alias("equity"), (F.col("o_totalprice") > 350_000).alias("halt"))).select("id", "mode", r("equity", 4).alias("equity"), r("peak", 4).alias("peak"))
SQL["doc_recorded_runs"] = f"""WITH {DEPLOYED}, ru AS (SELECT o_custkey AS id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 100 AS e, max(o_totalprice) / 100 AS p, max(o_totalprice) > 350000 AS h FROM orders GROUP BY ALL)
SELECT id, CASE WHEN h THEN 'halted' ELSE mode END AS mode, round(coalesce(e, capital), 4) AS equity, round(greatest(capital, coalesce(p, capital)), 4) AS peak FROM dp LEFT JOIN ru USING (id) WHERE symbol IS NOT NULL"""
LIMITS = [("click", 1.0), ("error", 1e-3), ("never", 5.0)]
QUERIES["stm_stale"] = lambda spark, d: lifecycle.stale(panels.table(spark, d, "events").withColumnRenamed("event_type", "kind"), spark.createDataFrame(LIMITS, "kind string, hours double"), F.lit("2030-01-01").cast("timestamp_ntz")).select("kind", r("age").alias("age"))
SQL["stm_stale"] = f"WITH l AS (SELECT * FROM (VALUES {', '.join(map(str, LIMITS))}) AS t(kind, hours)), n AS (SELECT kind, hours, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(max(ts))) / 3.6e9 AS age FROM l LEFT JOIN events ON event_type = kind GROUP BY ALL) SELECT kind, round(age, 6) AS age FROM n WHERE age IS NULL OR age > hours"
QUERIES["stm_reaped"] = lambda spark, d: lifecycle.reaped(candidates(spark, d).withColumn("stage", F.when(F.col("id") % 3 == 0, "queued").otherwise(F.col("stage"))), now()).select("id", "stage", "failed_stage")
SQL["stm_reaped"] = f"WITH {CANDIDATES}, q AS (SELECT id, failed_stage, created < TIMESTAMP '{NOW}' - INTERVAL 3 DAY AND id % 3 = 0 AS stuck, CASE WHEN id % 3 = 0 THEN 'queued' ELSE stage END AS stage FROM c) SELECT id, CASE WHEN stuck THEN 'failed' ELSE stage END AS stage, CASE WHEN stuck THEN 'S0-stale' ELSE failed_stage END AS failed_stage FROM q"


def graduates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    own = candidates(spark, d).where("stage = 'incubating'").select("id", (k % 60).alias("days"), (k % 11 == 0).alias("halted"), F.col("composite").alias("live"), F.when(k % 5 != 0, F.lit(2.0)).alias("p5"), (k % 4 == 0).alias("diversifies"))
    return lifecycle.graduated(own, 30).select("id", "next", "why")


QUERIES["stm_graduated"] = graduates
SQL["stm_graduated"] = f"""WITH {CANDIDATES}, y AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'halted' WHEN id % 60 < 30 THEN 'early' WHEN composite >= CASE WHEN id % 5 <> 0 THEN 1.5 ELSE -0.5 END THEN 'band' WHEN id % 4 = 0 THEN 'book' ELSE 'below' END AS why FROM c WHERE stage = 'incubating')
SELECT id, CASE WHEN why = 'early' THEN 'incubating' WHEN why IN ('band', 'book') THEN 'eligible' ELSE 'failed' END AS next, why FROM y"""
QUERIES["stm_promoted"] = lambda spark, d: lifecycle.promoted(candidates(spark, d).where("stage = 'incubating'"), candidates(spark, d).where("stage = 'archived'").agg(F.avg("composite").alias("composite"))).select("id", r("composite", 7).alias("composite"))
SQL["stm_promoted"] = f"WITH {CANDIDATES} SELECT id, round(composite, 7) AS composite FROM c WHERE stage = 'incubating' AND composite >= 1.1 * (SELECT avg(composite) FROM c WHERE stage = 'archived') ORDER BY c.composite DESC, id LIMIT 1"


def champions(spark: SparkSession, d: str) -> DataFrame:
    e = panels.table(spark, d, "events")
    own = e.groupBy(F.col("event_type").alias("id")).agg(F.max(F.length("event_type") * 20.0).alias("p5"), F.lit(False).alias("halted"))
    return lifecycle.degraded(own, e.select(F.col("event_type").alias("id"), (F.col("value") / 1e4).alias("ret")), least=100).select("id", r("live", 4).alias("live"))


QUERIES["stm_degraded"] = champions
SQL["stm_degraded"] = "WITH l AS (SELECT event_type AS id, avg(value / 1e4) / stddev_pop(value / 1e4) * sqrt(365 * 24) AS live FROM events GROUP BY ALL HAVING count(value) > 100) SELECT id, round(live, 4) + 0.0 AS live FROM l WHERE live < length(id) * 20 - 1"


def signals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "oi").when(k % 3 == 1, "lsr").otherwise("close"), F.lit("_"), k.cast("string"))
    return panels.table(spark, d, "part").select(name.alias("signal"), ((k * 37 % 101) / 64 - 0.75).alias("ir"), (k % 7 == 0).alias("redundant"), (k % 3 < 2).alias("native"))


SIGNALS = "sg AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'oi' WHEN 1 THEN 'lsr' ELSE 'close' END || '_' || p_partkey AS signal, (p_partkey * 37 % 101) / 64.0 - 0.75 AS ir, p_partkey % 7 = 0 AS redundant, p_partkey % 3 < 2 AS native FROM part)"
QUERIES["agg_signal_weights"] = lambda spark, d: lifecycle.signal_weights(signals(spark, d), {"funding": "funding", "basis": "basis", "oi": "oi", "lsr": "lsr"}).select("family", r("weight").alias("weight"))
SQL["agg_signal_weights"] = f"WITH {SIGNALS} SELECT family, round(1 + coalesce(max(abs(ir)), 0), 6)::DOUBLE AS weight FROM (VALUES ('funding'), ('basis'), ('oi'), ('lsr')) AS f(family) LEFT JOIN sg ON starts_with(signal, family) AND NOT redundant GROUP BY family"
QUERIES["gen_ranking_text"] = lambda spark, d: lifecycle.ranking_text(signals(spark, d))
SQL["gen_ranking_text"] = f"WITH {SIGNALS}, t AS (SELECT *, row_number() OVER (ORDER BY abs(ir) DESC, signal) AS k FROM sg WHERE NOT redundant) SELECT string_agg(k || '. ' || signal || CASE WHEN native THEN ' (native)' ELSE '' END || ': IR ' || printf('%.2f', ir::DOUBLE), chr(10) ORDER BY k) AS text FROM t WHERE k <= 10"


def orthogonal(spark: SparkSession, d: str) -> DataFrame:
    """A bar's range against its volume, and against the closes of the day and the row before."""
    b = panels.bars_1d(spark, d).withColumn("before", w.lag(F.col("c"), 1))
    own = b.select(F.col("symbol").alias("signal"), (F.col("h") - F.col("l")).alias("x"), F.explode(F.array(*[F.struct(F.lit(n).alias("other"), F.col(c).alias("y")) for n, c in (("volume", "v"), ("close", "c"), ("before", "before"))])).alias("o"))
    return lifecycle.orthogonality(own.select("signal", "x", "o.other", "o.y")).select("signal", "others", r("max_corr").alias("max_corr"), "nearest")


QUERIES["agg_orthogonality"] = orthogonal
SQL["agg_orthogonality"] = f"""WITH {BARS_1D}, b AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars_1d), u AS (SELECT symbol, h - l AS x, 'volume' AS other, v AS y FROM b UNION ALL SELECT symbol, h - l, 'close', c FROM b UNION ALL SELECT symbol, h - l, 'before', before FROM b),
k AS (SELECT symbol, other, rank() OVER (PARTITION BY symbol, other ORDER BY x) + (count(*) OVER (PARTITION BY symbol, other, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, other ORDER BY y) + (count(*) OVER (PARTITION BY symbol, other, y) - 1) / 2.0 AS ry FROM u WHERE y IS NOT NULL),
q AS (SELECT symbol, other, abs(CASE WHEN count(*) >= 10 THEN coalesce(corr(rx, ry), 0) ELSE 0 END) AS a FROM k GROUP BY ALL)
SELECT symbol AS signal, count(*) AS others, round(max(a), 6) AS max_corr, arg_max(other, round(a, 12)) AS nearest FROM q GROUP BY symbol"""


def against_holding(spark: SparkSession, d: str) -> DataFrame:
    """The curve of a moving average of closes from its 30th on, against holding over the same time."""
    b = panels.bars_1d(spark, d).withColumn("m", F.when(F.col("i") >= 29, w.sma(F.col("c"), 30)))
    own = lifecycle.held_over(b, b.where("m is not null"), ("symbol",), "m")
    held = lifecycle.held_over(b, own, ("symbol",))
    stats = lambda x, name: lifecycle.curve_stats(x, ("symbol",)).select("symbol", *[r(c, 5).alias(f"{name}_{c}") for c in ("total", "cagr", "max_dd", "calmar")])
    return stats(own, "trend").join(stats(held, "hold"), "symbol")


QUERIES["agg_trend_vs_hold"] = against_holding
_STAT = """SELECT symbol, l - 1 AS total, CASE WHEN l > 0 THEN l ** (1 / years) - 1 ELSE -1 END AS cagr, dd AS max_dd FROM (SELECT symbol, arg_max(eq, ts) AS l, least(min(d), 0) AS dd, greatest(0.01, (epoch(max(ts)) - epoch(min(ts))) / (365 * 86400.0)) AS years
  FROM (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS d FROM {0}) GROUP BY symbol)"""
_FIGURES = ", ".join(f"round(CASE WHEN {p}.max_dd < 0 THEN {p}.cagr / abs({p}.max_dd) ELSE 0 END, 5) + 0.0 AS {n}_calmar, " + ", ".join(f"round({p}.{c}, 5) + 0.0 AS {n}_{c}" for c in ("total", "cagr", "max_dd")) for p, n in (("a", "trend"), ("b", "hold")))
SQL["agg_trend_vs_hold"] = f"""WITH {BARS_1D}, m AS (SELECT symbol, ts, i, c, avg(c) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS m FROM bars_1d), n AS (SELECT symbol, ts, m / first_value(m) OVER s AS e1, c / first_value(c) OVER s AS e2 FROM m WHERE i >= 29 WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
e1 AS (SELECT symbol, ts, e1 AS eq FROM n), e2 AS (SELECT symbol, ts, e2 AS eq FROM n), a AS ({_STAT.format("e1")}), b AS ({_STAT.format("e2")}) SELECT symbol, {_FIGURES} FROM a JOIN b USING (symbol)"""
QUERIES["bmk_hold"] = lambda spark, d: lifecycle.benchmark(panels.bars_1d(spark, d), now(), years=4, most=60).select("symbol", day(), r("c", 4).alias("c"))
SQL["bmk_hold"] = f"WITH {BARS_1D}, k AS (SELECT symbol, ts, c, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars_1d WHERE c > 0 AND ts >= TIMESTAMP '{NOW}' - INTERVAL {365 * 4} DAY) SELECT symbol, {DAY}, round(c, 4) AS c FROM k WHERE n >= 50 AND (k % greatest(1, CAST(ceil(n / 60.0) AS BIGINT)) = 0 OR k = n - 1)"
QUERIES["run_options"] = lambda spark, d: lifecycle.run_options(panels.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "1d").alias("tf")), {"1-URGENT": 1.5, "2-HIGH": 2.0}, {"1d": 365.0}).select("o_orderkey", "fee_bps", "slip_bps", "per_year")
SQL["run_options"] = "SELECT o_orderkey, 5.0::DOUBLE AS fee_bps, CASE o_orderpriority WHEN '1-URGENT' THEN 1.5 WHEN '2-HIGH' THEN 2.0 ELSE 4.0 END::DOUBLE AS slip_bps, CASE WHEN o_orderkey % 2 = 0 THEN 365 ELSE 8760 END::DOUBLE AS per_year FROM orders"
QUERIES["prt_hold"] = lambda spark, d: lifecycle.hold_stream(panels.bars_1d(spark, d), F.col("v") / 1e4, 20).select("symbol", day(), r("ret").alias("ret"))
SQL["prt_hold"] = f"WITH {BARS_1D} SELECT symbol, {DAY}, round(CASE WHEN i > 20 THEN c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1 - v / 1e4 ELSE 0 END, 6) + 0.0 AS ret FROM bars_1d"
QUERIES["gen_payload"] = lambda spark, d: lifecycle.payload(panels.bars_1d(spark, d).withColumn("m", w.sma(F.col("c"), 20)), ("m",)).select("symbol", F.size("points").alias("n"), F.date_format(F.col("points")[0]["ts"], "yyyy-MM-dd").alias("first_day"), r(F.aggregate("points", F.lit(0.0), lambda a, x: a + x["c"]) / F.size("points"), 4).alias("mean"), r(F.element_at("points", -1)["m"], 4).alias("last"))
SQL["gen_payload"] = f"WITH {BARS_1D}, m AS (SELECT symbol, ts, c, avg(c) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS m FROM bars_1d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 800) SELECT symbol, CAST(count(*) AS INTEGER) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day, round(avg(c), 4) AS mean, round(arg_max(m, ts), 4) AS last FROM m GROUP BY symbol"

CRISES = [("first", "1995-06-01", "1997-01-01"), ("second", "1997-10-01", "1999-06-01"), ("outside", "1980-01-01", "1981-01-01")]
SEAL = [("sealed", "1998-01-01", "2200-01-01")]


def replayed(spark: SparkSession, d: str, windows: list[tuple[str, str, str]], least: int) -> DataFrame:
    """Momentum on damped prices, from 1000 rows before each window."""
    cal = spark.createDataFrame(windows, "window string, start string, end string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    own = expr.evaluate(panels.bars_1d(spark, d), DOCS["momentum"])
    return validation.replay(own.withColumns({c: F.exp(F.ln(c) / 50) for c in ("c", "h")}), cal, COST, least=least)


def _replay_sql(windows: list[tuple[str, str, str]], least: int) -> str:
    own = "(PARTITION BY symbol, win ORDER BY ts)"
    return f"""{BARS_1D}, {_stages("momentum")}, cal AS (SELECT * FROM (VALUES {", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in windows)}) AS t(win, t0, t1)),
bo AS (SELECT symbol, win, min(i) AS a0, max(i) AS b0 FROM e JOIN cal ON ts >= t0 AND ts < t1 GROUP BY ALL HAVING max(i) - min(i) >= {least}),
r0 AS (SELECT symbol, win, ts, i, a0, exp(ln(c) / 50) AS c, enter, leave, row_number() OVER {own} AS j FROM e JOIN bo USING (symbol) WHERE i BETWEEN greatest(1, a0 - 1000) AND b0),
r1 AS (SELECT *, last_value(CASE WHEN j = 1 THEN 0 WHEN enter THEN 1 WHEN leave THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol, win ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pos FROM r0),
r2 AS (SELECT *, CASE WHEN j = 1 THEN 0 ELSE greatest(-0.95, coalesce(lag(pos) OVER s, 0) * (c / lag(c) OVER s - 1) - abs(coalesce(lag(pos) OVER s, 0) - coalesce(lag(pos, 2) OVER s, 0)) * {COST}) END AS q0, coalesce(lag(pos) OVER s, 0) <> pos AND pos <> 0 AS entry FROM r1 WINDOW s AS {own}),
r3 AS (SELECT *, exp(sum(ln(1 + q0)) OVER (PARTITION BY symbol, win ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS q1 FROM r2),
lv AS (SELECT * FROM (SELECT *, CASE WHEN coalesce(max(q1 <= 0.05) OVER (PARTITION BY symbol, win ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 0 ELSE q0 END AS ret FROM r3) WHERE i >= a0)"""


QUERIES["vld_crisis"] = lambda spark, d: validation.crisis(replayed(spark, d, CRISES, 48)).select("symbol", "window", r("ret").alias("ret"), r("max_dd").alias("max_dd"), "survives")
SQL["vld_crisis"] = f"""WITH {_replay_sql(CRISES, 48)}, l AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol, win ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM lv), f AS (SELECT *, exp(l - greatest(0, max(l) OVER (PARTITION BY symbol, win ORDER BY ts ROWS UNBOUNDED PRECEDING))) - 1 AS dd FROM l)
SELECT symbol, win AS "window", round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS ret, round(least(min(dd), 0), 6) + 0.0 AS max_dd, least(min(dd), 0) > {validation.FLOORS["crisis_max_dd"]} AS survives FROM f GROUP BY symbol, win"""
QUERIES["vld_sealed"] = lambda spark, d: validation.sealed(replayed(spark, d, SEAL, 100), 365).select("trades", r("sharpe").alias("sharpe"), r("ret").alias("ret"), r("max_dd").alias("max_dd"), "reason")
_F = validation.FLOORS
SQL["vld_sealed"] = f"""WITH {_replay_sql(SEAL, 100)}, po AS (SELECT ts, sum(ret) / (SELECT count(DISTINCT symbol) FROM lv) AS ret FROM lv GROUP BY ts), l AS (SELECT *, sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM po),
f AS (SELECT *, exp(l - greatest(0, max(l) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING))) - 1 AS dd FROM l), y AS (SELECT count(*) AS n, (SELECT CAST(count(*) FILTER (WHERE entry) AS BIGINT) FROM lv) AS trades, {_sharpe_sql("ret")} AS sharpe, exp(sum(ln(1 + ret))) - 1 AS ret, least(min(dd), 0) AS max_dd FROM f)
SELECT trades, round(sharpe, 6) + 0.0 AS sharpe, round(ret, 6) + 0.0 AS ret, round(max_dd, 6) + 0.0 AS max_dd, CASE WHEN n = 0 THEN 'no data' WHEN trades < {_F["sealed_trades"]} THEN 'trades' WHEN sharpe < {_F["sealed_sharpe"]} THEN 'sharpe' WHEN ret <= 0 THEN 'return' WHEN max_dd < {_F["sealed_max_dd"]} THEN 'fall' END AS reason FROM y"""

TRIALS = [(1, 1), (1, 5), (2, 5), (2, 10), (3, 20)]


def walked_panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The best 10-row changes of damped prices, walked forward over numbers held and rebalancing times."""
    b = panels.bars_1d(spark, d).withColumn("c", F.exp(F.ln("c") / 50))
    return portfolio.panel_walk_forward(b.withColumn("score", w.roc(F.col("c"), 10)), "score", TRIALS, 11, 12)


_RUN = "(PARTITION BY k, config, symbol ORDER BY i)"
WALKED = f"""{BARS_1D}, b0 AS (SELECT symbol, ts, exp(ln(c) / 50) AS c FROM bars_1d), b1 AS (SELECT symbol, ts, coalesce(c / lag(c) OVER s - 1, 0) AS r, c / lag(c, 10) OVER s - 1 AS x FROM b0 WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
ti AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM b0)),
b2 AS (SELECT *, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY ts ORDER BY x DESC NULLS LAST, symbol) END AS rk, count(x) OVER (PARTITION BY ts) AS nv FROM b1 JOIN ti USING (ts)),
st AS (SELECT k, t0 + INTERVAL 360 DAY + INTERVAL 30 DAY * k AS t FROM (SELECT min(ts) AS t0, max(ts) AS t1, unnest(range(200)) AS k FROM ti) WHERE t0 + INTERVAL 390 DAY + INTERVAL 30 DAY * k <= t1),
bo AS (SELECT k, min(i) AS a, min(i) FILTER (WHERE ts >= t) AS s, max(i) AS e, greatest(11, min(i)) AS i0 FROM ti JOIN st ON ts >= t - INTERVAL 360 DAY AND ts < t + INTERVAL 30 DAY GROUP BY k HAVING max(i) > min(i) FILTER (WHERE ts >= t) + 8 AND min(i) FILTER (WHERE ts >= t) - 13 - min(i) >= 146),
gr AS (SELECT * FROM (VALUES {", ".join(f"({c}, {k}, {n})" for c, (k, n) in enumerate(TRIALS))}) AS g(config, top, every)),
w0 AS (SELECT *, CASE WHEN i >= i0 AND (i - i0) % every = 0 THEN CASE WHEN rk <= top THEN 1.0::DOUBLE / least(top, nv) ELSE 0 END END AS d FROM b2 JOIN bo ON i BETWEEN a AND e CROSS JOIN gr),
w1 AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY k, config, symbol ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS w FROM w0),
w2 AS (SELECT k, config, i, a, s, i0, CASE WHEN i > i0 THEN coalesce(lag(w) OVER s0, 0) * r - abs(coalesce(lag(w) OVER s0, 0) - coalesce(lag(w, 2) OVER s0, 0)) * 13e-4 ELSE 0 END AS x FROM w1 WINDOW s0 AS {_RUN}),
bk AS (SELECT k, config, i, a, s, i0, sum(x) AS raw FROM w2 GROUP BY ALL),
ju AS (SELECT k, config, {_sharpe_sql("CASE WHEN i > a AND i <= s - 13 THEN raw END")} AS train_sharpe, CASE WHEN stddev_pop(CASE WHEN i > i0 THEN raw END) * sqrt(365) > 1e-9 THEN least(3.0, 0.4 / (stddev_pop(CASE WHEN i > i0 THEN raw END) * sqrt(365))) ELSE 1 END AS lev FROM bk GROUP BY ALL),
ch AS (SELECT * FROM ju QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(train_sharpe, 12) DESC, config) = 1),
te AS (SELECT k, config, train_sharpe, lev, i, greatest(-0.95, raw * lev) AS ret FROM bk JOIN ch USING (k, config) WHERE i >= s)"""
QUERIES["prt_panel_walk_forward"] = lambda spark, d: walked_panel(spark, d)[0].select(F.col("window").cast("int").alias("window"), "config", r("train_sharpe", 5).alias("train_sharpe"), r("lev", 5).alias("lev"), "n", r("ret").alias("ret"))
SQL["prt_panel_walk_forward"] = f'WITH {WALKED} SELECT CAST(k AS INTEGER) AS "window", config, round(any_value(train_sharpe), 5) + 0.0 AS train_sharpe, round(any_value(lev), 5) + 0.0 AS lev, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS ret FROM te GROUP BY k, config'
QUERIES["prt_panel_pooled"] = lambda spark, d: portfolio.pooled_stats(walked_panel(spark, d)[1].withColumn("symbol", F.lit("book"))).select("n", *[r(c).alias(c) for c in ("sharpe", "max_dd", "positive_months", "worst_month")])
SQL["prt_panel_pooled"] = f"""WITH {WALKED}, p AS (SELECT i, ret, row_number() OVER (ORDER BY i) - 1 AS n, sum(ln(1 + ret)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS l FROM te), dd AS (SELECT *, exp(l - greatest(max(l) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 0)) - 1 AS d FROM p),
mo AS (SELECT n // 30 AS m, exp(sum(ln(1 + ret))) - 1 AS g FROM p GROUP BY ALL)
SELECT count(*) AS n, round({_sharpe_sql("ret")}, 6) + 0.0 AS sharpe, round(least(min(d), 0), 6) + 0.0 AS max_dd, round((SELECT avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) FROM mo), 6) AS positive_months, round((SELECT least(min(g), 0) FROM mo), 6) + 0.0 AS worst_month FROM dd"""
