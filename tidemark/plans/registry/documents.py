"""Document tables, text and JSON scalars, and file sources as queries.

Candidates are made of orders: family and stage follow the order's priority and key, scores its price.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.operators import aggregates, documents
from tidemark.plans.registry.base import r
from tidemark.sources import files, panels

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
STAGES = ["S2", "S3", "S4", "S5", "S6"]
CANDIDATES = """c AS (SELECT o_orderkey AS id, o_orderpriority AS family, 'c' || o_orderkey AS name, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1e5 END AS composite,
  CAST(o_orderkey % 6 AS INTEGER) AS stage_no, CASE WHEN o_orderkey % 6 < 5 THEN 'S' || (o_orderkey % 6 + 2) END AS failed_stage, o_orderdate AS created, CASE WHEN o_orderkey % 6 < 5 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'archived' ELSE 'incubating' END AS stage FROM orders)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    stage = F.when(k % 6 < 5, "failed").when(k % 5 == 0, "archived").otherwise("incubating")
    return panels.table(spark, d, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("family"), F.concat(F.lit("c"), k.cast("string")).alias("name"), F.when(k % 7 != 0, F.col("o_totalprice") / 1e5).alias("composite"),
        (k % 6).cast("int").alias("stage_no"), F.when(k % 6 < 5, F.concat(F.lit("S"), (k % 6 + 2).cast("string"))).alias("failed_stage"), F.col("o_orderdate").alias("created"), stage.alias("stage"),
    )


QUERIES["agg_funnel"] = lambda spark, d: aggregates.funnel(candidates(spark, d), STAGES).select("stage", "killed", "reached")
SQL["agg_funnel"] = f"WITH {CANDIDATES}, st AS (SELECT * FROM (VALUES {', '.join(f'({i}, {s!r})' for i, s in enumerate(STAGES))}) AS t(k, sn)), n AS (SELECT k, sn, (SELECT count(*) FROM c WHERE failed_stage = sn) AS killed FROM st) SELECT sn AS stage, killed, CAST((SELECT count(*) FROM c) - coalesce(sum(killed) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS reached FROM n"
QUERIES["agg_family_rollup"] = lambda spark, d: aggregates.family_rollup(candidates(spark, d)).select("family", "bred", "scored", r("best").alias("best"), "best_name", r("mean").alias("mean"), "deepest", "survivors")
SQL["agg_family_rollup"] = f"WITH {CANDIDATES} SELECT family, count(*) AS bred, count(composite) AS scored, round(max(composite), 6) AS best, arg_max(name, (composite, name)) FILTER (WHERE composite IS NOT NULL) AS best_name, round(avg(composite), 6) AS mean, max(stage_no) AS deepest, count(*) FILTER (WHERE failed_stage IS NULL) AS survivors FROM c GROUP BY family"
QUERIES["agg_progression"] = lambda spark, d: aggregates.progression(candidates(spark, d), 800).select("id", r("composite", 7).alias("composite"), r("best_so_far", 7).alias("best_so_far"))
SQL["agg_progression"] = f"WITH {CANDIDATES}, l AS (SELECT * FROM c WHERE composite IS NOT NULL ORDER BY created DESC, id DESC LIMIT 800) SELECT id, round(composite, 7) AS composite, round(max(composite) OVER (ORDER BY created, id ROWS UNBOUNDED PRECEDING), 7) AS best_so_far FROM l"
QUERIES["agg_sources"] = lambda spark, d: candidates(spark, d).agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
SQL["agg_sources"] = f"WITH {CANDIDATES} SELECT string_agg(family, ',' ORDER BY family) AS families FROM (SELECT DISTINCT family FROM c)"
QUERIES["agg_coverage"] = lambda spark, d: files.catalog(panels.bars_1d(spark, d).withColumn("tf", F.lit("1d"))).select("symbol", "tf", "bars", F.date_format("first_ts", "yyyy-MM-dd").alias("first_day"), F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"))
SQL["agg_coverage"] = "SELECT o_orderpriority AS symbol, '1d' AS tf, count(DISTINCT CAST(o_orderdate AS DATE)) AS bars, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY o_orderpriority"
QUERIES["agg_recipes"] = lambda spark, d: aggregates.recipe_rollup(candidates(spark, d).withColumns({"success": F.col("failed_stage").isNull(), "score": F.col("composite")}), "family").select("family", "attempts", "successes", r("score_sum", 4).alias("score_sum"), r("score_mean").alias("score_mean"), r("posterior_mean").alias("posterior_mean"))
SQL["agg_recipes"] = f"WITH {CANDIDATES} SELECT family, count(*) AS attempts, count(*) FILTER (WHERE failed_stage IS NULL) AS successes, round(sum(composite), 4) AS score_sum, round(avg(composite), 6) AS score_mean, round((count(*) FILTER (WHERE failed_stage IS NULL) + 1) / (count(*) + 2.0), 6) AS posterior_mean FROM c GROUP BY family"
QUERIES["agg_kill_bars"] = lambda spark, d: candidates(spark, d).where("failed_stage is not null").groupBy("failed_stage").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failed_stage").limit(8)
SQL["agg_kill_bars"] = f"WITH {CANDIDATES} SELECT failed_stage, count(*) AS n FROM c WHERE failed_stage IS NOT NULL GROUP BY failed_stage ORDER BY n DESC, failed_stage LIMIT 8"


def live(spark: SparkSession, d: str) -> DataFrame:
    e = panels.table(spark, d, "events").groupBy(F.col("event_type").alias("id"), F.window("ts", "1 hour")["start"].alias("ts")).agg((100 + F.avg("value")).alias("equity"), F.count("*").alias("n"))
    return aggregates.live_metrics(e.withColumn("weight", F.when(F.col("n") > 2, 1.0).otherwise(0.0))).select("id", *[r(c).alias(c) for c in ("total_return", "max_dd", "sharpe", "cagr", "time_in_market")])


QUERIES["agg_live_metrics"] = live
SQL["agg_live_metrics"] = """WITH e AS (SELECT event_type AS id, date_trunc('hour', ts) AS ts, 100 + avg(value) AS equity, CASE WHEN count(*) > 2 THEN 1 ELSE 0 END AS weight FROM events GROUP BY ALL),
m AS (SELECT *, equity / lag(equity) OVER s - 1 AS ret, equity / max(equity) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd, epoch(lead(ts) OVER s) - epoch(ts) AS span FROM e WINDOW s AS (PARTITION BY id ORDER BY ts))
SELECT id, round(arg_max(equity, ts) / arg_min(equity, ts) - 1, 6) + 0.0 AS total_return, round(min(dd), 6) + 0.0 AS max_dd, round(CASE WHEN count(ret) >= 48 AND stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(365 * 24) END, 6) + 0.0 AS sharpe,
  round(CASE WHEN (epoch(max(ts)) - epoch(min(ts))) / 86400.0 >= 14 THEN (arg_max(equity, ts) / arg_min(equity, ts)) ** (365 / ((epoch(max(ts)) - epoch(min(ts))) / 86400.0)) - 1 END, 6) + 0.0 AS cagr, round(coalesce(sum(CASE WHEN weight <> 0 THEN span END) / sum(span), 0), 6) AS time_in_market FROM m GROUP BY id"""
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """An equity for each event, as of an account that is marked at odd times."""
    return panels.table(spark, d, "events").select(F.col("event_type").alias("id"), "ts", (100 + F.col("value")).alias("equity"), "event_id").groupBy("id", "ts").agg(F.max_by("equity", "event_id").alias("equity"))


SNAPSHOTS = "snaps AS (SELECT event_type AS id, ts, arg_max(100 + value, event_id) AS equity FROM events GROUP BY ALL)"
QUERIES["win_daily_returns"] = lambda spark, d: aggregates.daily_returns(snapshots(spark, d)).select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"), r("ret").alias("ret"))
SQL["win_daily_returns"] = f"""WITH {SNAPSHOTS}, d AS (SELECT id, CAST(ts AS DATE) AS day, arg_max(equity, ts) AS e, count(*) AS k FROM snaps GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, sum(k) OVER (PARTITION BY id) AS ks, lag(e) OVER (PARTITION BY id ORDER BY day) AS was FROM d)
SELECT id, strftime(day, '%Y-%m-%d') AS day, round(e / was - 1, 6) + 0.0 AS ret FROM w WHERE n >= 6 AND ks >= 3 AND was > 0"""
QUERIES["win_worst_fall"] = lambda spark, d: aggregates.worst_fall(snapshots(spark, d)).select("id", r("depth").alias("depth"), F.date_format("peak", "yyyy-MM-dd HH:mm:ss").alias("peak"), F.date_format("trough", "yyyy-MM-dd HH:mm:ss").alias("trough"))
SQL["win_worst_fall"] = f"""WITH {SNAPSHOTS}, t AS (SELECT *, max(equity) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM snaps), p AS (SELECT *, min(ts) OVER (PARTITION BY id, top ORDER BY ts ROWS UNBOUNDED PRECEDING) AS since, equity / top - 1 AS fall FROM t),
w AS (SELECT id FROM p GROUP BY id HAVING count(*) >= 5),
x AS (SELECT id, fall, since, ts FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY fall, ts) = 1)
SELECT id, round(least(fall, 0), 6) + 0.0 AS depth, CASE WHEN fall < 0 THEN strftime(since, '%Y-%m-%d %H:%M:%S') END AS peak, CASE WHEN fall < 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS trough FROM x WHERE id IN (SELECT id FROM w)"""


QUERIES["top_leaderboard"] = lambda spark, d: documents.leaderboard(candidates(spark, d), "composite", 25).select("id", "family", r("composite", 7).alias("composite"))
SQL["top_leaderboard"] = f"WITH {CANDIDATES} SELECT id, family, round(composite, 7) AS composite FROM c WHERE composite IS NOT NULL AND stage NOT IN ('failed', 'archived') ORDER BY c.composite DESC, id LIMIT 25"
QUERIES["doc_newest"] = lambda spark, d: documents.newest(candidates(spark, d), "created", 30).select("id", "name")
SQL["doc_newest"] = f"WITH {CANDIDATES} SELECT id, name FROM c ORDER BY created DESC, id DESC LIMIT 30"
QUERIES["doc_rollback"] = lambda spark, d: documents.rollback(candidates(spark, d).withColumnRenamed("created", "updated")).select("id", "name", "family")
SQL["doc_rollback"] = f"WITH {CANDIDATES} SELECT id, name, family FROM c WHERE stage = 'archived' ORDER BY created DESC, id DESC LIMIT 1"


def overview(spark: SparkSession, d: str) -> DataFrame:
    own = documents.with_last_children(panels.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), panels.table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k", "o_orderdate", 3, ("o_orderkey",))
    return own.select("k", F.array_join(F.transform(F.coalesce("children", F.array()), lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


QUERIES["doc_last_children"] = overview
SQL["doc_last_children"] = "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT c_custkey AS k, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n), '') AS orders FROM customer LEFT JOIN o ON o_custkey = c_custkey AND n <= 3 GROUP BY c_custkey"
QUERIES["snk_retention"] = lambda spark, d: documents.stripped(candidates(spark, d).withColumn("curve", F.col("name")), "curve", "created", F.lit("2000-01-01").cast("timestamp_ntz"), "composite", 150).select("id", "curve")
SQL["snk_retention"] = f"WITH {CANDIDATES}, b AS (SELECT id FROM c WHERE composite IS NOT NULL ORDER BY composite DESC, id LIMIT 150) SELECT id, CASE WHEN NOT (stage = 'failed' AND created < TIMESTAMP '2000-01-01' AND id NOT IN (SELECT id FROM b)) THEN name END AS curve FROM c"


def upsert(spark: SparkSession, d: str) -> DataFrame:
    old = panels.table(spark, d, "customer").where("c_custkey <= 1000").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = panels.table(spark, d, "customer").where("c_custkey > 900").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return documents.upsert(old, new, ("c_custkey",))


QUERIES["snk_upsert"] = upsert
SQL["snk_upsert"] = "WITH o AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey <= 1000), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS s, 0.0::DOUBLE AS b FROM customer WHERE c_custkey > 900) SELECT c_custkey, coalesce(s, c_mktsegment) AS c_mktsegment, coalesce(b, c_acctbal) AS c_acctbal FROM o FULL JOIN n USING (c_custkey)"


def append(spark: SparkSession, d: str) -> DataFrame:
    b = panels.bars_1d(spark, d)
    old = b.where(F.col("ts") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return documents.append_new(old, b, ("symbol",), closed=F.col("ts") < F.lit("2001-07-01").cast("timestamp_ntz")).groupBy("symbol").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


QUERIES["snk_append"] = append
SQL["snk_append"] = "WITH b AS (SELECT DISTINCT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT symbol, count(*) AS n, strftime(min(d), '%Y-%m-%d') AS first_day FROM b WHERE d < DATE '2001-07-01' AND d > (SELECT max(d) FROM b x WHERE x.symbol = b.symbol AND d < DATE '2001-01-01') GROUP BY symbol"
QUERIES["snk_insert_absent"] = lambda spark, d: documents.insert_absent(panels.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k")), panels.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k")
SQL["snk_insert_absent"] = "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)"
QUERIES["snk_counters"] = lambda spark, d: documents.counters(panels.table(spark, d, "events").select(F.col("event_type").alias("key"), F.lit(1).alias("amount")))
SQL["snk_counters"] = "SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type"
QUERIES["snk_latest"] = lambda spark, d: documents.latest(panels.table(spark, d, "events").select("user_id", "event_id", "event_type"), ("user_id",), "event_id")
SQL["snk_latest"] = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"
QUERIES["jsn_score"] = lambda spark, d: panels.table(spark, d, "events").select("event_id", documents.json_score(F.col("props"), "$.port", "$.wf", "$.k").alias("score"))
SQL["jsn_score"] = "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.port'), json_extract_string(props, '$.wf'), json_extract_string(props, '$.k')) AS DOUBLE) AS score FROM events"
QUERIES["str_reason"] = lambda spark, d: panels.table(spark, d, "customer").select("c_custkey", documents.reason(F.concat(F.when(F.col("c_custkey") % 3 == 0, "stop ").when(F.col("c_custkey") % 3 == 1, "flip ").otherwise("Kill"), F.col("c_custkey").cast("string"))).alias("reason"))
SQL["str_reason"] = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'stopped at ' || c_custkey WHEN 1 THEN 'turned' ELSE 'killed' END AS reason FROM customer"
QUERIES["str_hash"] = lambda spark, d: panels.table(spark, d, "part").select("p_partkey", F.substring(F.sha2("p_name", 256), 1, 24).alias("hash"), files.base_asset(F.replace("p_brand", F.lit("#"), F.lit("/"))).alias("base"), files.venue_symbol(F.replace("p_brand", F.lit("#"), F.lit("/"))).alias("venue"))
SQL["str_hash"] = "SELECT p_partkey, substr(sha256(p_name), 1, 24) AS hash, split_part(replace(p_brand, '#', '/'), '/', 1) AS base, replace(replace(p_brand, '#', '/'), '/', '') AS venue FROM part"
QUERIES["str_stage_name"] = lambda spark, d: candidates(spark, d).select("id", documents.stage_name(F.coalesce("failed_stage", F.lit("alive")), (("^S[23]", "early"), ("^S[45]", "middle"), ("^S", "late"))).alias("stage"))
SQL["str_stage_name"] = f"WITH {CANDIDATES} SELECT id, CASE WHEN failed_stage IN ('S2', 'S3') THEN 'early' WHEN failed_stage IN ('S4', 'S5') THEN 'middle' WHEN failed_stage LIKE 'S%' THEN 'late' ELSE 'other' END AS stage FROM c"
QUERIES["str_money"] = lambda spark, d: panels.table(spark, d, "orders").select("o_orderkey", maths.money(F.floor("o_totalprice") * F.lit(100) + 7).alias("money"), r(maths.round_down(F.col("o_totalprice"), 0.25), 2).alias("step"))
SQL["str_money"] = "SELECT o_orderkey, CASE WHEN (floor(o_totalprice) * 100 + 7) >= 1e6 THEN printf('$%.1fM', (floor(o_totalprice) * 100 + 7) / 1e6) WHEN (floor(o_totalprice) * 100 + 7) >= 1e3 THEN printf('$%.1fk', (floor(o_totalprice) * 100 + 7) / 1e3) ELSE printf('$%.0f', (floor(o_totalprice) * 100 + 7)) END AS money, round(floor(o_totalprice / 0.25 + 1e-9) * 0.25, 2) AS step FROM orders"
QUERIES["src_millis"] = lambda spark, d: panels.table(spark, d, "events").select("event_id", files.millis(maths.micros(F.col("ts"))).alias("ms"))
SQL["src_millis"] = "SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events"
QUERIES["src_months"] = lambda spark, d: files.months(spark, "1995-01-15", "1996-03-02").select(F.date_format("month", "yyyy-MM").alias("month"))
SQL["src_months"] = "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-03-02', INTERVAL 1 MONTH)) AS m)"
QUERIES["src_last_price"] = lambda spark, d: panels.table(spark, d, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"))
SQL["src_last_price"] = "SELECT event_type, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type"
