"""Aggregates over returns, signals and documents: metrics, moments, probabilities, correlations, rollups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import micros, normal_cdf, normal_quantile
from tidemark.functions.nulls import EPS

EULER = 0.5772156649015329


def sharpe(ret: Column, per_year: float, eps: float = EPS) -> Column:
    sd = F.stddev_pop(ret)
    return F.when(sd > eps, F.avg(ret) / sd * math.sqrt(per_year)).otherwise(0.0)


def metrics(returns: DataFrame, per_year: float, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The bundle of figures of (by, ts, w_held, turnover, ret): one grouping after one window for the equity path.

    w_held: the weight that earned ret; turnover: its change.
    """
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = returns.withColumn("_log", F.sum(F.log1p("ret")).over(w))
    own = own.withColumn("_dd", F.exp(F.col("_log") - F.max("_log").over(w)) - 1)
    r, n = F.col("ret"), F.count("*")
    down = F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / n)
    out = own.groupBy(*by).agg(
        n.alias("bars"),
        (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"),
        sharpe(r, per_year).alias("sharpe"),
        F.when(down > EPS, F.avg(r) / down * math.sqrt(per_year)).otherwise(0.0).alias("sortino"),
        F.min("_dd").alias("max_dd"),
        F.avg((F.col("w_held") != 0).cast("double")).alias("exposure"),
        (F.sum("turnover") / n * per_year).alias("turnover_per_year"),
    )
    cagr = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(per_year) / F.col("bars")) - 1).otherwise(-1.0)
    out = out.withColumn("cagr", cagr)
    return out.withColumn("calmar", F.when(F.col("max_dd") < 0, F.col("cagr") / F.abs("max_dd")).when(F.col("cagr") > 0, 99.0).otherwise(0.0))


def monthly(returns: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Compounded returns by month."""
    return returns.groupBy(*by, F.date_format("ts", "yyyy-MM").alias("ym")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"))


def series_stats(returns: DataFrame, per_year: float, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Share of positive months, the worst month, and growth a year (0 for under 0.2 years)."""
    months = monthly(returns, by).groupBy(*by).agg(F.avg((F.col("ret") > 0).cast("double")).alias("positive_months"), F.min("ret").alias("worst_month"))
    growth = returns.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.log1p("ret")).alias("g"))
    years = F.col("n") / per_year
    return months.join(growth, list(by)).select(*by, "positive_months", "worst_month", F.when(years < 0.2, 0.0).otherwise(F.exp(F.col("g") / years) - 1).alias("cagr"))


def moments(ret: Column) -> dict[str, Column]:
    """Population moments; kurtosis is that of the raw fourth moment, 3 for a normal series."""
    sd = F.stddev_pop(ret)
    return {"n": F.count(ret), "mean": F.avg(ret), "sd": sd, "skew": F.when(sd > 0, F.skewness(ret)).otherwise(0.0), "kurt": F.when(sd > 0, F.kurtosis(ret) + 3).otherwise(3.0)}


def probabilistic_sharpe(benchmark: Column) -> Column:
    """Of columns of moments(): the chance that the true ratio a period is above the benchmark."""
    sr = F.col("mean") / F.col("sd")
    spread = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    known = (F.col("sd") > EPS) & (F.col("n") >= 10) & (spread > 0)
    return F.when(known, normal_cdf((sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(spread))).otherwise(0.0)


def expected_best(trials: Column, per_year: Column, variance: float = 0.25) -> Column:
    """The best ratio a period that so many trials without skill are expected to reach; variance: of ratios a year."""
    n = F.greatest(trials.cast("double"), F.lit(2.0))
    best = (1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e))
    return F.sqrt(F.lit(variance) / F.greatest(per_year.cast("double"), F.lit(1.0))) * best


def pearson(x: Column, y: Column) -> Column:
    """Correlation between -1 and 1, 0 if either side is constant."""
    known = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.coalesce(F.when(known, F.least(F.greatest(F.corr(x, y), F.lit(-1.0)), F.lit(1.0))), F.lit(0.0))


def covariances(streams: DataFrame) -> DataFrame:
    """a, b, cov: of streams with the same times (see joins.intersection), for a <= b."""
    left, right = streams.select("ts", F.col("id").alias("a"), F.col("ret").alias("x")), streams.select("ts", F.col("id").alias("b"), F.col("ret").alias("y"))
    return left.join(right, "ts").where("a <= b").groupBy("a", "b").agg(F.covar_pop("x", "y").alias("cov"))


def correlations(streams: DataFrame) -> DataFrame:
    left, right = streams.select("ts", F.col("id").alias("a"), F.col("ret").alias("x")), streams.select("ts", F.col("id").alias("b"), F.col("ret").alias("y"))
    return left.join(right, "ts").where("a < b").groupBy("a", "b").agg(pearson(F.col("x"), F.col("y")).alias("corr"))


def mean_abs_correlation(streams: DataFrame) -> DataFrame:
    return correlations(streams).agg(F.avg(F.abs("corr")).alias("mean_abs_corr"))


def information_coefficients(pairs: DataFrame, by: tuple[str, ...] = ("signal",), least: int = 20, most: int = 60, per_year: float = 365.0) -> DataFrame:
    """Rank correlations of x and y in contiguous blocks of (by, ts, x, y): mean, deviation, ratio and t of the blocks.

    There are n / least blocks, `most` at most; the last takes the remainder. Ratios of one value saturate at 99.
    """
    order, whole = Window.partitionBy(*by).orderBy("ts"), Window.partitionBy(*by)
    own = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    k = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / least)))
    own = own.withColumn("k", k).withColumn("block", F.least(F.floor(F.col("i") / F.floor(F.col("n") / F.col("k"))), F.col("k") - 1))
    inside = Window.partitionBy(*by, "block")
    for c in ("x", "y"):
        own = own.withColumn(f"r{c}", F.rank().over(inside.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, "block", c)) - 1) / 2)
    ics = own.groupBy(*by, "block").agg(pearson(F.col("rx"), F.col("ry")).alias("ic"))
    sd = F.stddev_pop("ic")
    out = ics.groupBy(*by).agg(F.count("*").alias("blocks"), F.avg("ic").alias("mean_ic"), sd.alias("sd_ic"))
    flat = F.col("sd_ic") <= EPS
    ratio = F.when(~flat, F.col("mean_ic") / F.col("sd_ic")).otherwise(F.when(F.abs("mean_ic") <= EPS, 0.0).otherwise(F.signum("mean_ic") * 99.0))
    return out.withColumn("ir", F.least(F.greatest(ratio, F.lit(-99.0)), F.lit(99.0))).withColumn("t", F.least(F.greatest(F.col("ir") * F.sqrt("blocks"), F.lit(-99.0)), F.lit(99.0)))


def redundancy(ranked: DataFrame, corr: DataFrame, least: float = 0.8) -> DataFrame:
    """Signals with the better-ranked one that they are closest to. ranked: signal, rank; corr: a, b, corr (a < b)."""
    both = corr.select("a", "b", "corr").union(corr.select("b", "a", "corr"))
    better = both.join(ranked.select(F.col("signal").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("signal").alias("b"), F.col("rank").alias("rb")), "b").where("rb < ra")
    near = better.groupBy(F.col("a").alias("signal")).agg(F.max(F.abs("corr")).alias("max_corr"), F.max_by("b", F.struct(F.abs("corr"), -F.col("rb"))).alias("nearest"))
    return ranked.join(near, "signal", "left").withColumn("redundant", F.coalesce(F.col("max_corr") >= least, F.lit(False)))


QUANTILES = {
    "floor_n": lambda n, p: F.least(n - 1, F.floor(n * p)),
    "round_n1": lambda n, p: F.floor((n - 1) * p + 0.5),
    "floor_n1": lambda n, p: F.floor((n - 1) * p),
    "upper_median": lambda n, p: F.floor(n / 2),
}


def quantile(x: Column, p: float, method: str = "floor_n") -> Column:
    """A sorted list's element, by one of the four conventions in use; never interpolated. For bounded groups."""
    own = F.array_sort(F.collect_list(x))
    return F.when(F.size(own) > 0, F.element_at(own, (QUANTILES[method](F.size(own), p) + 1).cast("int")))


def exact_quantiles(rows: DataFrame, x: str, ps: list[float], method: str = "floor_n", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, p, x) for groups of any size: by the rank of rows, so that no group is collected."""
    at = Window.partitionBy(*by).orderBy(x)
    ranked = rows.where(F.col(x).isNotNull()).withColumn("_i", F.row_number().over(at) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return ranked.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).where(sum((F.when(F.col("p") == p, QUANTILES[method](F.col("_n"), p)).otherwise(0) for p in ps), F.lit(0)) == F.col("_i")).select(*by, "p", x)


def regime_labels(bars: DataFrame, vol: str, trend: str, low: Column, high: Column) -> DataFrame:
    """Volatility tercile (0 to 2) times two, plus one if the trend isn't down; NULL while either is unknown."""
    tercile = F.when(F.col(vol) <= low, 0).when(F.col(vol) <= high, 1).otherwise(2)
    return bars.withColumn("regime", F.when(F.col(vol).isNotNull() & F.col(trend).isNotNull(), tercile * 2 + F.when(F.col(trend) >= 0, 1).otherwise(0)))


def regime_stats(returns: DataFrame, per_year: float, label: str = "regime", least: int = 30) -> DataFrame:
    """By label: rows, ratio, profit, share of all positive profit, and whether it is over 80 % of that."""
    own = returns.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), sharpe(F.col("ret"), per_year).alias("sharpe"), F.sum("ret").alias("pnl"))
    gain = F.sum(F.greatest("pnl", F.lit(0.0))).over(Window.partitionBy())
    share = F.when(gain > 0, F.greatest(F.col("pnl"), F.lit(0.0)) / gain).otherwise(0.0)
    return own.withColumn("share", share).withColumn("concentrated", F.col("share") > 0.8).withColumn("counts", F.col("n") >= least)


def robust_objective(x: Column) -> Column:
    return 0.6 * F.median(x) + 0.4 * F.avg(x)


def trade_shrink(trades: Column, full: int = 30) -> Column:
    return F.least(F.lit(1.0), F.sqrt(trades / full))


def funnel(candidates: DataFrame, stages: list[str]) -> DataFrame:
    """By stage, in order: failures there, and how many reached it: all but those that failed before."""
    order = candidates.sparkSession.createDataFrame([(k, s) for k, s in enumerate(stages)], "stage_no int, stage string")
    killed = candidates.groupBy("failed_stage").agg(F.count("*").alias("killed"))
    total = candidates.agg(F.count("*").alias("total"))
    own = F.broadcast(order).join(killed, F.col("stage") == F.col("failed_stage"), "left").select("stage_no", "stage", F.coalesce("killed", F.lit(0)).alias("killed"))
    before = F.coalesce(F.sum("killed").over(Window.partitionBy().orderBy("stage_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.crossJoin(F.broadcast(total)).select("stage_no", "stage", "killed", (F.col("total") - before).alias("reached"))


def family_rollup(candidates: DataFrame) -> DataFrame:
    """By family: all, scored, best with its name, mean, deepest stage, survivors."""
    best = F.struct(F.col("composite"), F.col("name"))
    scored = F.col("composite").isNotNull()
    return candidates.groupBy("family").agg(
        F.count("*").alias("bred"), F.count_if(scored).alias("scored"), F.max("composite").alias("best"), F.max(F.when(scored, best))["name"].alias("best_name"), F.avg("composite").alias("mean"), F.max("stage_no").alias("deepest"), F.count_if(F.col("failed_stage").isNull()).alias("survivors")
    )


def progression(candidates: DataFrame, n: int = 800) -> DataFrame:
    """The last n scored candidates in order, with the best so far."""
    last = candidates.where("composite is not null").orderBy(F.desc("created"), F.desc("id")).limit(n)
    w = Window.partitionBy().orderBy("created", "id").rowsBetween(Window.unboundedPreceding, 0)
    return last.select("id", "created", "composite", F.max("composite").over(w).alias("best_so_far"))


def recipe_rollup(attempts: DataFrame, key: str) -> DataFrame:
    ok = F.col("success")
    return attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(ok).alias("successes"), F.sum("score").alias("score_sum"), F.avg("score").alias("score_mean"), ((F.count_if(ok) + 1) / (F.count("*") + 2)).alias("posterior_mean"))


def live_metrics(snapshots: DataFrame, by: tuple[str, ...] = ("id",), least: int = 48) -> DataFrame:
    """Of equity snapshots (by, ts, equity, weight): return, deepest fall, ratio from `least` returns on, time in market."""
    w = Window.partitionBy(*by).orderBy("ts")
    own = snapshots.withColumn("ret", F.col("equity") / F.lag("equity").over(w) - 1)
    own = own.withColumn("dd", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    seconds = lambda c: micros(c) / 1e6
    own = own.withColumn("span", seconds(F.lead("ts").over(w)) - seconds(F.col("ts")))
    n = F.count("ret")
    sd = F.stddev_pop("ret")
    days = (seconds(F.max("ts")) - seconds(F.min("ts"))) / 86_400
    total = F.max_by("equity", "ts") / F.min_by("equity", "ts")
    return own.groupBy(*by).agg(
        (total - 1).alias("total_return"),
        F.min("dd").alias("max_dd"),
        F.when((n >= least) & (sd > EPS), F.avg("ret") / sd * math.sqrt(365 * 24)).alias("sharpe"),
        F.when(days >= 14, F.pow(total, 365 / days) - 1).alias("cagr"),
        F.coalesce(F.sum(F.when(F.col("weight") != 0, F.col("span"))) / F.sum("span"), F.lit(0.0)).alias("time_in_market"),
    )


def daily_returns(snapshots: DataFrame, by: tuple[str, ...] = ("id",), value: str = "equity", least_days: int = 6) -> DataFrame:
    """(by, ts, ret) of the last value of each UTC day against that of the day before it that has any, where that is above 0.

    Keys with under 3 rows or `least_days` days are left out. The last of a day merges before the shuffle.
    """
    days = snapshots.groupBy(*by, F.date_trunc("day", "ts").alias("day")).agg(F.max_by(value, "ts").alias("last"), F.count("*").alias("rows"))
    all_days = Window.partitionBy(*by)
    days = days.withColumns({"n": F.count("*").over(all_days), "all_rows": F.sum("rows").over(all_days), "was": F.lag("last").over(all_days.orderBy("day"))})
    return days.where((F.col("n") >= least_days) & (F.col("all_rows") >= 3) & (F.col("was") > 0)).select(*by, F.col("day").alias("ts"), (F.col("last") / F.col("was") - 1).alias("ret"))


def worst_fall(curves: DataFrame, by: tuple[str, ...] = ("id",), value: str = "equity", least: int = 5) -> DataFrame:
    """(by, depth, peak, trough): the deepest fall of a curve below its highest value so far, and the times where it began and ended.

    Of equal falls the first, of equal peaks the first; a curve that never falls has depth 0 and no times. Curves of under
    `least` rows are left out.
    """
    so_far = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = curves.select(*by, "ts", F.col(value).alias("x"), F.max(value).over(so_far).alias("top"))
    own = own.withColumn("since", F.min("ts").over(Window.partitionBy(*by, "top").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("fall", F.col("x") / F.col("top") - 1)
    worst = own.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("fall", "ts", "since")).alias("w")).where(F.col("n") >= least)
    fell = F.col("w.fall") < 0
    return worst.select(*by, F.least(F.col("w.fall"), F.lit(0.0)).alias("depth"), F.when(fell, F.col("w.since")).alias("peak"), F.when(fell, F.col("w.ts")).alias("trough"))
