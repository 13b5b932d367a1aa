"""Portfolios of streams and panels: ranking, risk parity, combination, capacity, sleeves without own state."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import EPS
from tidemark.operators import aggregates, joins, statistics
from tidemark.operators import windows as w

#: Cost of borrowed money a year.
BORROW = 0.10


def top_k(panel: DataFrame, score: str, k: int, every: int = 1, start: int = 0, largest: bool = True, skip_zero: bool = False) -> DataFrame:
    """panel with w: equal weights of the k best scores of each rebalancing bar, held until the next.

    Bars count from `start` over the panel's times; ties go to the first symbol. Weights before `start` are 0.
    """
    times = panel.select("ts").distinct().withColumn("bar", F.row_number().over(Window.orderBy("ts")) - 1)
    own = panel.join(times, "ts")
    valid = F.col(score).isNotNull() & ~F.isnan(score) & ((F.col(score) != 0) if skip_zero else F.lit(True))
    by_score = F.desc(score) if largest else F.asc(score)
    rank = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("_valid"), by_score, "symbol"))
    own = own.withColumn("_valid", valid).withColumn("_rank", rank).withColumn("_picks", F.least(F.lit(k), F.count_if("_valid").over(Window.partitionBy("ts"))))
    pick = F.when(F.col("_valid") & (F.col("_rank") <= k), 1 / F.col("_picks")).otherwise(0.0)
    decided = F.when((F.col("bar") >= start) & ((F.col("bar") - start) % every == 0), pick)
    held = F.last("_w", ignorenulls=True).over(w.order().rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_w", decided).withColumn("w", F.coalesce(held, F.lit(0.0))).drop("_valid", "_rank", "_picks", "_w", "bar")


def panel_returns(weighted: DataFrame, cost: float, target: float = 0.4, most: float = 3.0, per_year: float = 365.0, funding: str | None = None) -> DataFrame:
    """ts, raw, ret of a panel with c and w: what the weights of the bar before earn, less costs and funding.

    ret is raw times one leverage that brings the whole run to the volatility target: the level uses the run's own
    future, the ranking doesn't.
    """
    o = w.order()
    was, before = F.coalesce(F.lag("w").over(o), F.lit(0.0)), F.coalesce(F.lag("w", 2).over(o), F.lit(0.0))
    r = F.coalesce(F.col("c") / F.lag("c").over(o) - 1, F.lit(0.0))
    fund = F.lit(0.0) if funding is None else F.col(funding)
    own = weighted.select("ts", (was * r - F.abs(was - before) * cost - was * fund).alias("x"))
    raw = own.groupBy("ts").agg(F.sum("x").alias("raw"))
    scale = raw.agg(F.stddev_pop("raw").alias("sd")).select(F.when(F.col("sd") * math.sqrt(per_year) > 1e-9, F.least(F.lit(most), target / (F.col("sd") * math.sqrt(per_year)))).otherwise(1.0).alias("lev"))
    return raw.crossJoin(F.broadcast(scale)).select("ts", "raw", F.greatest(F.lit(-0.95), F.col("raw") * F.col("lev")).alias("ret"))


def risk_parity(cov: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Weights of equal risk and each one's share of the risk. cov is as large as there are streams in a book.

    Up to scale they are the minimum of x'Cx / 2 - sum(log x), which is convex: its gradient Cx - 1 / x is 0 where all
    x * Cx are 1. Newton's steps from inverse volatilities, halved while they would leave the positive numbers or rise.
    """
    k = len(cov)
    if k < 2:
        return np.ones(k), np.ones(k)
    scale = np.sqrt(np.maximum(cov.diagonal(), 1e-12 * max(cov.diagonal().max(), 1e-18)))
    c = cov / np.outer(scale, scale) + 1e-12 * np.eye(k)  # correlations: weights come out in units of 1 / volatility
    x, value = np.ones(k), lambda x: 0.5 * x @ c @ x - np.log(x).sum()
    for _ in range(100):
        gradient = c @ x - 1 / x
        step = np.linalg.solve(c + np.diag(x**-2), gradient)
        if gradient @ step < tolerance:
            break
        size = 1.0
        while (x - size * step).min() <= 0 or value(x - size * step) > value(x):
            size /= 2
        x = x - size * step
    x = x / scale
    x /= x.sum()
    risk = x * (cov @ x)
    return x, risk / (risk.sum() or 1.0)


def book_weights(streams: DataFrame, scheme: str = "erc") -> DataFrame:
    """id, weight, risk: equal, inverse volatility or equal risk, over the times that all streams share.

    The covariances are one aggregation; a book has few streams, so that the fixed point runs on the driver. Where the
    streams share fewer than two times, equal risk has nothing to go by and weighs them equally.
    """
    shared = joins.intersection(streams, "id")
    if scheme == "erc" and shared.select("ts").distinct().limit(2).count() < 2:
        ids = streams.select("id").distinct()
        share = F.lit(1.0) / F.count("*").over(Window.partitionBy(F.lit(1)))
        return ids.select("id", share.alias("weight"), share.alias("risk"))
    cov = aggregates.covariances(shared).toPandas()
    ids = sorted({*cov["a"], *cov["b"]})
    at = {s: i for i, s in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b, c in cov.itertuples(index=False):
        m[at[a], at[b]] = m[at[b], at[a]] = c
    if scheme == "erc":
        x, risk = risk_parity(m)
    else:
        x = np.ones(len(ids)) if scheme == "equal" else 1 / np.sqrt(np.maximum(m.diagonal(), 1e-12))
        x = x / max(x.sum(), 1e-300)
        risk = x * (m @ x) / max(float(x @ m @ x), 1e-300)
    return streams.sparkSession.createDataFrame(pd.DataFrame({"id": pd.Series(ids, dtype="str"), "weight": x, "risk": risk}), "id string, weight double, risk double")


def book_returns(streams: DataFrame, weights: DataFrame) -> DataFrame:
    shared = joins.intersection(streams, "id")
    return shared.join(F.broadcast(weights.select("id", "weight")), "id").groupBy("ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def book_stats(returns: DataFrame, per_year: float) -> DataFrame:
    """One row: ratio, volatility a year, deepest fall, mean return, rows."""
    o = Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = returns.withColumn("_l", F.sum(F.log1p("ret")).over(o)).withColumn("_d", F.exp(F.col("_l") - F.greatest(F.max("_l").over(o), F.lit(0.0))) - 1)
    return own.agg(aggregates.sharpe(F.col("ret"), per_year, 1e-15).alias("sharpe"), (F.stddev_pop("ret") * math.sqrt(per_year)).alias("vol"), F.least(F.min("_d"), F.lit(0.0)).alias("max_dd"), F.avg("ret").alias("mean_ret"), F.count("*").alias("n_bars"))


def diversification_ratio(streams: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the streams' deviations over the book's deviation."""
    shared = joins.intersection(streams, "id")
    own = shared.groupBy("id").agg(F.stddev_pop("ret").alias("sd")).join(weights, "id").agg(F.sum(F.col("sd") * F.col("weight")).alias("parts"))
    book = book_returns(streams, weights).agg(F.stddev_pop("ret").alias("sd"))
    return own.crossJoin(book).select(F.when(F.col("sd") > 0, F.col("parts") / F.col("sd")).otherwise(1.0).alias("ratio"))


def marginal_ratio(streams: DataFrame, candidate: str, per_year: float, scheme: str = "equal") -> DataFrame:
    """Ratio of the book with and without a candidate, and its closest correlation to a member."""
    rest = streams.where(F.col("id") != candidate)
    out = []
    for name, own in (("with_it", streams), ("without", rest)):
        out.append(book_stats(book_returns(own, book_weights(own, scheme)), per_year).select(F.col("sharpe").alias(name)))
    near = joins.pairwise(streams, 2, True).where(F.col("a") == candidate).agg(F.max("corr").alias("max_corr"))
    return out[0].crossJoin(out[1]).crossJoin(near).withColumn("marginal", F.col("with_it") - F.col("without"))


def combined(streams: DataFrame, weights: DataFrame, leverage: float = 1.0) -> DataFrame:
    """Weighted returns times leverage, less the borrowing of exposed days."""
    own = book_returns(streams, weights)
    cost = F.when((F.abs("ret") > 1e-9) & F.lit(leverage > 1), (leverage - 1) * BORROW / 365).otherwise(0.0)
    return own.select("ts", (leverage * F.col("ret") - cost).alias("ret"))


def overlay(base: DataFrame, gate: DataFrame, leverage: float = 1.0) -> DataFrame:
    """base (ts, ret) on days on which gate (ts, w) is long too, by UTC day."""
    own = joins.on_day(base, gate.select("ts", F.col("w").alias("gate")), ["gate"])
    r = F.when(F.col("gate") > 0, F.col("ret")).otherwise(0.0)
    cost = F.when((F.abs(r) > 1e-9) & F.lit(leverage > 1), (leverage - 1) * BORROW / 365).otherwise(0.0)
    return own.select("ts", (leverage * r - cost).alias("ret"))


def capacity(run: DataFrame, sizes: list[float], per_year: float, impact: float = 0.7, vol_rows: int = 96, volume_rows: int = 720) -> DataFrame:
    """By size of the account: ratio after square-root impact, impact a year, mean share of the traded volume.

    run: symbol, ts, c, v, turnover, ret of a back-test. One aggregation over returns times sizes.
    """
    r = F.col("c") / F.lag("c").over(w.order()) - 1
    own = run.withColumn("_r", r)
    sigma, volume = w.sigma_and_volume(F.col("_r"), vol_rows)[0], w.sigma_and_volume(F.col("_r"), volume_rows)[1]
    own = own.withColumn("_sigma", sigma).withColumn("_adv", volume)
    known = (F.col("turnover") > 0) & (F.col("_sigma") > 0) & (F.col("_adv") > 0)
    own = own.withColumn("aum", F.explode(F.array(*map(F.lit, map(float, sizes)))))
    share = F.when(known, F.col("turnover") * F.col("aum") / F.col("_adv"))
    own = own.withColumn("_share", share).withColumn("_drag", F.coalesce(F.col("turnover") * impact * F.col("_sigma") * F.sqrt("_share"), F.lit(0.0)))
    net = F.col("ret") - F.col("_drag")
    return own.groupBy("symbol", "aum").agg(aggregates.sharpe(net, per_year).alias("net_sharpe"), (F.sum("_drag") / (F.count("*") / per_year)).alias("impact_annual"), F.coalesce(F.avg("_share"), F.lit(0.0)).alias("participation"))


def frontier(curve: DataFrame, free: DataFrame, share: float = 0.5, least: float = 0.5) -> DataFrame:
    """By symbol the last size before the first whose ratio is below the floor. free: symbol, sharpe without impact."""
    o = Window.partitionBy("symbol").orderBy("aum").rowsBetween(Window.unboundedPreceding, 0)
    own = curve.join(free, "symbol").withColumn("_ok", F.col("net_sharpe") >= F.greatest(F.lit(least), share * F.col("sharpe")))
    return own.withColumn("_all", F.min(F.col("_ok").cast("int")).over(o) == 1).groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("_all"), F.col("aum"))), F.lit(0.0)).alias("capacity"))


def decided_stream(daily: DataFrame, weight: Column, cost: float, funding: Column | None = None, start: int = 0) -> DataFrame:
    """w, w_held, ret of weights decided at a close for the next bar; 0 before bar `start`."""
    o = w.order()
    own = daily.withColumn("w", F.when(F.col("i") >= start, F.coalesce(weight, F.lit(0.0))).otherwise(0.0))
    held, before = F.coalesce(F.lag("w").over(o), F.lit(0.0)), F.coalesce(F.lag("w", 2).over(o), F.lit(0.0))
    r = F.coalesce(F.col("c") / F.lag("c").over(o) - 1, F.lit(0.0))
    own = own.withColumns({"w_held": held, "_dw": F.abs(held - before), "_r": r})
    return own.withColumn("ret", held * r - F.abs(held - before) * cost - held * (F.lit(0.0) if funding is None else funding)).drop("_dw", "_r")


def trend_sleeve(daily: DataFrame, n: int, cost: float = 7e-4, strict: bool = True) -> DataFrame:
    """Long above the mean of the last n closes, decided at the close; the first decision is at bar n + 1."""
    x = w.sma(F.col("c"), n)
    return decided_stream(daily, (F.col("c") > x if strict else F.col("c") >= x).cast("double"), cost, start=n + 1 if strict else n - 1)


def timing_sleeve(daily: DataFrame, feature: str, n: int, threshold: float, high: bool = True, cost: float = 7e-4) -> DataFrame:
    """Long while a feature is further than threshold deviations above (below) its past n values."""
    z = w.past_zscore(F.col(feature), max(20, n))
    return decided_stream(daily, (z > threshold if high else z < -threshold).cast("double"), cost, start=max(20, n) + 1)


def to_target(returns: DataFrame, target: float, most: float, per_year: float = 365.0, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """ret times one leverage a run that brings its volatility to the target, floored at -95 %."""
    vol = F.stddev_pop("ret").over(Window.partitionBy(*by)) * math.sqrt(per_year)
    return returns.withColumn("ret", F.greatest(F.lit(-0.95), F.col("ret") * F.when(vol > 1e-9, F.least(F.lit(most), target / vol)).otherwise(1.0)))


def daily_stats(returns: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Multiple, growth a year, deepest fall, ratio, growth over fall, share of positive days."""
    o = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = returns.withColumn("_l", F.sum(F.log1p("ret")).over(o)).withColumn("_d", F.exp(F.col("_l") - F.greatest(F.max("_l").over(o), F.lit(0.0))) - 1)
    out = own.groupBy(*by).agg(F.exp(F.sum(F.log1p("ret"))).alias("multiple"), F.count("*").alias("n"), F.least(F.min("_d"), F.lit(0.0)).alias("max_dd"), aggregates.sharpe(F.col("ret"), 365).alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_days"))
    out = out.withColumn("cagr", F.pow("multiple", 365 / F.col("n")) - 1)
    return out.withColumn("calmar", F.when(F.col("max_dd") < -EPS, F.col("cagr") / F.abs("max_dd")).otherwise(0.0))


def sleeve_walk_forward(
    daily: DataFrame, wants: dict[int, tuple[Column, int]], train_days: int, step_days: int, purge: int, cost: float = 7e-4, target: float | None = None, most: float = 1.0, least: int = 120
) -> tuple[DataFrame, DataFrame]:
    """Windows (symbol, window, config, train_sharpe, lev, n, ret), and their test rows (symbol, window, i, ts, ret), which pool into one stream.

    daily: symbol, ts, i, c. wants: by configuration the weight wanted at a close, and the first row that may have one. A
    window trains on train_days before its start but for the last `purge` rows, takes the configuration with the best ratio
    there (of equal ones the first) and trades it until the next start. Its run begins flat at its first training row; with
    a target, one leverage brings the run to that volatility. Windows with fewer than `least` rows to train on or under 7
    to trade are left out. A bar meets the windows that it is in, not all; symbols and windows are groups.
    """
    o = w.order()
    r = F.coalesce(F.col("c") / F.lag("c").over(o) - 1, F.lit(0.0))
    wide = daily.select("symbol", "ts", "i", r.alias("r"), *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"want{k}") for k, (x, _) in wants.items()])
    wide = wide.select("symbol", "ts", "i", "r", *[F.struct(F.lit(k).alias("config"), F.lit(warm).alias("warm"), F.lag(f"want{k}").over(o).alias("one"), F.lag(f"want{k}", 2).over(o).alias("two")).alias(f"run{k}") for k, (_, warm) in wants.items()])
    days = lambda n: F.expr(f"interval {n} days")
    span = daily.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).where(F.col("last") >= F.col("first") + days(train_days))
    starts = span.select("symbol", F.posexplode(F.sequence(F.col("first") + days(train_days), F.col("last"), days(step_days))).alias("window", "test_start"))
    starts = starts.select("symbol", "window", "test_start", (F.col("test_start") - days(train_days)).alias("from"), (F.col("test_start") + days(step_days)).alias("to"))
    inside = wide.join(starts, "symbol").where((F.col("ts") >= F.col("from")) & (F.col("ts") < F.col("to")))
    bounds = inside.groupBy("symbol", "window").agg(F.min("i").alias("a"), F.min(F.when(F.col("ts") >= F.col("test_start"), F.col("i"))).alias("s"), F.max("i").alias("e"))
    bounds = bounds.where((F.col("e") > F.col("s") + 5) & (F.col("s") - 1 - purge - F.col("a") >= least))
    runs = inside.join(bounds, ["symbol", "window"]).select("symbol", "window", "ts", "i", "r", "a", "s", "e", F.explode(F.array(*[f"run{k}" for k in wants])).alias("run"))
    start = F.greatest(F.col("run.warm"), F.col("a"))
    held, before = F.when(F.col("i") - 1 >= start, F.col("run.one")).otherwise(0.0), F.when(F.col("i") - 2 >= start, F.col("run.two")).otherwise(0.0)
    runs = runs.select("symbol", "window", "ts", "i", "a", "s", "e", "run.config", (F.col("i") > start).alias("live"), F.when(F.col("i") > start, held * F.col("r") - F.abs(held - before) * cost).otherwise(0.0).alias("out"))
    train = (F.col("i") > F.col("a")) & (F.col("i") <= F.col("s") - 1 - purge)
    vol = F.coalesce(F.stddev_pop(F.when(F.col("live"), F.col("out"))), F.lit(0.0)) * math.sqrt(365)
    lev = F.lit(1.0) if target is None else F.when(vol > 1e-9, F.least(F.lit(most), target / vol)).otherwise(1.0)
    judged = runs.groupBy("symbol", "window", "config").agg(aggregates.sharpe(F.when(train, F.col("out")), 365).alias("train_sharpe"), lev.alias("lev"))
    best = F.row_number().over(Window.partitionBy("symbol", "window").orderBy(F.desc("train_sharpe"), "config"))
    chosen = judged.withColumn("_r", best).where("_r = 1").drop("_r")
    tested = runs.where(F.col("i") >= F.col("s")).join(chosen, ["symbol", "window", "config"])
    scaled = F.col("out") if target is None else F.greatest(F.lit(-0.95), F.col("out") * F.col("lev"))
    tested = tested.select("symbol", "window", "config", "train_sharpe", "lev", "i", "ts", scaled.alias("ret"))
    windows = tested.groupBy("symbol", "window", "config", "train_sharpe", "lev").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"))
    return windows, tested.select("symbol", "window", "i", "ts", "ret")


def pooled_stats(stream: DataFrame, month: int = 30) -> DataFrame:
    """By symbol of a pooled stream (symbol, i, ret): ratio, deepest fall, share of months of `month` rows that gain, worst month."""
    o = Window.partitionBy("symbol").orderBy("i")
    own = stream.withColumn("_k", F.row_number().over(o) - 1).withColumn("_l", F.sum(F.log1p("ret")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("_d", F.exp(F.col("_l") - F.greatest(F.max("_l").over(o.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))) - 1)
    months = own.groupBy("symbol", F.floor(F.col("_k") / month).alias("_m")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("g"))
    months = months.groupBy("symbol").agg(F.avg((F.col("g") > 0).cast("double")).alias("positive_months"), F.least(F.min("g"), F.lit(0.0)).alias("worst_month"))
    return own.groupBy("symbol").agg(aggregates.sharpe(F.col("ret"), 365).alias("sharpe"), F.least(F.min("_d"), F.lit(0.0)).alias("max_dd"), F.count("*").alias("n")).join(months, "symbol")


def significant(streams: DataFrame, per_year: float, reps: int = 1000, least_low: float = 0.0, least_p5: float = 0.0) -> DataFrame:
    """Gate A by stream (id): whether the bootstrap's interval of the ratio lies above the floor, and its 5 % point too."""
    found = statistics.bootstrap_interval(statistics.block_bootstrap(streams, per_year, reps, by=("id",)), ("id",))
    alone = streams.groupBy("id").agg(aggregates.sharpe(F.col("ret"), per_year).alias("sharpe"))
    out = alone.join(found.select("id", "lo", "p5"), "id", "left")
    return out.withColumn("passes", F.coalesce((F.col("lo") > least_low) & (F.col("p5") >= least_p5), F.lit(False)))


def admitted(marginal: DataFrame, least: float = 0.05, most: float = 0.6) -> DataFrame:
    """Gate B of marginal_ratio()'s row: no near-duplicate of a member, and a lift of the book."""
    near, lift = F.coalesce(F.col("max_corr"), F.lit(0.0)) >= most, F.col("marginal") >= least
    return marginal.withColumn("admits", ~near & lift).withColumn("reason", F.when(near, "near-duplicate").when(lift, "lifts the book").otherwise("not accretive"))


def book_gate(streams: DataFrame, per_year: float, reps: int = 1000, least_sharpe: float = 1.0, least_p5: float = 1.0, most_corr: float = 0.5, scheme: str = "erc") -> DataFrame:
    """Gate C, one row: the book's members, ratio, its bootstrap's 5 % point, diversification ratio, mean correlation within, whether all pass, and what doesn't."""
    weights = book_weights(streams, scheme)
    book = book_returns(streams, weights).withColumn("id", F.lit("book"))
    stats = book.agg(aggregates.sharpe(F.col("ret"), per_year, 1e-15).alias("sharpe"))
    low = statistics.bootstrap_interval(statistics.block_bootstrap(book, per_year, reps, by=("id",)), ("id",)).agg(F.coalesce(F.max("p5"), F.lit(-9.0)).alias("p5"))
    corr = aggregates.mean_abs_correlation(joins.intersection(streams, "id")).select(F.coalesce(F.max("mean_abs_corr"), F.lit(0.0)).alias("mean_abs_corr"))
    spread = diversification_ratio(streams, weights).agg(F.coalesce(F.max("ratio"), F.lit(1.0)).alias("diversification"))
    out = stats.crossJoin(low).crossJoin(corr).crossJoin(spread).crossJoin(weights.agg(F.count("*").alias("members")))
    checks = {"sharpe": F.col("sharpe") >= least_sharpe, "p5": F.col("p5") >= least_p5, "mean_abs_corr": F.col("mean_abs_corr") <= most_corr}
    reasons = F.array_join(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]), lambda x: x.isNotNull()), "; ")
    return out.withColumn("reasons", reasons).withColumn("passes", F.col("reasons") == "")


def panel_walk_forward(
    panel: DataFrame, score: str, trials: list[tuple[int, int]], warm: int, purge: int, train_days: int = 360, step_days: int = 30, cost: float = 13e-4, target: float = 0.4, most: float = 3.0, least: int = 146
) -> tuple[DataFrame, DataFrame]:
    """Windows (window, config, train_sharpe, lev, n, ret) of a ranked panel, and their test rows (window, i, ts, ret), which pool into one stream.

    panel: symbol, ts, c and a score known at the close; i counts its times. trials: by configuration how many of the best
    scores are held, and for how many times. A run begins flat at its window's first time, at `warm` at the earliest, and
    rebalances from there on. The configuration with the best ratio over the training times but for the last `purge` trades
    until the next window; one leverage brings its run to the target volatility. Windows with fewer than `least` times to
    train on or 9 or fewer to trade are left out. Ranks don't depend on windows and trials, so that they are made once; runs
    are groups of (window, config, symbol). A symbol without a row at a rebalancing time keeps its weight: align panels first.
    """
    o = w.order()
    valid = F.col(score).isNotNull() & ~F.isnan(score)
    times = panel.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)  # one row a time of the calendar
    own = panel.select("symbol", "ts", F.coalesce(F.col("c") / F.lag("c").over(o) - 1, F.lit(0.0)).alias("r"), F.when(valid, F.col(score)).alias("x"))
    rank = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc_nulls_last("x"), "symbol"))
    own = own.withColumns({"rank": F.when(F.col("x").isNotNull(), rank), "valid": F.count("x").over(Window.partitionBy("ts"))}).join(times, "ts")
    days = lambda n: F.expr(f"interval {n} days")
    span = times.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).where(F.col("first") + days(train_days + step_days) <= F.col("last"))
    starts = span.select(F.posexplode(F.sequence(F.col("first") + days(train_days), F.col("last") - days(step_days), days(step_days))).alias("window", "t"))
    near = times.join(F.broadcast(starts), (F.col("ts") >= F.col("t") - days(train_days)) & (F.col("ts") < F.col("t") + days(step_days)))
    bounds = near.groupBy("window").agg(F.min("i").alias("a"), F.min(F.when(F.col("ts") >= F.col("t"), F.col("i"))).alias("s"), F.max("i").alias("e"))
    bounds = bounds.where((F.col("e") > F.col("s") + 8) & (F.col("s") - 1 - purge - F.col("a") >= least)).withColumn("start", F.greatest(F.lit(warm), "a"))
    grid = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(k).alias("k"), F.lit(every).alias("every")) for c, (k, every) in enumerate(trials)])
    runs = own.join(F.broadcast(bounds), F.col("i").between(F.col("a"), F.col("e"))).withColumn("trial", F.explode(grid)).select("*", "trial.*")
    pick = F.when(F.col("rank") <= F.col("k"), 1 / F.least("k", "valid")).otherwise(0.0)
    decided = F.when((F.col("i") >= F.col("start")) & ((F.col("i") - F.col("start")) % F.col("every") == 0), pick)
    path = Window.partitionBy("window", "config", "symbol").orderBy("i")
    runs = runs.withColumn("d", decided).withColumn("w", F.coalesce(F.last("d", ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    held, before = F.coalesce(F.lag("w").over(path), F.lit(0.0)), F.coalesce(F.lag("w", 2).over(path), F.lit(0.0))
    runs = runs.select("window", "config", "i", "ts", "a", "s", "start", F.when(F.col("i") > F.col("start"), held * F.col("r") - F.abs(held - before) * cost).otherwise(0.0).alias("x"))
    book = runs.groupBy("window", "config", "i", "ts", "a", "s", "start").agg(F.sum("x").alias("raw"))
    train = (F.col("i") > F.col("a")) & (F.col("i") <= F.col("s") - 1 - purge)
    vol = F.coalesce(F.stddev_pop(F.when(F.col("i") > F.col("start"), F.col("raw"))), F.lit(0.0)) * math.sqrt(365)
    judged = book.groupBy("window", "config").agg(aggregates.sharpe(F.when(train, F.col("raw")), 365).alias("train_sharpe"), F.when(vol > 1e-9, F.least(F.lit(most), target / vol)).otherwise(1.0).alias("lev"))
    best = F.row_number().over(Window.partitionBy("window").orderBy(F.desc(F.round("train_sharpe", 12)), "config"))
    chosen = judged.withColumn("_r", best).where("_r = 1").drop("_r")
    tested = book.where(F.col("i") >= F.col("s")).join(chosen, ["window", "config"]).select("window", "config", "train_sharpe", "lev", "i", "ts", F.greatest(F.lit(-0.95), F.col("raw") * F.col("lev")).alias("ret"))
    windows = tested.groupBy("window", "config", "train_sharpe", "lev").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"))
    return windows, tested.select("window", "i", "ts", "ret")
