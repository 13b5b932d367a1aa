"""Resampling and validation: bootstraps, shuffles, overfitting, walk-forward and search as data.

Replicates are rows, so that they spread over tasks: what a replicate draws is a function of its number (see
functions.maths.uniform), never of which task runs first.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import logit, uniform, uniforms
from tidemark.operators import aggregates
from tidemark.operators import windows as w


def numbered(returns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """returns with k, from 0 in the order of ts, and n, their number."""
    return returns.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("ts")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def block_bootstrap(returns: DataFrame, per_year: float, reps: int = 1000, block: int = 24, seed: int = 42, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, rep, sharpe) of circular blocks of a stream's returns, drawn until n rows are there; none for under 3 blocks.

    Draw `rep * blocks + block number` starts a block. Joined by place in the stream, summed by replicate.
    """
    own = numbered(returns.select(*by, "ts", "ret"), by)
    sizes = own.groupBy(*by).agg(F.first("n").alias("n")).where(F.col("n") >= 3 * block)
    blocks = F.ceil(F.col("n") / block)
    drawn = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    drawn = drawn.withColumn("start", F.floor(uniform(F.lit(seed), F.col("rep") * blocks + F.col("b")) * F.col("n")))
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("b") * block + F.col("j") < F.col("n"))
    placed = drawn.select(*by, "rep", ((F.col("start") + F.col("j")) % F.col("n")).cast("int").alias("k"))
    # draws are made of few rows, so that their size looks like one to broadcast
    return placed.hint("merge").join(own.select(*by, "k", "ret"), [*by, "k"]).groupBy(*by, "rep").agg(aggregates.sharpe(F.col("ret"), per_year).alias("sharpe"))


def bootstrap_interval(sharpes: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    q = lambda p: aggregates.quantile(F.col("sharpe"), p)
    return sharpes.groupBy(*by).agg(q(0.025).alias("lo"), q(0.975).alias("hi"), q(0.05).alias("p5"), q(0.5).alias("median"))


#: Replicates of a task, and numbers that it holds at once.
REPLICATES, HELD = 250, 1 << 21


def _resampled(returns: DataFrame, reps: int, by: tuple[str, ...], statistic, names: tuple[str, ...]) -> DataFrame:
    """(by, rep, names): statistic(ret, reps), arrays of figures by replicate.

    A stream's rows go to a task for every `REPLICATES` of them, not for each.
    """
    parts = -(-reps // REPLICATES)
    rows = returns.select(*by, "ts", "ret").where(F.col("ret").isNotNull()).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ret = pdf.sort_values("ts")["ret"].to_numpy(dtype=np.float64)
        own = np.arange(key[-1] * REPLICATES, min(reps, (key[-1] + 1) * REPLICATES))
        step = max(1, HELD // max(1, len(ret)))
        found = [statistic(ret, own[at : at + step]) for at in range(0, len(own), step)]
        figures = {n: np.concatenate([f[k] for f in found]) for k, n in enumerate(names)}
        return pd.DataFrame({**{b: [v] * len(own) for b, v in zip(by, key, strict=False)}, "rep": own.astype("int32"), **figures})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in returns.select(*by).schema.fields]
    return rows.groupBy(*by, "_part").applyInPandas(run, ", ".join([*kinds, "rep int", *[f"{n} double" for n in names]]))


def path_stats(ret: np.ndarray, per_year: float) -> tuple[np.ndarray, ...]:
    """Final multiple, deepest fall, ratio, growth over fall of each row of returns."""
    ret = np.atleast_2d(ret)
    eq = np.cumprod(1 + ret, axis=1)
    fall = np.minimum(0.0, (eq / np.maximum(np.maximum.accumulate(eq, axis=1), 1.0) - 1).min(axis=1))
    sd, last = ret.std(axis=1), eq[:, -1]
    growth = np.where(last > 0, np.maximum(last, 1e-300) ** (1 / max(0.01, ret.shape[1] / per_year)) - 1, -1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return last, fall, np.where(sd > 1e-12, ret.mean(axis=1) / sd * math.sqrt(per_year), 0.0), np.where(fall < 0, growth / -fall, 0.0)


def stationary_places(n: int, mean: float, reps: np.ndarray, seed: int) -> np.ndarray:
    """Places of circular resamples in blocks of geometric lengths, a row for each replicate.

    Of place i of replicate r, draw 2 (r n + i) says whether a block begins there and the next one where.
    """
    draws = 2 * (reps[:, None].astype(np.int64) * n + np.arange(n))
    jumps = uniforms(seed, draws) < 1 / max(1.0001, mean)
    jumps[:, 0] = True
    last = np.maximum.accumulate(np.where(jumps, np.arange(n), 0), axis=1)
    starts = np.floor(uniforms(seed, draws + 1) * n).astype(np.int64)
    return (np.take_along_axis(starts, last, axis=1) + np.arange(n) - last) % n


def monte_carlo(returns: DataFrame, per_year: float, reps: int = 5000, mean_block: float = 15, seed: int = 12345, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, rep, multiple, max_dd, sharpe, calmar) of stationary resamples."""
    some = lambda ret, own: path_stats(ret[stationary_places(len(ret), mean_block, own, seed)], per_year)
    return _resampled(returns, reps, by, some, ("multiple", "max_dd", "sharpe", "calmar"))


def monte_carlo_summary(runs: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    q = lambda c, p: aggregates.quantile(F.col(c), p, "round_n1").alias(f"{c}_p{round(100 * p)}")
    return runs.groupBy(*by).agg(*[q(c, p) for c in ("multiple", "max_dd", "sharpe", "calmar") for p in (0.05, 0.5, 0.95)], F.avg((F.col("multiple") < 1).cast("double")).alias("p_loss"))


def shuffled_falls(returns: DataFrame, reps: int = 500, seed: int = 7, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """By stream the share of shuffles whose deepest fall isn't above the observed one. A shuffle sorts the returns by its draws."""

    def some(ret: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(uniforms(seed, own[:, None].astype(np.int64) * len(ret) + np.arange(len(ret))), axis=1, kind="stable")
        return path_stats(ret[order], 365.0)[1], np.repeat(path_stats(ret, 365.0)[1], len(own))

    runs = _resampled(returns, reps, by, some, ("max_dd", "observed"))
    return runs.groupBy(*by).agg(F.avg((F.col("max_dd") <= F.col("observed") + 1e-12).cast("double")).alias("share"))


def permuted_markets(bars: DataFrame, reps: int, seed: int = 1337, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with perm: markets whose log returns are shuffled, each bar keeping its shape relative to its close.

    Volumes and times stay in place; the first bar too. A bar's place in a permutation is the rank of its draw, so that a
    replicate is one more key and nothing needs a whole market at once.
    """
    o = Window.partitionBy(*by).orderBy("ts")
    own = bars.select(*by, "ts", *"ohlc").withColumn("k", F.row_number().over(o) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    own = own.withColumns({"lr": F.ln(F.col("c") / F.lag("c").over(o)), **{f"r{x}": F.col(x) / F.col("c") for x in "ohl"}})
    many = own.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draw = uniform(F.lit(seed), F.col("perm") * (F.col("n") - 1) + F.col("k") - 1)
    placed = many.withColumn("_u", draw).withColumn("_at", F.row_number().over(Window.partitionBy(*by, "perm").orderBy(F.col("k") > 0, "_u", "k")) - 1)
    path = Window.partitionBy(*by, "perm").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    price = F.first(F.when(F.col("_at") == 0, F.col("c"))).over(path) * F.exp(F.coalesce(F.sum("lr").over(path), F.lit(0.0)))
    shaped = placed.withColumn("_c", price).select(*by, "perm", "_at", F.col("_c").alias("c"), *[(F.col("_c") * F.col(f"r{x}")).alias(x) for x in "ohl"])
    kept = bars.drop(*"ohlc").withColumn("_at", F.row_number().over(o) - 1)
    return shaped.hint("merge").join(kept, [*by, "_at"]).select(*bars.columns, "perm")


def permutation_p(sharpes: DataFrame, observed: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(better + 1) / (n + 1) of permuted ratios (by, perm, sharpe) against observed ones (by, observed).

    Equal ratios count as better: accounts lost on the first bar held have the same returns in another order, whose sums
    differ in the last digit by how Spark merges them.
    """
    own = sharpes.join(observed, list(by))
    return own.groupBy(*by).agg(((F.count_if(F.col("sharpe") >= F.col("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def _observed(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, k, ret) of streams (id, ts, ret) of five returns or more, and their (id, n, mean, sd, stat, kept)."""
    own = streams.groupBy("id", "ts").agg(F.first("ret", ignorenulls=True).alias("ret")).where(F.col("ret").isNotNull())
    own = numbered(own, ("id",)).where(F.col("n") >= 5).select("id", "n", "k", "ret")
    stats = own.groupBy("id").agg(F.first("n").alias("n"), F.avg("ret").alias("mean"), F.greatest(F.stddev_pop("ret"), F.lit(1e-9)).alias("sd"))
    hopeless = -F.col("sd") / F.sqrt("n") * F.sqrt(2 * F.ln(F.greatest(F.lit(3.0), F.ln(F.greatest(F.lit(3), F.col("n"))))))
    return own, stats.withColumns({"stat": F.sqrt("n") * F.col("mean") / F.col("sd"), "kept": F.col("mean") >= hopeless})


def null_maxima(own: DataFrame, stats: DataFrame, reps: int, mean_block: float, seed: int) -> DataFrame:
    """(rep, plain, spa): the greatest recentred ratio of all streams in each stationary resample, and that of those not hopeless.

    Streams of one length are resampled alike, so that what they share stays. Draws are rows (length, rep, place, how often),
    joined by place with the returns.
    """

    def draw(batches):
        for pdf in batches:
            for n, rep in pdf.itertuples(index=False):
                k, m = np.unique(stationary_places(n, max(2.0, mean_block), np.array([rep]), seed), return_counts=True)
                yield pd.DataFrame({"n": n, "rep": rep, "k": k, "m": m})

    numbers = F.broadcast(own.select(F.col("n").cast("long").alias("n")).distinct()).crossJoin(own.sparkSession.range(reps).select(F.col("id").alias("rep")))
    drawn = numbers.select("n", "rep").mapInPandas(draw, "n long, rep long, k int, m long")
    x = F.col("ret")
    again = drawn.hint("merge").join(own, ["n", "k"]).groupBy("rep", "id").agg((F.sum(F.col("m") * x) / F.sum("m")).alias("b"), (F.sum(F.col("m") * x * x) / F.sum("m")).alias("q"))
    again = again.join(stats, "id")
    spread = F.sqrt(F.greatest(F.lit(1e-18), F.col("q") - F.col("b") * F.col("b")))
    v = F.sqrt("n") * (F.col("b") - F.col("mean")) / spread
    return again.groupBy("rep").agg(F.max(v).alias("plain"), F.max(F.when(F.col("kept"), v)).alias("spa"))


def reality_check(streams: DataFrame, reps: int = 1000, mean_block: float = 20, seed: int = 9176) -> DataFrame:
    """One row: the stream of the greatest ratio, and the chance that the best of all is as good by luck, plain and without hopeless ones (SPA).

    Streams of under five returns don't count; without any, id is NULL and both are 1.
    """
    own, stats = _observed(streams)
    best = stats.agg(F.max_by("id", F.struct("stat", "id")).alias("best"), F.max("stat").alias("best_stat"))
    maxima = null_maxima(own, stats, reps, mean_block, seed).crossJoin(F.broadcast(best.select("best_stat")))
    share = lambda c: F.coalesce((F.count_if(F.col(c) >= F.col("best_stat")) + 1) / (F.lit(reps) + 1), F.lit(1.0))
    counted = maxima.agg(F.count("*").alias("runs"), share("plain").alias("p_reality"), share("spa").alias("p_spa"))
    p = lambda c: F.when(F.col("runs") > 0, F.col(c)).otherwise(1.0).alias(c)
    return best.crossJoin(counted).select("best", p("p_reality"), p("p_spa"))


def family_wise(streams: DataFrame, reps: int = 600, mean_block: float = 20, seed: int = 9176 ^ 0x5BD1E995) -> DataFrame:
    """(id, stat, p) of every stream: the chance that the best of all resampled streams reaches its ratio; 1 for under five returns.

    The replicates' maxima, one number each, are sent to every task: as many as there are replicates, whatever the streams.
    """
    own, stats = _observed(streams)
    maxima = null_maxima(own, stats, reps, mean_block, seed).agg(F.collect_list("plain").alias("maxima"))
    judged = stats.crossJoin(F.broadcast(maxima)).select("id", "stat", ((F.size(F.filter("maxima", lambda m: m >= F.col("stat"))) + 1) / (F.size("maxima") + 1)).alias("p"))
    return streams.select("id").distinct().join(judged, "id", "left").select("id", "stat", F.coalesce("p", F.lit(1.0)).alias("p"))


def block_ratios(returns: DataFrame, blocks: int, per_year: float, by: tuple[str, ...] = ("config",)) -> DataFrame:
    """(by, block, value): ratio of each contiguous block; the last takes the remainder. Under `blocks` rows, each is a block."""
    own = numbered(returns, by)
    block = F.least(F.floor(F.col("k") / F.greatest(F.floor(F.col("n") / blocks), F.lit(1))), F.lit(blocks - 1)).cast("int")
    return own.groupBy(*by, block.alias("block")).agg(aggregates.sharpe(F.col("ret"), per_year).alias("value"))


def overfitting(matrix: DataFrame, spark: SparkSession, most: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """By group the share of splits of blocks into halves whose best configuration is in the lower half outside.

    matrix: by, config, block (from 0), value. An odd last block is left out; over `most` splits every so many are taken.
    Groups may differ in their number of blocks; those with fewer than two have no splits, and NULL.
    """
    sizes = matrix.groupBy(*by).agg((F.max("block") + 1).alias("n")).select(*by, (F.col("n") - F.col("n") % 2).alias("n"))
    rows = []
    for n in sorted(r["n"] for r in sizes.where("n > 0").select("n").distinct().collect()):
        splits = list(combinations(range(n), n // 2))
        rows += [(n, i, list(own)) for i, own in enumerate(splits[:: -(-len(splits) // most)])]
    splits = F.broadcast(spark.createDataFrame(rows, "n int, split int, inside array<int>"))
    sized = matrix.join(sizes, list(by)) if by else matrix.crossJoin(sizes)
    own = sized.where(F.col("block") < F.col("n")).join(splits, "n").withColumn("is_in", F.array_contains("inside", F.col("block")))
    means = own.groupBy(*by, "split", "config").agg(F.avg(F.when(F.col("is_in"), F.col("value"))).alias("ins"), F.avg(F.when(~F.col("is_in"), F.col("value"))).alias("oos"))
    best = means.groupBy(*by, "split").agg(F.max_by("oos", F.struct("ins", -F.col("config"))).alias("chosen"))
    ranked = means.join(best, [*by, "split"]).groupBy(*by, "split").agg(F.count_if(F.col("oos") > F.col("chosen")).alias("better"), F.count_if(F.col("oos") == F.col("chosen")).alias("equal"), F.count("*").alias("configs"))
    omega = 1 - (F.col("better") + (F.col("equal") - 1) / 2) / (F.col("configs") - 1)
    out = ranked.withColumn("lam", logit(omega)).groupBy(*by).agg(F.avg((F.col("lam") <= 0).cast("double")).alias("pbo"), F.count("*").alias("splits"), aggregates.quantile(F.col("lam"), 0.5, "upper_median").alias("median_logit"))
    return sizes.select(*by).join(out, list(by), "left").fillna(0, ["splits"]) if by else out


def purged(train: DataFrame, start: int, end: int, window: int, embargo: int, i: str = "i") -> DataFrame:
    """Training rows whose windows don't touch the test rows start .. end, and that don't follow these too soon."""
    return train.where((F.col(i) < start - window) | (F.col(i) > end + embargo))


def suggested_embargo(rows: int, lookback: int) -> int:
    return max(lookback, math.ceil(0.01 * rows))


def calendar(spark: SparkSession, first: str, last: str, train_days: int, step_days: int) -> DataFrame:
    """window, train_start, test_start, test_end of a walk-forward, as rows."""
    days = lambda n: F.expr(f"interval {n} days")
    begin = F.lit(first).cast("timestamp_ntz") + days(train_days)
    starts = spark.range(1).select(F.explode(F.sequence(begin, F.lit(last).cast("timestamp_ntz") - days(step_days), days(step_days))).alias("test_start"))
    return starts.select((F.row_number().over(Window.orderBy("test_start")) - 1).alias("window"), (F.col("test_start") - days(train_days)).alias("train_start"), "test_start", (F.col("test_start") + days(step_days)).alias("test_end"))


def walk_forward(runs: DataFrame, windows: DataFrame, per_year: float, embargo_days: int = 0, by: tuple[str, ...] = ("symbol",), config: str = "config") -> DataFrame:
    """(by, window, config, train_sharpe, n, sharpe, ret): in each window the configuration that did best before it.

    runs: by, config, ts, ret of every configuration. Both sides of a window come from one join with the calendar, which
    is as long as the history is, not as wide as the data; ties go to the first configuration.
    """
    own = runs.join(F.broadcast(windows), (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("test_end")))
    ahead = F.col("ts") >= F.col("test_start")
    train = F.col("ts") < F.col("test_start") - F.expr(f"interval {embargo_days} days")
    r = F.col("ret")
    out = own.groupBy(*by, "window", config).agg(
        aggregates.sharpe(F.when(train, r), per_year).alias("train_sharpe"), aggregates.sharpe(F.when(ahead, r), per_year).alias("sharpe"), F.count_if(ahead).alias("n"), (F.exp(F.sum(F.when(ahead, F.log1p(r)).otherwise(0.0))) - 1).alias("ret")
    )
    best = F.row_number().over(Window.partitionBy(*by, "window").orderBy(F.desc("train_sharpe"), config))
    return out.withColumn("_r", best).where("_r = 1").drop("_r")


def random_params(spark: SparkSession, specs: dict[str, dict], trials: int, seed: int) -> DataFrame:
    """Trials as rows: number 0 has the defaults, the others uniform draws within the bounds."""
    out = spark.range(trials).select(F.col("id").cast("int").alias("trial"))
    for j, (name, s) in enumerate(sorted(specs.items())):
        x = s["min"] + uniform(F.lit(seed), F.col("trial") * len(specs) + j) * (s["max"] - s["min"])
        x = F.round(x) if s.get("int") else x
        out = out.withColumn(name, F.when(F.col("trial") == 0, F.lit(float(s["default"]))).otherwise(x))
    return out


def trial_budget(base: int, params: int) -> int:
    return min(200, base + 30 * params)


def stress(run: DataFrame, ramps: tuple[int, ...] = (1, 2, 3, 5), cost: float = 13e-4, per_year: float = 365.0) -> DataFrame:
    """By symbol and multiple of the trading costs: ratio and final multiple. run: symbol, w_held, turnover, ret."""
    own = run.withColumn("ramp", F.explode(F.array(*map(F.lit, ramps))))
    r = F.greatest(F.lit(-0.95), F.col("ret") - F.col("turnover") * cost * (F.col("ramp") - 1))
    return own.groupBy("symbol", "ramp").agg(aggregates.sharpe(r, per_year).alias("sharpe"), F.exp(F.sum(F.log1p(r))).alias("multiple"))


def equity_curve(returns: DataFrame, most: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """At most `most` points of each equity path and its last."""
    own = numbered(returns.withColumn("eq", w.equity(F.col("ret"))), by)
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return own.where((F.col("k") % step == 0) | (F.col("k") == F.col("n") - 1)).select(*by, "ts", "eq")


def perturbed(base: Column, share: float, draw: Column, seed: int) -> Column:
    return base * (1 + share * (2 * uniform(F.lit(seed), draw) - 1))
