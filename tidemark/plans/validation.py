"""Staged validation of candidates, and search over parameters.

Candidates are rows: a stage computes figures for those that still stand, from their runs, and drops those below its
floors. Stages go from cheap to dear, each over a semi-join with the survivors, so that dear ones see few.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates
from tidemark.plans import backtest

# The floors of each stage.
FLOORS = {
    "train_sharpe": 0.8, "train_trades_per_year": 30.0, "train_max_dd": -0.35, "wf_sharpe": 0.2, "wf_positive": 0.40, "wf_worst": -0.22, "wf_max_dd": -0.35, "symbols_positive": 3.0, "port_sharpe": 0.7, "port_positive": 0.55, "port_worst": -0.12,
    "dsr": 0.95, "permutation_p": 0.05, "bootstrap_lo": 0.0, "stress_share": 0.5, "crisis_max_dd": -0.40, "pbo": 0.5, "sealed_sharpe": 0.5, "sealed_max_dd": -0.30, "sealed_trades": 10.0,
}
#: How trade-count floors shrink with the bar length, and bars a year.
SCALE, PER_YEAR = {"1h": 1.0, "4h": 0.6, "1d": 0.35}, {"1h": 8760, "4h": 2190, "1d": 365}
#: Figures for which more is worse.
AT_MOST = {"permutation_p", "pbo"}


@dataclass
class Stage:
    """A name, the figures that must pass, and how to compute them for candidates that still stand."""

    name: str
    figures: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]
    floors: dict[str, float] = field(default_factory=dict)

    def verdict(self) -> Column:
        """The first figure below its floor, NULL if none; a figure that isn't known fails."""
        out = F.lit(None).cast("string")
        for f in reversed(self.figures):
            floor = self.floors.get(f, FLOORS[f])
            ok = F.col(f) <= floor if f in AT_MOST else F.col(f) >= floor
            out = F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{f} "), F.coalesce(F.format_string("%.2f", F.col(f)), F.lit("unknown")), F.lit(f" against {floor:g}"))).otherwise(out)
        return out


def gauntlet(candidates: DataFrame, stages: list[Stage], key: str = "candidate") -> DataFrame:
    """(key, failed_stage, reason, figures of the stages reached) of every candidate; failed_stage is NULL for survivors."""
    standing, out = candidates.select(key), candidates.select(key)
    failed, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in stages:
        judged = s.compute(standing).join(standing, key, "right").withColumn(f"_{s.name}", s.verdict())
        out = out.join(judged.select(key, *s.figures, f"_{s.name}", F.lit(True).alias(f"_in_{s.name}")), key, "left")
        standing = judged.where(F.col(f"_{s.name}").isNull()).select(key)
    for s in reversed(stages):
        hit = F.col(f"_in_{s.name}") & F.col(f"_{s.name}").isNotNull()
        failed, reason = F.when(hit, F.lit(s.name)).otherwise(failed), F.when(hit, F.col(f"_{s.name}")).otherwise(reason)
    return out.select(key, failed.alias("failed_stage"), reason.alias("reason"), *[f for s in stages for f in s.figures])


def replay(signals: DataFrame, windows: DataFrame, cost: float, runway: int = 1000, least: int = 48) -> DataFrame:
    """Runs of long entries and exits that begin flat `runway` rows before each window (window, start, end): symbol, window, ts, dir, turnover, ret, live.

    live: within the window. Conditions are those of the whole history, so that their averages are warm; windows with at most
    `least` rows of a symbol are left out. windows is a table of a few rows, which a bar meets by its time.
    """
    windows = F.broadcast(windows)
    hit = signals.select("symbol", "ts", "i").join(windows, (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    bounds = hit.groupBy("symbol", "window").agg(F.min("i").alias("_a"), F.max("i").alias("_b")).where(F.col("_b") - F.col("_a") >= least)
    own = signals.join(F.broadcast(bounds), "symbol").where(F.col("i").between(F.greatest(F.lit(1), F.col("_a") - runway), F.col("_b")))
    by = ("symbol", "window")
    run = backtest.returns(backtest.long_flat(own, by), cost, by=by)
    return run.select(*by, "ts", "dir", "turnover", "ret", (F.col("i") >= F.col("_a")).alias("live"))


def crisis(runs: DataFrame, floor: float = FLOORS["crisis_max_dd"]) -> DataFrame:
    """By symbol and window of replay(): return, deepest fall below the start or a later top, and whether it stays above the floor."""
    o = Window.partitionBy("symbol", "window").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = runs.where("live").withColumn("_l", F.sum(F.log1p("ret")).over(o))
    own = own.withColumn("_d", F.exp(F.col("_l") - F.greatest(F.lit(0.0), F.max("_l").over(o))) - 1)
    out = own.groupBy("symbol", "window").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"), F.least(F.min("_d"), F.lit(0.0)).alias("max_dd"))
    return out.withColumn("survives", F.col("max_dd") > floor)


def sealed(runs: DataFrame, per_year: float, least_trades: float = FLOORS["sealed_trades"], least_sharpe: float = FLOORS["sealed_sharpe"], worst: float = FLOORS["sealed_max_dd"]) -> DataFrame:
    """Trades, ratio, return and deepest fall of the equal-weight portfolio of replay()'s live rows after the seal, and the reason if it fails.

    A time counts by all symbols that have sealed rows, also those without a bar at it. One row, also where nothing is sealed.
    """
    o = Window.partitionBy("symbol", "window").orderBy("ts")
    entered = (F.col("dir") != 0) & (F.coalesce(F.lag("dir").over(o), F.lit(0)) != F.col("dir"))
    own = runs.withColumn("_entry", entered.cast("int")).where("live")
    n = own.agg(F.count_distinct("symbol").alias("_n"), F.coalesce(F.sum("_entry"), F.lit(0)).alias("trades"))
    port = own.groupBy("ts").agg(F.sum("ret").alias("_s")).crossJoin(F.broadcast(n)).select("ts", (F.col("_s") / F.col("_n")).alias("ret"))
    path = Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one row a time of the calendar
    port = port.withColumn("_l", F.sum(F.log1p("ret")).over(path))
    port = port.withColumn("_d", F.exp(F.col("_l") - F.greatest(F.lit(0.0), F.max("_l").over(path))) - 1)
    out = port.agg(F.count("*").alias("_times"), aggregates.sharpe(F.col("ret"), per_year).alias("sharpe"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"), F.least(F.min("_d"), F.lit(0.0)).alias("max_dd"))
    out = out.crossJoin(F.broadcast(n.select("trades")))
    reason = F.when(F.col("_times") == 0, "no data").when(F.col("trades") < least_trades, "trades").when(F.col("sharpe") < least_sharpe, "sharpe").when(F.col("ret") <= 0, "return").when(F.col("max_dd") < worst, "fall")
    return out.select("trades", "sharpe", "ret", "max_dd", reason.alias("reason"))


def composite(port_sharpe: Column, full_sharpe: Column, sealed_sharpe: Column | None = None) -> Column:
    out = 0.5 * F.coalesce(port_sharpe, F.lit(0.0)) + 0.2 * F.coalesce(full_sharpe, F.lit(0.0))
    return out if sealed_sharpe is None else out + 0.3 * F.coalesce(sealed_sharpe, F.lit(0.0))


def tilted(score: Column, max_dd: Column, target: float = 0.30, weight: float = 0.5, low: float = 0.7, high: float = 1.15) -> Column:
    """A positive score times a bounded factor for falls above or below the target."""
    factor = F.least(F.lit(high), F.greatest(F.lit(low), 1 + weight * (target - F.abs(max_dd)) / target))
    return F.when((score > 0) & max_dd.isNotNull(), score * factor).otherwise(score)


def screen(runs: DataFrame, per_year: float, key: str = "candidate") -> DataFrame:
    """train_sharpe, train_max_dd, train_trades_per_year of runs (key, ts, ret, turnover)."""
    own = aggregates.metrics(runs.withColumn("w_held", F.lit(1.0)), per_year, (key,))
    trades = runs.groupBy(key).agg((F.count_if(F.col("turnover") > 0) / 2 / F.count("*") * per_year).alias("train_trades_per_year"))
    return own.select(key, F.col("sharpe").alias("train_sharpe"), F.col("max_dd").alias("train_max_dd")).join(trades, key)


def deflated(runs: DataFrame, trials: int, per_year: float, key: str = "candidate") -> DataFrame:
    m = runs.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.moments(F.col("ret")).items()])
    return m.select(key, aggregates.probabilistic_sharpe(aggregates.expected_best(F.lit(trials), F.lit(per_year))).alias("dsr"))


def stability(neighbours: DataFrame, base: DataFrame, key: str = "candidate", good: float = 0.7) -> DataFrame:
    """0 to 1 by candidate: 0.6 of the share of neighbours that do well, 0.4 of how near they are to the base.

    neighbours: key, sharpe of each changed parameter; base: key, base.
    """
    own = neighbours.join(base, key)
    passes = F.when(F.col("base") > 1e-9, F.col("sharpe") >= good * F.col("base")).otherwise(F.col("sharpe") >= F.col("base") - 0.1)
    out = own.groupBy(key).agg(F.avg(passes.cast("double")).alias("near"), F.sqrt(F.avg((F.col("sharpe") - F.col("base")) ** 2)).alias("rms"), F.first("base").alias("base"))
    smooth = F.greatest(F.lit(0.0), 1 - F.col("rms") / F.greatest(F.lit(0.25), F.abs("base")))
    return base.join(out.select(key, (0.6 * F.col("near") + 0.4 * smooth).alias("stability")), key, "left").select(key, F.coalesce("stability", F.lit(1.0)).alias("stability"))


def _valid(x: float, spec: dict) -> float:
    x = min(max(x, spec["min"]), spec["max"])
    return float(round(x)) if spec.get("int") else float(x)


class Parzen:
    """A mixture over one parameter: a normal at each trial, as wide as the gaps to its neighbours, and a flat part.

    As in Bergstra et al. (2011), Algorithms for hyper-parameter optimization, section 4.
    """

    def __init__(self, trials: list[float], spec: dict) -> None:
        self.low, self.span = float(spec["min"]), max(float(spec["max"] - spec["min"]), 1e-9)
        self.at = np.sort((np.array(trials) - self.low) / self.span)
        gaps = np.diff(np.concatenate(([0.0], self.at, [1.0])))
        self.wide = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / (1 + len(trials)), 1.0)

    def sample(self, rng: np.random.Generator) -> float:
        k = rng.integers(len(self.at) + 1)
        x = rng.random() if k == len(self.at) else rng.normal(self.at[k], self.wide[k])
        return self.low + self.span * abs((x + 1) % 2 - 1) if 0 > x or x > 1 else self.low + self.span * x

    def log(self, x: float) -> float:
        z = ((x - self.low) / self.span - self.at) / self.wide
        return math.log((1.0 + (np.exp(-0.5 * z * z) / (self.wide * math.sqrt(2 * math.pi))).sum()) / (len(self.at) + 1))


def search(evaluate: Callable[[list[dict]], list[float]], specs: dict[str, dict], trials: int, seed: int = 11, startup: int = 12, batch: int = 1, best: float = 0.2, options: int = 32) -> list[tuple[dict, float]]:
    """Parzen search: (parameters, objective) of all trials, in order; the first are the defaults, then uniform ones.

    Each further one is, of `options` drawn from the mixture over the best share of trials, that where this mixture is
    highest over that of the others. evaluate: objectives of several sets at once, as one Spark job; batch: sets asked for
    at a time.
    """
    if not specs:
        return [({}, evaluate([{}])[0])]
    rng = np.random.default_rng(seed)
    seen: list[tuple[dict, float]] = []
    while len(seen) < trials:
        n = min(batch, trials - len(seen))
        if not seen:
            asked = [{k: float(s["default"]) for k, s in specs.items()}]
        elif len(seen) < startup:
            asked = [{k: _valid(rng.uniform(s["min"], s["max"]), s) for k, s in specs.items()} for _ in range(n)]
        else:
            order = sorted(range(len(seen)), key=lambda i: -seen[i][1])
            first = math.ceil(best * len(seen))
            near, far = ({k: Parzen([seen[i][0][k] for i in part], s) for k, s in specs.items()} for part in (order[:first], order[first:]))
            asked = []
            for _ in range(n):
                drawn = [{k: _valid(near[k].sample(rng), s) for k, s in specs.items()} for _ in range(options)]
                asked.append(max(drawn, key=lambda o: sum(near[k].log(o[k]) - far[k].log(o[k]) for k in specs)))
        seen += zip(asked, evaluate(asked), strict=True)
    return seen


def climb(evaluate: Callable[[list[dict]], list[float]], specs: dict[str, dict], start: tuple[dict, float], steps: int, seed: int, share: float = 0.15) -> tuple[dict, float]:
    """Hill climb from the best of a search: the best of changed copies, if it is better, each step one job."""
    rng, best = np.random.default_rng(seed), start
    for _ in range(steps):
        near = [{k: _valid(rng.normal(best[0][k], share * (s["max"] - s["min"])), s) for k, s in specs.items()} for _ in range(8)]
        top = max(zip(near, evaluate(near), strict=True), key=lambda p: p[1])
        best = top if top[1] > best[1] else best
    return best
