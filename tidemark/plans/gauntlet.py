"""The whole staged validation of candidates whose parameters are grids, from train fit to regimes, resumable by stage.

A candidate is a document, a list of parameter sets (its configurations) and a name. One lazy plan back-tests all
configurations of all candidates on a panel; every stage reads only the candidates that passed the stage before, and is
written to `folder`/`batch`/stage as it ends. A run of the same batch reads the stages that are there and goes on from
the first that isn't.

Stages: S0 the document is well formed (and its grid isn't empty); S2 the configuration with the best ratio on the first
70 % of the rows before the seal of the primary symbol; S3 walk-forward on the primary symbol, the configuration chosen
again in each month from the twelve before it, less an embargo; S4 the same on every symbol, and the equal-weight
portfolio of all those out-of-sample returns; S5 the chosen configuration (the upper median of the months' choices) on all
rows before the seal: deflated ratio, shuffled markets, bootstrap; S5b costs ramped up, perturbed parameters, crises; S5c
overfitting over the configurations, and regimes of the portfolio.

Floors are validation.FLOORS unless given. Figures that can't be computed fail.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import uniforms
from tidemark.operators import aggregates, statistics
from tidemark.operators import windows as w
from tidemark.plans import backtest, expr
from tidemark.plans.validation import FLOORS, SCALE, composite

#: Name and figures of each stage, in order.
STAGES = {
    "S2": ("config", "train_sharpe", "train_trades_per_year", "train_max_dd"),
    "S3": ("wf_windows", "wf_sharpe", "wf_positive", "wf_worst", "wf_max_dd"),
    "S4": ("symbols_positive", "port_sharpe", "port_positive", "port_worst", "port_max_dd"),
    "S5": ("final_config", "full_sharpe", "dsr", "permutation_p", "bootstrap_lo"),
    "S5b": ("stress_share", "perturbed_share", "crisis_max_dd"),
    "S5c": ("pbo", "regime_min", "regime_share"),
}
WINDOWS, PERTURBED, SHIFT, KEPT, CONCENTRATED = 12, 8, 0.15, 0.6, 0.8


@dataclass
class Candidate:
    name: str
    doc: dict
    configs: list[dict[str, float]]


@dataclass
class Setting:
    """What candidates are judged on. seal: no row from it on is read. crises: a table (window, start, end), or None."""

    bars: DataFrame
    primary: str
    first: str
    seal: str
    per_year: float = 365.0
    timeframe: str = "1d"
    cost: float = 13e-4
    trials: int = 10
    train_days: int = 360
    step_days: int = 30
    embargo_days: int = 10
    permutations: int = 120
    crises: DataFrame | None = None
    floors: dict[str, float] = field(default_factory=dict)

    def floor(self, name: str) -> float:
        return self.floors.get(name, FLOORS[name])


def perturbed_sets(doc: dict, params: dict[str, float], draws: int = PERTURBED, share: float = SHIFT, seed: int = 99) -> list[dict[str, float]]:
    """Parameter sets around one: each parameter times 1 plus a draw within the share, within its bounds, whole if it has to be."""
    names = list(params)
    u = uniforms(seed, np.arange(draws * len(names))).reshape(draws, len(names)) if names else np.zeros((draws, 0))
    out = []
    for row in u:
        own = {}
        for n, x in zip(names, row.tolist(), strict=True):
            spec = doc["params"][n]
            v = min(spec["max"], max(spec["min"], params[n] * (1 + (2 * x - 1) * share)))
            own[n] = float(np.floor(v + 0.5)) if spec.get("int") else v
        out.append(own)
    return out


def runs_of(bars: DataFrame, doc: dict, many: list[dict[str, float]], cost: float) -> DataFrame:
    """symbol, config, ts, i, dir, turnover, entry and ret of a document's long and flat positions for each parameter set."""
    by = ("symbol", "config")
    run = backtest.returns(backtest.long_flat(expr.signals_of_many(bars, doc, many), by), cost, by=by)
    before = F.coalesce(F.lag("dir").over(Window.partitionBy(*by).orderBy("ts")), F.lit(0))
    return run.withColumn("entry", ((F.col("dir") != 0) & (F.col("dir") != before)).cast("int")).select(*by, "ts", "i", "dir", "turnover", "entry", "ret")


def falls(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, max_dd): the deepest fall below the start or a later top."""
    o = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_l", F.sum(F.log1p("ret")).over(o))
    own = own.withColumn("_d", F.exp(F.col("_l") - F.greatest(F.lit(0.0), F.max("_l").over(o))) - 1)
    return own.groupBy(*by).agg(F.least(F.min("_d"), F.lit(0.0)).alias("max_dd"))


def perturbed(bars: DataFrame, doc: dict, params: dict[str, float], cost: float, per_year: float) -> DataFrame:
    """(symbol, base, mean, survives): ratios of a parameter set and the mean of those around it; survives with over KEPT of it."""
    runs = runs_of(bars, doc, [params, *perturbed_sets(doc, params)], cost)
    s = runs.groupBy("symbol", "config").agg(aggregates.sharpe(F.col("ret"), per_year).alias("s"))
    out = s.groupBy("symbol").agg(F.max(F.when(F.col("config") == 0, F.col("s"))).alias("base"), F.avg(F.when(F.col("config") > 0, F.col("s"))).alias("mean"))
    return out.withColumn("survives", (F.col("base") > 0) & (F.col("mean") > KEPT * F.col("base")))


class Gauntlet:
    """One batch of candidates. judged() is the result; stage() what a stage said of those that reached it."""

    def __init__(self, spark: SparkSession, candidates: list[Candidate], setting: Setting, folder: str, batch: str) -> None:
        self.spark, self.setting, self.at = spark, setting, f"{folder}/{batch}"
        self.candidates = {c.name: c for c in candidates}
        self.computed: list[str] = []  # stages that this run computed, not those it found
        self.static = {c.name: "; ".join(expr.problems(c.doc)) or ("" if c.configs else "no configuration") for c in candidates}

    # ------------------------------------------------------------------ what stages are made of
    def _sound(self, names: list[str]) -> list[Candidate]:
        return [self.candidates[n] for n in names]

    def _runs(self, names: list[str], bars: DataFrame | None = None, configs: dict[str, list[dict[str, float]]] | None = None) -> DataFrame:
        """runs_of all named candidates before the seal, one plan."""
        s = self.setting
        own = (s.bars if bars is None else bars).where(F.col("ts") < F.lit(s.seal).cast("timestamp_ntz"))
        parts = [runs_of(own, c.doc, (configs or {}).get(c.name, c.configs), s.cost).withColumn("candidate", F.lit(c.name)) for c in self._sound(names)]
        return reduce(DataFrame.unionByName, parts)

    def _out_of_sample(self, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Windows of each (candidate, symbol) with what was chosen, and the chosen configurations' rows in them."""
        s = self.setting
        windows = statistics.calendar(self.spark, s.first, s.seal, s.train_days, s.step_days)
        chosen = statistics.walk_forward(runs, windows, s.per_year, s.embargo_days, ("candidate", "symbol")).where("n > 0")
        own = chosen.select("candidate", "symbol", "window", "config").join(F.broadcast(windows), "window")
        rows = runs.join(own, ["candidate", "symbol", "config"]).where((F.col("ts") >= F.col("test_start")) & (F.col("ts") < F.col("test_end")))
        return chosen, rows.select("candidate", "symbol", "ts", "ret")

    def _figures(self, chosen: DataFrame, rows: DataFrame) -> DataFrame:
        by = ("candidate", "symbol")
        per = chosen.groupBy(*by).agg(F.count("*").alias("wf_windows"), F.avg((F.col("ret") > 0).cast("double")).alias("wf_positive"), F.min("ret").alias("wf_worst"))
        pooled = rows.groupBy(*by).agg(aggregates.sharpe(F.col("ret"), self.setting.per_year).alias("wf_sharpe"))
        return per.join(pooled, list(by)).join(falls(rows, by).withColumnRenamed("max_dd", "wf_max_dd"), list(by))

    def _portfolio(self, rows: DataFrame) -> DataFrame:
        """(candidate, ts, ret): sums over the symbols that have a time, divided by all of the candidate's symbols."""
        n = rows.groupBy("candidate").agg(F.count_distinct("symbol").alias("_n"))
        return rows.groupBy("candidate", "ts").agg(F.sum("ret").alias("_s")).join(F.broadcast(n), "candidate").select("candidate", "ts", (F.col("_s") / F.col("_n")).alias("ret"))

    # ------------------------------------------------------------------ stages
    def _s2(self, names: list[str]) -> tuple[DataFrame, list[tuple[Column, str]]]:
        s = self.setting
        runs = self._runs(names).where(F.col("symbol") == s.primary)
        last = runs.agg(F.max("i").alias("_last"))
        runs = runs.crossJoin(F.broadcast(last)).where((F.col("i") >= 1) & (F.col("i") <= F.floor(0.7 * F.col("_last"))))
        by = ("candidate", "config")
        out = runs.groupBy(*by).agg(aggregates.sharpe(F.col("ret"), s.per_year).alias("train_sharpe"), (F.sum("entry") / F.greatest(F.lit(0.1), F.max("i") / s.per_year)).alias("train_trades_per_year"))
        best = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc(F.round("train_sharpe", 12)), "config"))
        out = out.withColumn("_r", best).where("_r = 1").drop("_r").join(falls(runs, by).withColumnRenamed("max_dd", "train_max_dd"), list(by))
        trades = float(np.ceil(s.floor("train_trades_per_year") * SCALE[s.timeframe]))
        return out, [(F.col("train_sharpe") >= s.floor("train_sharpe"), "train_sharpe"), (F.col("train_trades_per_year") >= trades, "train_trades_per_year"), (F.col("train_max_dd") >= s.floor("train_max_dd"), "train_max_dd")]

    def _s3(self, names: list[str]) -> tuple[DataFrame, list[tuple[Column, str]]]:
        s = self.setting
        out = self._figures(*self._out_of_sample(self._runs(names).where(F.col("symbol") == s.primary)))
        checks = [(F.col("wf_windows") >= WINDOWS, "wf_windows"), *[(F.col(c) >= s.floor(c), c) for c in ("wf_sharpe", "wf_positive", "wf_worst", "wf_max_dd")]]
        return out, checks

    def _s4(self, names: list[str]) -> tuple[DataFrame, list[tuple[Column, str]]]:
        s = self.setting
        chosen, rows = self._out_of_sample(self._runs(names))
        good = (F.col("symbol") == s.primary) | ((F.col("wf_sharpe") > 0) & (F.col("wf_positive") >= 0.5))
        positive = self._figures(chosen, rows).groupBy("candidate").agg(F.count_if(good).cast("double").alias("symbols_positive"))
        port = self._portfolio(rows)
        stats = aggregates.series_stats(port, s.per_year, ("candidate",)).select("candidate", F.col("positive_months").alias("port_positive"), F.col("worst_month").alias("port_worst"))
        ratio = port.groupBy("candidate").agg(aggregates.sharpe(F.col("ret"), s.per_year).alias("port_sharpe"))
        out = positive.join(stats, "candidate").join(ratio, "candidate").join(falls(port, ("candidate",)).withColumnRenamed("max_dd", "port_max_dd"), "candidate")
        return out, [(F.col(c) >= s.floor(c), c) for c in ("symbols_positive", "port_sharpe", "port_positive", "port_worst")]

    def _final(self, names: list[str]) -> dict[str, int]:
        """By candidate the upper median of what its windows on the primary symbol chose."""
        chosen, _ = self._out_of_sample(self._runs(names).where(F.col("symbol") == self.setting.primary))
        rows = chosen.groupBy("candidate").agg(F.sort_array(F.collect_list("config")).alias("c")).collect()  # a number a month
        return {r["candidate"]: r["c"][len(r["c"]) // 2] for r in rows}

    def _full(self, names: list[str], final: dict[str, int]) -> DataFrame:
        one = {n: [self.candidates[n].configs[final[n]]] for n in names}
        return self._runs(names, self.setting.bars.where(F.col("symbol") == self.setting.primary), one).where("i >= 1")

    def _s5(self, names: list[str]) -> tuple[DataFrame, list[tuple[Column, str]]]:
        s = self.setting
        final = self._final(names)
        full = self._full(names, final)
        m = full.groupBy("candidate").agg(aggregates.sharpe(F.col("ret"), s.per_year).alias("full_sharpe"), *[c.alias(n) for n, c in aggregates.moments(F.col("ret")).items()])
        best = aggregates.expected_best(F.lit(max(s.trials, 10)), F.lit(s.per_year))
        out = m.select("candidate", "full_sharpe", aggregates.probabilistic_sharpe(best).alias("dsr"))
        own = s.bars.where((F.col("symbol") == s.primary) & (F.col("ts") < F.lit(s.seal).cast("timestamp_ntz")))
        markets = statistics.permuted_markets(own, s.permutations).withColumn("symbol", F.concat_ws("|", "symbol", "perm")).drop("perm")
        one = {n: [self.candidates[n].configs[final[n]]] for n in names}
        shuffled = self._runs(names, markets, one).where("i >= 1").groupBy("candidate", "symbol").agg(aggregates.sharpe(F.col("ret"), s.per_year).alias("sharpe"))
        p = statistics.permutation_p(shuffled, out.select("candidate", F.col("full_sharpe").alias("observed")), ("candidate",)).withColumnRenamed("p", "permutation_p")
        lo = statistics.bootstrap_interval(statistics.block_bootstrap(full, s.per_year, by=("candidate",)), ("candidate",)).select("candidate", F.col("lo").alias("bootstrap_lo"))
        names_of = self.spark.createDataFrame(list(final.items()), "candidate string, final_config int")
        out = out.join(F.broadcast(names_of), "candidate").join(p, "candidate", "left").join(lo, "candidate", "left")
        return out, [(F.col("dsr") >= s.floor("dsr"), "dsr"), (F.col("permutation_p") <= s.floor("permutation_p"), "permutation_p"), (F.col("bootstrap_lo") > s.floor("bootstrap_lo"), "bootstrap_lo")]

    def _s5b(self, names: list[str]) -> tuple[DataFrame, list[tuple[Column, str]]]:
        s = self.setting
        final = {r["candidate"]: r["final_config"] for r in self.stage("S5").where(F.col("candidate").isin(names)).select("candidate", "final_config").collect()}
        full = self._full(names, final)
        at = lambda k: aggregates.sharpe(F.greatest(F.lit(-0.95), F.col("ret") - F.col("turnover") * s.cost * (k - 1)), s.per_year)
        ramp = full.groupBy("candidate").agg(at(1).alias("_base"), at(3).alias("_three"))
        out = ramp.select("candidate", F.when(F.col("_base") > 0, F.col("_three") / F.col("_base")).otherwise(0.0).alias("stress_share"))
        primary = s.bars.where((F.col("symbol") == s.primary) & (F.col("ts") < F.lit(s.seal).cast("timestamp_ntz")))
        near = [perturbed(primary, c.doc, c.configs[final[c.name]], s.cost, s.per_year).select(F.lit(c.name).alias("candidate"), F.when(F.col("base") > 0, F.col("mean") / F.col("base")).otherwise(0.0).alias("perturbed_share")) for c in self._sound(names)]
        out = out.join(reduce(DataFrame.unionByName, near), "candidate", "left")
        if s.crises is None:
            return out.withColumn("crisis_max_dd", F.lit(0.0)), self._stressed()
        inside = full.join(F.broadcast(s.crises), (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
        worst = falls(inside, ("candidate", "window")).groupBy("candidate").agg(F.min("max_dd").alias("crisis_max_dd"))
        return out.join(worst, "candidate", "left").fillna(0.0, ["crisis_max_dd"]), self._stressed()

    def _stressed(self) -> list[tuple[Column, str]]:
        s = self.setting
        return [(F.col("stress_share") > s.floor("stress_share"), "stress_share"), (F.col("perturbed_share") > KEPT, "perturbed_share"), (F.col("crisis_max_dd") > s.floor("crisis_max_dd"), "crisis_max_dd")]

    def _s5c(self, names: list[str]) -> tuple[DataFrame, list[tuple[Column, str]]]:
        s = self.setting
        runs = self._runs(names)
        blocks = statistics.block_ratios(runs.where((F.col("symbol") == s.primary) & (F.col("i") >= 1)), 10, s.per_year, ("candidate", "config"))
        pbo = statistics.overfitting(blocks, self.spark, by=("candidate",)).select("candidate", "pbo")
        port = self._portfolio(self._out_of_sample(runs)[1])
        bars = s.bars.where((F.col("symbol") == s.primary) & (F.col("ts") < F.lit(s.seal).cast("timestamp_ntz")))
        bars = bars.withColumn("lret", F.ln(F.col("c") / F.lag("c").over(w.order()))).withColumns({"vol": w.log_vol(F.col("lret"), 48), "trend": w.roc(F.col("c"), 96)})
        cuts = aggregates.exact_quantiles(bars, "vol", [1 / 3, 2 / 3], "floor_n1", ("symbol",)).groupBy("symbol").agg(F.min("vol").alias("low"), F.max("vol").alias("high"))
        labels = aggregates.regime_labels(bars.join(F.broadcast(cuts), "symbol"), "vol", "trend", F.col("low"), F.col("high")).select("ts", "regime")
        own = port.join(labels, "ts").where(F.col("regime").isNotNull()).groupBy("candidate", "regime").agg(F.count("*").alias("n"), aggregates.sharpe(F.col("ret"), s.per_year).alias("sharpe"), F.greatest(F.sum("ret"), F.lit(0.0)).alias("gain"))
        regimes = own.groupBy("candidate").agg(F.min(F.when(F.col("n") >= 30, F.col("sharpe"))).alias("regime_min"), F.when(F.sum("gain") > 0, F.max("gain") / F.sum("gain")).otherwise(0.0).alias("regime_share"))
        checks = [(F.col("pbo") < s.floor("pbo"), "pbo"), (F.coalesce(F.col("regime_min"), F.lit(0.0)) >= 0, "regime_min"), (F.col("regime_share") <= CONCENTRATED, "regime_share")]
        return pbo.join(regimes, "candidate", "left"), checks

    # ------------------------------------------------------------------ running
    def _there(self, path: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def stage(self, name: str) -> DataFrame:
        """candidate, the stage's figures and reason (NULL where it passed) of those that reached it; empty if nobody did."""
        path = f"{self.at}/{name}"
        if not self._there(path):
            before = list(STAGES)[: list(STAGES).index(name)]
            names = [r["candidate"] for r in self.stage(before[-1]).where("reason is null").select("candidate").collect()] if before else [n for n, why in self.static.items() if not why]
            self._compute(name, sorted(names)).write.mode("overwrite").parquet(path)
            self.computed.append(name)
        return self.spark.read.parquet(path)

    def _compute(self, name: str, names: list[str]) -> DataFrame:
        kinds = {"config": "int", "final_config": "int", "wf_windows": "long"}
        if not names:
            return self.spark.createDataFrame([], f"candidate string, {', '.join(f'{c} {kinds.get(c, "double")}' for c in STAGES[name])}, reason string")
        steps: dict[str, Callable] = {"S2": self._s2, "S3": self._s3, "S4": self._s4, "S5": self._s5, "S5b": self._s5b, "S5c": self._s5c}
        found, checks = steps[name](names)
        reason = F.lit(None).cast("string")
        for ok, figure in reversed(checks):
            reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(figure)).otherwise(reason)
        every = self.spark.createDataFrame([(n,) for n in names], "candidate string")
        joined = every.join(found, "candidate", "left")
        return joined.select("candidate", *[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in STAGES[name]], reason.alias("reason"))

    def judged(self) -> DataFrame:
        """candidate, failed_stage and reason (NULL for survivors), all figures of the stages reached, and score."""
        out = self.spark.createDataFrame(list(self.static.items()), "candidate string, _static string")
        failed = F.when(F.col("_static") != "", "S0")
        reason = F.when(F.col("_static") != "", F.col("_static"))
        for name in STAGES:
            out = out.join(self.stage(name).withColumnRenamed("reason", f"_{name}"), "candidate", "left")
            failed, reason = failed.when(F.col(f"_{name}").isNotNull(), name), reason.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}"))
        figures = [f for own in STAGES.values() for f in own]
        return out.select("candidate", failed.alias("failed_stage"), reason.alias("reason"), *figures, composite(F.col("port_sharpe"), F.col("full_sharpe")).alias("score"))

    def portfolio(self, names: list[str]) -> DataFrame:
        """(candidate, ts, ret): the out-of-sample portfolio that a candidate offers to a book."""
        return self._portfolio(self._out_of_sample(self._runs(names))[1])


