"""The staged validation: stages are kept, a control without drift doesn't pass, perturbed sets stay within bounds."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import maths
from tidemark.plans import gauntlet
from tidemark.plans.registry import staged


@pytest.fixture(scope="module")
def bars(spark):
    """Three symbols of 800 days: closes that come back to their mean, and a random walk that nothing predicts."""
    rng = np.random.default_rng(6)
    rows = []
    for s in range(2):
        walk = np.cumsum(rng.normal(0, 0.002, 800)) + rng.normal(0, 0.01, 800)
        rows += [(f"s{s}", k, float(np.exp(x))) for k, x in enumerate(walk)]
    rows += [("walk", k, float(np.exp(x))) for k, x in enumerate(np.cumsum(rng.normal(0, 0.01, 800)))]
    own = spark.createDataFrame(rows, "symbol string, k int, c double")
    day = F.timestamp_add("DAY", F.col("k"), F.lit("2015-01-01").cast("timestamp_ntz"))
    return own.select("symbol", day.alias("ts"), F.col("k").alias("i"), F.col("c").alias("o"), F.col("c").alias("h"), F.col("c").alias("l"), "c", F.lit(1.0).alias("v"))


def setting(bars, primary):
    return gauntlet.Setting(bars, primary, "2015-01-01", "2017-02-01", cost=1e-4, permutations=12, floors={"symbols_positive": 2, "permutation_p": 0.1, "pbo": 1.1})


def test_stages_are_kept_and_later_ones_read_survivors_only(spark, bars, tmp_path):
    own = [c for c in staged.CANDIDATES if c.name in ("trend", "reversal", "unsound")]
    first = gauntlet.Gauntlet(spark, own, setting(bars.where("symbol <> 'walk'"), "s0"), str(tmp_path), "b")
    assert first.stage("S2").count() == 2 and first.computed == ["S2"]  # broken off here
    again = gauntlet.Gauntlet(spark, own, setting(bars.where("symbol <> 'walk'"), "s0"), str(tmp_path), "b")
    out = {r["candidate"]: r for r in again.judged().collect()}
    assert again.computed == ["S3", "S4", "S5", "S5b", "S5c"]
    assert out["unsound"]["failed_stage"] == "S0" and out["trend"]["failed_stage"] == "S2" and out["trend"]["wf_sharpe"] is None
    good = out["reversal"]
    assert good["failed_stage"] is None and good["dsr"] > 0.95 and good["permutation_p"] == pytest.approx(1 / 13) and 0 <= good["pbo"] <= 1 and good["score"] == pytest.approx(0.5 * good["port_sharpe"] + 0.2 * good["full_sharpe"])
    shutil.rmtree(tmp_path / "b" / "S5b")
    third = gauntlet.Gauntlet(spark, own, setting(bars.where("symbol <> 'walk'"), "s0"), str(tmp_path), "b")
    assert third.judged().where("failed_stage is null").count() == 1 and third.computed == ["S5b"]
    # figures of the last stages by plain arithmetic on the runs
    full = gauntlet.runs_of(bars.where("symbol = 's0' and ts < timestamp_ntz '2017-02-01'"), own[1].doc, [own[1].configs[good["final_config"]]], 1e-4).where("i >= 1").toPandas().sort_values("ts")
    ratio = lambda r: r.mean() / r.std() * np.sqrt(365)
    x, t = full["ret"].to_numpy(), full["turnover"].to_numpy()
    assert good["full_sharpe"] == pytest.approx(ratio(x)) and good["stress_share"] == pytest.approx(ratio(np.maximum(-0.95, x - 2e-4 * t)) / ratio(x))


def test_a_control_without_drift_does_not_pass(spark, bars, tmp_path):
    out = gauntlet.Gauntlet(spark, staged.CANDIDATES[:4], setting(bars.where("symbol = 'walk'"), "walk"), str(tmp_path), "c").judged()
    assert out.where("failed_stage is null").isEmpty()


def test_perturbed_sets_are_drawn_in_turn_and_stay_within_bounds():
    doc = {"params": {"a": {"min": 0.0, "max": 1.0, "default": 0.5}, "n": {"min": 10, "max": 21, "default": 20, "int": True}}}
    sets = gauntlet.perturbed_sets(doc, {"a": 0.5, "n": 20.0})
    u = maths.uniforms(99, np.arange(16))
    assert len(sets) == 8 and sets[3] == {"a": pytest.approx(0.5 * (1 + (2 * u[6] - 1) * 0.15)), "n": float(np.floor(min(21, 20 * (1 + (2 * u[7] - 1) * 0.15)) + 0.5))}
    assert all(s["n"] == int(s["n"]) <= 21 for s in sets) and gauntlet.perturbed_sets({}, {}) == [{}] * 8
