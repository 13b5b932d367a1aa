"""Closed-form scalars as Columns: normal distribution, logit, counter-based random draws, money and step rounding."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal distribution's quantiles (Acklam).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425
# Coefficients of the distribution function's polynomial (Abramowitz and Stegun 26.2.17).
CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CDF_SCALE = 0.2316419


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    t = 1.0 / (1.0 + CDF_SCALE * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * _horner(t, (*CDF[::-1], 0.0))
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """NULL outside (0, 1)."""
    q = p - 0.5
    r = q * q
    middle = _horner(r, QUANTILE_A) * q / _horner(r, (*QUANTILE_B, 1.0))
    tail = lambda z: _horner(z, QUANTILE_C) / _horner(z, (*QUANTILE_D, 1.0))
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when((p <= 0) | (p >= 1), None).when(p < TAIL, tail(low)).when(p <= 1 - TAIL, middle).otherwise(-tail(high))


def logit(p: Column, edge: float = 1e-9) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.ln(q / (1 - q))


# Fixed value: the odd step of the draw counter.
STEP = 0x6D2B79F5


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in two halves, so that no long overflows."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def uniform(seed: Column, draw: Column) -> Column:
    """Draw number `draw`, from 0, of the 32-bit generator with a seed: a number from 0 to below 1.

    The generator's state is a counter, so that any draw is a function of seed and number alone, on any task.
    """
    low32 = F.lit(0xFFFFFFFF)
    s = (seed.cast("long") + (draw.cast("long") + 1) * STEP).bitwiseAND(low32)
    t = _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(low32))
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / 4294967296.0


def uniforms(seed: int, draws: np.ndarray) -> np.ndarray:
    """uniform() of an array of draw numbers, for kernels that need their numbers in order."""
    low = np.uint64(0xFFFFFFFF)
    s = (np.uint64(seed & 0xFFFFFFFF) + (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)) & low
    t = ((s ^ (s >> np.uint64(15))) * (s | np.uint64(1))) & low
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & low)) & low
    return (t ^ (t >> np.uint64(14))) / 4294967296.0


def gaussian(seed: Column, draw: Column) -> Column:
    """A standard normal number by Box and Muller, of draws 2 draw and 2 draw + 1."""
    u = F.greatest(uniform(seed, 2 * draw), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(seed, 2 * draw + 1))


def kernel_density(points: DataFrame, at: DataFrame, width: float) -> DataFrame:
    """Mean Gaussian kernel of column x of points at each x of `at`, which is a small table of places."""
    z = (F.col("x") - F.col("p")) / width
    own = F.broadcast(at.select("x").distinct()).join(points.select(F.col("x").alias("p")))
    return own.groupBy("x").agg((F.avg(F.exp(-0.5 * z * z)) / (width * math.sqrt(2 * math.pi))).alias("density"))


def choose(n: int, k: int) -> int:
    return math.comb(n, k)


def subsets(spark: SparkSession, n: int, k: int, most: int = 20_000) -> DataFrame:
    """(combo, member): the k-subsets of 0 .. n - 1 in order, at most `most`."""
    if choose(n, k) > most:
        raise ValueError(f"{choose(n, k)} subsets are more than {most}")
    rows = [(c, m) for c, members in enumerate(combinations(range(n), k)) for m in members]
    return spark.createDataFrame(rows, "combo int, member int")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever zone the session has."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def round_down(quantity: Column, step: float) -> Column:
    return F.floor(quantity / step + 1e-9) * step


def money(x: Column) -> Column:
    """A sum in dollars with k, M or B."""
    size = F.abs(x)
    short = lambda by, unit: F.concat(F.lit("$"), F.format_string("%.1f", x / by), F.lit(unit))
    return F.when(size >= 1e9, short(1e9, "B")).when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "k")).otherwise(F.concat(F.lit("$"), F.format_string("%.0f", x)))
