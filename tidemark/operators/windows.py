"""Rolling kernels with a fixed number of rows, as native windows over (symbol, ts).

Every kernel is NULL until its frame is full and holds no NULL. All kernels of a panel share one partitioning and order,
so that Spark plans one exchange and one sort for as many as are selected together.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import micros
from tidemark.functions.nulls import EPS, safe_div

BY = ("symbol",)


def order(by: tuple[str, ...] = BY):
    return Window.partitionBy(*by).orderBy("ts")


def frame(n: int, end: int = 0, by: tuple[str, ...] = BY):
    """The last n rows up to `end` rows before the current one."""
    return order(by).rowsBetween(-(n - 1) - end, -end)


def period(n: float, least: int = 1) -> int:
    return int(min(500, max(least, round(n))))


def full(x: Column, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(frame(n)) == n, value)


def lag(x: Column, n: int) -> Column:
    return F.lag(x, n).over(order())


def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(frame(n)))


def wma(x: Column, n: int) -> Column:
    """Weights from n for the newest row down to 1."""
    total = sum((F.lag(x, j).over(order()) * (n - j) for j in range(1, n)), x * n)
    return full(x, n, total / (n * (n + 1) / 2))


def stdev(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_pop(x).over(frame(n)))


def highest(x: Column, n: int) -> Column:
    return full(x, n, F.max(x).over(frame(n)))


def lowest(x: Column, n: int) -> Column:
    return full(x, n, F.min(x).over(frame(n)))


def roc(x: Column, n: int) -> Column:
    base = lag(x, n)
    return F.when(base != 0, x / base - 1)


def zscore(x: Column, n: int) -> Column:
    sd = stdev(x, n)
    return F.when(sd > EPS, (x - sma(x, n)) / sd)


def slope(x: Column, n: int, i: str = "i") -> Column:
    """Least squares slope a row, as a share of the current level."""
    return full(x, n, F.when(x != 0, F.regr_slope(x, F.col(i).cast("double")).over(frame(n)) / F.abs(x)))


def pctrank(x: Column, n: int) -> Column:
    """Share of the frame that isn't above the current value."""
    own = F.collect_list(x).over(frame(n))
    return full(x, n, F.size(F.filter(own, lambda v: v <= x)) / n)


def median(x: Column, n: int) -> Column:
    return full(x, n, F.percentile(x, 0.5).over(frame(n)))


def effratio(x: Column, n: int) -> Column:
    """Net move over the sum of single moves; 0 if nothing moved."""
    moved = F.sum(F.abs(x - lag(x, 1))).over(frame(n))
    return F.when(lag(x, n).isNotNull(), F.when(moved > EPS, F.abs(x - lag(x, n)) / moved).otherwise(0.0))


def true_range(h: str = "h", low: str = "l", c: str = "c") -> Column:
    """h - l, or the wider spread to the close before; h - l at the first row."""
    was = F.lag(c).over(order())
    return F.greatest(F.col(h) - F.col(low), F.abs(F.col(h) - was), F.abs(F.col(low) - was))


def choppiness(n: int, tr: str = "tr") -> Column:
    """100 log(sum of true ranges / range) / log n; 50 where that isn't defined. tr: a column of true_range()."""
    n = period(n, 2)
    spread = F.max("h").over(frame(n)) - F.min("l").over(frame(n))
    ranges = F.sum(tr).over(frame(n))
    value = F.when((spread > EPS) & (ranges > 0), 100 * F.log10(ranges / spread) / F.log10(F.lit(float(n)))).otherwise(50.0)
    return F.when(F.count("*").over(frame(n + 1)) == n + 1, value)


def rangepos(n: int) -> Column:
    """Where the close lies between the frame's lowest low and highest high."""
    n = period(n, 2)
    low = lowest(F.col("l"), n)
    spread = highest(F.col("h"), n) - low
    return F.when(spread > EPS, (F.col("c") - low) / spread)


def forward_return(h: int, c: str = "c") -> Column:
    return F.lead(c, h).over(order()) / F.col(c) - 1


def past_zscore(x: Column, n: int, least: int = 20) -> Column:
    """z of the current value against the n rows before it; 0 with fewer than `least` of them."""
    w = frame(n, 1)
    sd = F.greatest(F.stddev_pop(x).over(w), F.lit(1e-6))
    return F.when(F.count(x).over(w) >= least, (x - F.avg(x).over(w)) / sd).otherwise(0.0)


def realised_vol(ret: Column, n: int, per_year: int = 365) -> Column:
    """Percent a year over up to n + 1 returns; NULL with 5 or fewer."""
    w = frame(n + 1)
    return F.when(F.count(ret).over(w) > 5, F.stddev_pop(ret).over(w) * (per_year**0.5) * 100)


def log_vol(ret: Column, n: int) -> Column:
    """Deviation of log returns over up to n rows, from max(5, n / 2) on."""
    w = frame(n)
    return F.when(F.count(ret).over(w) >= max(5, n // 2), F.stddev_pop(ret).over(w))


def sigma_and_volume(ret: Column, n: int) -> tuple[Column, Column]:
    """Deviation of returns (from n / 2 rows on) and mean traded value (from n / 4 rows on)."""
    w = frame(n)
    value = F.col("v") * F.col("c")
    return F.when(F.count(ret).over(w) >= n // 2, F.stddev_pop(ret).over(w)), F.when(F.count(value).over(w) >= n // 4, F.avg(value).over(w))


def past_beta(y: Column, x: Column, n: int) -> Column:
    """Slope of y on x over the n rows before the current one, 1 if unknown, between 0 and 3."""
    w = frame(n, 1)
    beta = safe_div(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))
    return F.least(F.greatest(F.coalesce(F.when(F.count(y).over(w) >= 2, beta), F.lit(1.0)), F.lit(0.0)), F.lit(3.0))


def past_lead_lag(x_lagged: Column, y: Column, n: int, least: int = 30) -> Column:
    """Correlation of an earlier x with y over the n rows before the current one; 0 with `least` or fewer."""
    w = frame(n, 1)
    both = F.when(x_lagged.isNotNull() & y.isNotNull(), 1)
    known = (F.count(both).over(w) > least) & (F.stddev_pop(x_lagged).over(w) > 0) & (F.stddev_pop(y).over(w) > 0)
    return F.when(known, F.corr(x_lagged, y).over(w)).otherwise(0.0)


def equity(ret: Column) -> Column:
    """Growth of 1. Returns are floored at -95 %, so that their logarithms exist."""
    return F.exp(F.sum(F.log1p(F.greatest(F.coalesce(ret, F.lit(0.0)), F.lit(-0.95)))).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(eq: Column) -> Column:
    return eq / F.max(eq).over(order().rowsBetween(Window.unboundedPreceding, 0)) - 1


def rebased(x: Column) -> Column:
    """Growth since the first valid value."""
    return x / F.first(x, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def drawdown_within(x: Column, days: int) -> Column:
    """Fall from the greatest value of the last `days` days."""
    w = Window.partitionBy(*BY).orderBy(micros(F.col("ts"))).rangeBetween(-days * 86_400_000_000, 0)
    return x / F.max(x).over(w) - 1


def carried(x: Column) -> Column:
    """The last known value."""
    return F.last(x, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))


def average_rank(x: Column, by: tuple[str, ...] = BY) -> Column:
    """Rank from 1; ties have the mean of their ranks."""
    at = F.rank().over(Window.partitionBy(*by).orderBy(x))
    return at + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2
