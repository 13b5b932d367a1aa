"""Null rules of the expression language: a value not known yet is NULL, a comparison with it is false, never NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divisors and deviations below this are taken for 0.
EPS = 1e-12


def safe_div(a: Column, b: Column, eps: float = EPS) -> Column:
    """a / b; NULL if b is nearer to 0 than eps."""
    return F.when(F.abs(b) >= eps, a / b)


def gt(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, F.lit(False))


def lt(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def strict(f, *columns: Column) -> Column:
    """f of the columns; NULL if any of them is."""
    return F.when(reduce(lambda x, y: x & y, (c.isNotNull() for c in columns)), f(*columns))


def min2(a: Column, b: Column) -> Column:
    return strict(F.least, a, b)


def max2(a: Column, b: Column) -> Column:
    return strict(F.greatest, a, b)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))
