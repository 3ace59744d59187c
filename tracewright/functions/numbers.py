"""Numeric expressions shared by the feature blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: Column | str | float | int) -> Column:
    if isinstance(x, str):
        x = F.col(x)
    elif not isinstance(x, Column):
        x = F.lit(x)
    return x.cast("double")


def ratio(a, b) -> Column:
    """a / b, 0.0 when b is 0 or missing."""
    return F.coalesce(num(a) / F.nullif(num(b), F.lit(0.0)), F.lit(0.0))


def or_zero(x) -> Column:
    return F.coalesce(num(x), F.lit(0.0))


def finite(x) -> Column:
    v = num(x)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def count_where(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def entropy_term(part: Column, whole: Column) -> Column:
    p = part / whole
    return -(p * F.log(p + F.lit(1e-12)))
