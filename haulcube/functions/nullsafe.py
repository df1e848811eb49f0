"""Null/NaN/ANSI-safe Column helpers shared by all operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(c: Column) -> Column:
    """c > 0 with NaN and null failing (Spark orders NaN above every number)."""
    return (c > 0) & ~F.isnan(c)


def neq_keep_null(c: Column, value) -> Column:
    """``c != value`` that keeps null rows, as pandas' ``!=`` does."""
    return ~c.eqNullSafe(F.lit(value))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(a, F.when(b != 0, b))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)
