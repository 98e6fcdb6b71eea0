"""Column helpers that keep NaN (no data) apart from NULL (off the grid), under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = Column | str


def nan() -> Column:
    return F.lit(float("nan"))


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Name) -> Column:
    """True for numbers, false for NULL, NaN and infinities."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def known(c: Name) -> Column:
    """The value if finite, else NULL, so that aggregates skip it."""
    c = col(c)
    return F.when(finite(c), c)


def or_nan(c: Column) -> Column:
    return F.coalesce(c, nan())


def clip(c: Name, lo: float, hi: float) -> Column:
    """c within [lo, hi]; NaN stays NaN."""
    c = col(c)
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def ratio(a: Name, b: Name) -> Column:
    """a / b, NaN where b is 0."""
    a, b = col(a), col(b)
    return F.when(b == 0, nan()).otherwise(a / F.when(b != 0, b))


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that filters above are not pushed through, so that a large expression is not copied into each use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def modulo(c: Column, n: float) -> Column:
    """c modulo n in [0, n)."""
    return F.pmod(c, F.lit(float(n)))


def half_even(c: Name) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(col(c)).cast("int")
