"""Window helpers: bars are ordered by ``pos`` within a symbol."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def by_symbol(*more: str) -> WindowSpec:
    return Window.partitionBy("symbol", *more).orderBy("pos")


def trailing(n: int) -> WindowSpec:
    """The last ``n`` bars, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def prior(n: int) -> WindowSpec:
    """The ``n`` bars before the current one."""
    return by_symbol().rowsBetween(-n, -1)


def guarded(value: Column, counted: Column, frame: WindowSpec, n: int) -> Column:
    """``value`` where the frame holds ``n`` known values of ``counted``, else null."""
    return F.when(F.count(counted).over(frame) == n, value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def quotient(a: Column, b: Column) -> Column:
    """a / b of prices: infinite or NaN where b is zero, as in the SQL; null where either is null."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
