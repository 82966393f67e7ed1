"""Arithmetic and number-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 1e-12


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent of the size of the previous value; null when that is zero."""
    return F.when(F.abs(previous) > ZERO, (current - previous) / F.abs(previous) * 100.0)


def share_pct(part: Column, total: Column) -> Column:
    return F.when(F.abs(total) > ZERO, part / total * 100.0)


def parsed(text: Column) -> Column:
    """Text as a number or null. Text that cannot start a number is not even tried, as a failed try is slow."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9.iInN]"), text.try_cast("double"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finite(value: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def band(value: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """First label whose lower bound the value reaches; `steps` in falling order."""
    out = None
    for bound, label in steps:
        cond = value >= bound
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def measure_text(value: Column) -> Column:
    """1.23M from a million on, 1,234 from a thousand on, 123.4 from a hundred on, else 1.23."""
    size = F.abs(value)
    return (
        F.when(size >= 1_000_000, F.format_string("%.2fM", F.bround(value / 1_000_000, 2)))
        .when(size >= 1_000, F.format_string("%,.0f", F.bround(value, 0)))
        .when(size >= 100, F.format_string("%,.1f", F.bround(value, 1)))
        .otherwise(F.format_string("%,.2f", F.bround(value, 2)))
    )
