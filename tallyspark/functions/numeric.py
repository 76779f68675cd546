"""Null-safe arithmetic. Missing stays NULL and a zero denominator gives NULL (never an error, never 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den, mult: float = 1.0) -> Column:
    """``num / den * mult``; NULL when either is missing or the denominator is 0."""
    out = F.try_divide(_c(num), _c(den))
    return out * F.lit(float(mult)) if mult != 1.0 else out


def pct_change(new, old) -> Column:
    """Percent change against the absolute prior value."""
    new, old = _c(new), _c(old)
    return F.try_divide(new - old, F.abs(old)) * F.lit(100.0)


def clamp(x, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Limit to [lo, hi]; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def round_half_even(x, digits: int = 0) -> Column:
    return F.bround(_c(x), digits)


def is_number(x) -> Column:
    """Present and finite."""
    x = _c(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def adaptive_round(x, kind) -> Column:
    """Money to whole units; other figures two decimals below 1 and one decimal from 1 up."""
    x, kind = _c(x), _c(kind)
    return (
        F.when(kind == "money", F.bround(x, 0))
        .when(F.abs(x) < 1, F.bround(x, 2))
        .otherwise(F.bround(x, 1))
    )


def cagr(first, last, span_years) -> Column:
    """Compound yearly growth in percent: NULL for a start <= 0 or an end < 0, -100 for an end of 0."""
    a, b, n = _c(first).cast("double"), _c(last).cast("double"), _c(span_years)
    valid = is_number(a) & is_number(b) & (a > 0) & (b >= 0) & (n > 0)
    safe_b = F.when(valid & (b > 0), b)
    return F.when(valid & (b == 0), F.lit(-100.0)).otherwise(
        F.expm1(F.try_divide(F.ln(safe_b) - F.ln(F.when(valid, a)), n)) * 100
    )


def accounting_number(text) -> Column:
    """'(1,234)' -> -1234, '-' and 'nil' -> NULL, '12.5' -> 12.5; anything else NULL."""
    t = F.trim(_c(text))
    core = F.regexp_replace(t, r"[\s,()]", "")
    value = F.when(core.rlike(r"^-?\d+(\.\d+)?$"), core.try_cast("double"))
    return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)


def midpoint(lo, hi, digits: int = 2) -> Column:
    return F.bround((_c(lo) + _c(hi)) / 2, digits)
