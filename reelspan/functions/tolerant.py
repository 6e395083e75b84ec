"""Casts and small values that never fail a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_float(c: Column | str) -> Column:
    """A double; null for what isn't a number, and for NaN."""
    x = col(c).cast("string").try_cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def to_int(c: Column | str) -> Column:
    """A long, fractions cut off; null for null, '' and text such as 'N/A'."""
    return to_float(c).try_cast("bigint")


def parse_rate(c: Column | str) -> Column:
    """'30000/1001' to 29.97003; null when either side is zero or unreadable."""
    parts = F.split(col(c), "/")
    top, bottom = to_float(F.get(parts, F.lit(0))), to_float(F.get(parts, F.lit(1)))
    ok = top.isNotNull() & bottom.isNotNull() & (top != 0) & (bottom != 0)
    return F.when(ok, F.round(F.try_divide(top, bottom), 6))


def clamp(c: Column | str, low, high) -> Column:
    """Held between two values; null stays null."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def span_length(st: Column | str = "st", en: Column | str = "en") -> Column:
    """Length of a span, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), col(en) - col(st))
