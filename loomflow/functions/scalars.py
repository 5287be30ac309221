"""Scalar columns of event logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = " -> "
MICROS = 3.6e9


def at(moment: datetime) -> Column:
    """A timestamp without zone as a literal."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def hours(a: Column, b: Column) -> Column:
    """Elapsed hours from a to b."""
    return micros(a, b) / F.lit(MICROS)


def capped(x: Column, cap: float) -> Column:
    return F.least(x, F.lit(float(cap)))


def clipped(x: Column, cap: float) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(float(cap)))


def snapped(x: Column, grid: float, cap: float) -> Column:
    """To the nearest grid point, half to even, within the cap."""
    return clipped(F.rint(x / grid) * grid, cap)


def block(origin: Column, start: datetime, days: float) -> Column:
    """Calendar block of an origin, counted from `start`."""
    return F.floor(micros(at(start), origin) / F.lit(days * 86400e6)).cast("int")


def ratio(x: Column, y: Column) -> Column:
    """Null where the divisor is zero."""
    return x / F.nullif(y, F.lit(0))


def pct(n: Column, d: Column) -> Column:
    """Percentage, zero of nothing."""
    return F.when(d > 0, 100.0 * n / d).otherwise(F.lit(0.0))


def resource_kind(r: Column, placeholders: tuple[str, ...] = ("NONE", "NULL", "NA", ""), strip: bool = True, strict: bool = False) -> Column:
    """human, batch, none or other by prefix; `strip` trims before the prefix test, `strict` has no other."""
    own = F.trim(r) if strip else r
    low = F.lower(own)
    missing = r.isNull() | F.upper(F.trim(r)).isin(*placeholders)
    rest = F.lit("none") if strict else F.lit("other")
    return F.when(low.startswith("user"), "human").when(low.startswith("batch"), "batch").when(missing, "none").otherwise(rest)


def complete(lifecycle: Column) -> Column:
    return F.lower(F.trim(F.coalesce(lifecycle, F.lit("")))) == "complete"


def as_bool(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "1", "yes")


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts), F.lit("Q"), F.quarter(ts))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def jaccard(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    """Of two lists as sets; `empty` is the value for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / union)
