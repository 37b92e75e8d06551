"""Scalar expressions on power values. NULL, NaN and infinities are missing unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def safe_db(x: Column, floor: float = 1e-12) -> Column:
    """10 log10(max(x, floor)); NULL for NULL, NaN and -inf."""
    if floor <= 0:
        raise ValueError("the floor must be positive")
    x = x.cast("double")
    return F.when(~F.isnan(x) & (x != float("-inf")), 10 * F.log10(F.greatest(x, F.lit(floor))))


def stokes_i(p00: Column, p11: Column) -> Column:
    return 0.5 * (p00 + p11)


def stokes_iquv(p00: Column, p11: Column, mag: Column, phase: Column) -> dict[str, Column]:
    return {"i": 0.5 * (p00 + p11), "q": 0.5 * (p00 - p11), "u": mag * F.cos(phase), "v": mag * F.sin(phase)}


def magnitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def fraction_of(x: Column, i: Column, least: float = 1e-12) -> Column:
    """x / i where i is not about 0, else NULL."""
    return F.try_divide(x, F.when(F.abs(i) > least, i))


#: The days (UTC) that ended with a leap second after the base 2000-01-01 12:00.
LEAP_SECOND_DATES = ["2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01"]


def decode_leap_seconds(seconds: Column) -> Column:
    """Seconds since 2000-01-01 12:00 UTC, leap seconds not counted, as microseconds since 1970; each leap date passed adds one second."""
    naive = (F.lit(946_728_000_000_000) + F.round(seconds * 1e6)).cast("long")
    passed = sum((F.when(naive >= F.unix_micros(F.lit(f"{d} 00:00:00").cast("timestamp")), 1).otherwise(0) for d in LEAP_SECOND_DATES), F.lit(0))
    return naive + passed * 1_000_000
