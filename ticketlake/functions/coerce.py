"""Lenient conversions: a value that does not parse becomes null or the stated default, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def flag_or_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("boolean").cast("double")


def flag_or_zero(c: Column | str) -> Column:
    return F.coalesce(flag_or_null(c), F.lit(0.0))


def number_or_zero(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def wall_clock(c: Column | str) -> Column:
    """Timestamp as written: a zone suffix is dropped, not applied."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("timestamp_ntz")


def wall_clock_day(c: Column | str) -> Column:
    return F.to_date(wall_clock(c))


def instant(c: Column | str) -> Column:
    """Timestamp as a point in time: a zone suffix is applied."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("timestamp")


def finite_or_null(c: Column | str) -> Column:
    """Not-a-number and infinities become null, as a JSON report requires."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def seeded_hash(seed: int | str, *cols: Column | str) -> Column:
    """Hex digest of seed and key: a reproducible random order that any SQL engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def unit_interval(digest: Column) -> Column:
    """First 32 bits of a hex digest as a fraction in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
