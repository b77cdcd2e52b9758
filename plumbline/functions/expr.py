"""Column expressions shared by operators and queries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.constants import SENTINELS


def finite(c: Column) -> Column:
    """The value as double; NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def without_sentinels(c: Column) -> Column:
    """Null for missing markers, NaN and infinities."""
    d = finite(c)
    return F.when(~d.isin(*SENTINELS), d)


def decimal_year(t: Column) -> Column:
    """Year with the elapsed share of its days and hours, in doubles throughout."""
    y = F.year(t).cast("double")
    leap = (F.year(t) % 4 == 0) & ((F.year(t) % 100 != 0) | (F.year(t) % 400 == 0))
    days = F.when(leap, F.lit(366.0)).otherwise(F.lit(365.0))
    return y + (F.dayofyear(t).cast("double") - 1.0 + F.hour(t).cast("double") / 24.0) / days


def safe_name(c: Column) -> Column:
    """A file name from any text: other characters than word characters, dot and dash become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w.\-]+", "_"), r"^[_.]+|[_.]+$", ""), 1, 150)


def wrap_longitude(c: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(c + 180.0, F.lit(360.0)) - 180.0


def packed_dms(c: Column) -> Column:
    """Degrees from DDDMMMSSS.SS packed angles."""
    a = F.abs(c)
    d = F.floor(a / 1e6)
    m = F.floor((a - d * 1e6) / 1e3)
    return F.signum(c) * (d + m / 60.0 + (a - d * 1e6 - m * 1e3) / 3600.0)


def token_estimate(c: Column) -> Column:
    """Rough tokens of a text: a token for 3.5 characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3.5).cast("int"))


def human_size(c: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    k = c.cast("double")
    return (F.when(k < 1024, F.format_string("%.0f B", k)).when(k < 1024**2, F.format_string("%.1f KB", k / 1024)).when(k < 1024**3, F.format_string("%.1f MB", k / 1024**2)).otherwise(F.format_string("%.1f GB", k / 1024**3)))


def human_delta(seconds: float | None) -> str:
    """A time step in words."""
    if seconds is None or not math.isfinite(seconds) or seconds <= 0:
        return "irregular"
    for name, days in (("year", 365.25), ("month", 30.44), ("week", 7.0), ("day", 1.0)):
        n = seconds / 86400 / days
        if n >= 0.9 and abs(n - round(n)) <= 0.12 * max(1, round(n)) and round(n) >= 1:
            k = round(n)
            return f"1 {name}" if k == 1 else f"{k} {name}s"
    for name, unit in (("hour", 3600), ("minute", 60), ("second", 1)):
        if seconds >= 0.9 * unit:
            k = round(seconds / unit)
            return f"1 {name}" if k == 1 else f"{k} {name}s"
    return f"{seconds:g} seconds"
