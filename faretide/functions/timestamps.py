"""Instants, calendar days and display times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faretide import fixed_values as fv

_ZONE_SUFFIX = r"(Z|[+-]\d{2}:\d{2})$"


def utc_ts(col: Column) -> Column:
    """ISO-8601 text to an instant; text without a zone is UTC, bad text is null."""
    return normalize_ts(col, "UTC")


def normalize_ts(col: Column, naive_tz: str = "UTC") -> Column:
    """Mixed zoned and naive ISO-8601 text to an instant.

    Zone-less text is wall-clock time in ``naive_tz``. Unparsable text is null.
    Repeated wall-clock times take the earlier offset and skipped ones move
    forward, as in Spark's own conversions.
    """
    text = F.trim(col)
    wall = F.convert_timezone(F.lit(naive_tz), F.current_timezone(), text.try_cast("timestamp_ntz"))
    return F.when(text.rlike(_ZONE_SUFFIX), text.try_cast("timestamp")).otherwise(
        wall.cast("timestamp")
    )


def local_time(col: Column, tz: str = "UTC") -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of an instant in ``tz``."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), col.cast("timestamp_ntz"))


def obs_day(col: Column, tz: str = "UTC") -> Column:
    return F.to_date(local_time(col, tz))


def minute_text(col: Column, tz: str = "UTC") -> Column:
    return F.date_format(local_time(col, tz), fv.MINUTE_FORMAT)


def header_text(col: Column, tz: str = "UTC") -> Column:
    return F.date_format(local_time(col, tz), fv.HEADER_FORMAT)


def iso_text(col: Column, tz: str = "UTC") -> Column:
    return F.date_format(local_time(col, tz), fv.ISO_FORMAT)
