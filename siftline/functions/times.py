"""Timestamp column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings, tried in this order.
ISO_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss"]
MONTH_FIRST_FORMATS = ["M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm"]
DAY_FIRST_FORMATS = ["d/M/yyyy h:mm:ss a", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm"]


def parse_mixed(text: Column, day_first: bool = False, strict: bool = False) -> Column:
    """Timestamp from mixed spellings, null where none fits.

    Ambiguous dates follow ``day_first``; unless ``strict``, a date that only
    reads the other way round is still accepted.
    """
    first, second = (DAY_FIRST_FORMATS, MONTH_FIRST_FORMATS) if day_first else (MONTH_FIRST_FORMATS, DAY_FIRST_FORMATS)
    formats = ISO_FORMATS + first + ([] if strict else second)
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in formats])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)
