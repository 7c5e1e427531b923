"""Timestamp text and nanosecond epochs to TIMESTAMP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
          r"([zZ]|[+-]\d{2}:\d{2})?)?$")


def parse_ts(text: Column) -> Column:
    """A5: extended ISO text with or without offset, ``YYYYMMDD`` and
    ``YYYYMMDDTHHMMSS``; anything else is null."""
    s = F.trim(text)
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$",
                         "$1-$2-$3T$4:$5:$6")
    s = F.regexp_replace(s, "z$", "Z")
    return F.when(s.rlike(_SHAPE), s.try_cast("timestamp"))


def ns_to_ts(ns: Column, fallback: Column) -> Column:
    """A4: nanoseconds since the epoch, at microsecond resolution; zero, negative or
    missing values take ``fallback`` (the arrival time)."""
    n = F.coalesce(ns.try_cast("bigint"), F.lit(0))
    micros = F.call_function("div", n, F.lit(1000))
    return F.when(n > 0, F.timestamp_micros(micros)).otherwise(fallback)
