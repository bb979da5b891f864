"""Timestamp cascades: the first pattern that fits wins; what fits none is null. Times carry no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The patterns in order. Single letters take one digit or two; day-first comes before month-first.
GENERIC = [
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d",
    "d/M/yyyy H:m:s",
    "d/M/yyyy",
    "M/d/yyyy H:m:s",
    "M/d/yyyy",
    "d-M-yyyy",
]
OCEL = [
    "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
]


def _first(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in patterns])


def generic_timestamp(c: Column) -> Column:
    return _first(strip(c), GENERIC)


def ocel_timestamp(c: Column) -> Column:
    """An offset (a sign 6 or 5 characters from the end) is cut off and the local time kept; so a bare date, whose last
    "-" looks like one, is null."""
    c = strip(c)
    sign = lambda n: F.substring(c, -n, 1).isin("+", "-") & (F.length(c) >= n)
    cut = F.when(sign(6), F.substr(c, F.lit(1), F.length(c) - 6)).when(sign(5), F.substr(c, F.lit(1), F.length(c) - 5)).otherwise(c)
    return _first(cut, OCEL)
