"""Crawl-log time formats (T17 and the log timestamp)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col_of

# The 20-digit fetch-start layout and the log timestamp layout.
FETCH_START_FORMAT = "yyyyMMddHHmmssSSSSSS"
LOG_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def format_log_ts(ts) -> Column:
    return F.date_format(col_of(ts), LOG_TS_FORMAT)


def format_fetch_time(fetch_start, duration_ms=None, compat: bool = False) -> Column:
    """``yyyyMMddHHmmssSSSSSS`` plus ``+<ms>`` when a duration is known.

    ``compat=True`` keeps only the sub-second part of the duration (the
    original log dropped whole seconds: 2.5 s became ``500.0``).
    The number is printed like a Python float: ``12.5``, ``2500.0``.
    """
    start = F.date_format(col_of(fetch_start), FETCH_START_FORMAT)
    if duration_ms is None:
        return F.coalesce(start, F.lit("-"))
    d = col_of(duration_ms).cast("double")
    if compat:
        d = F.pmod(d, F.lit(1000.0))
    ms = python_float_str(d)
    return (F.when(col_of(fetch_start).isNull(), F.lit("-"))
            .when(d.isNull(), start)
            .otherwise(F.concat(start, F.lit("+"), ms)))


def python_float_str(d: Column) -> Column:
    """Render a double the way ``str(float)`` does for ordinary magnitudes."""
    s = d.cast("string")
    return F.when(s.contains(".") | s.contains("E") | s.contains("N") | s.contains("I"), s).otherwise(
        F.concat(s, F.lit(".0")))


def parse_fetch_start(s) -> Column:
    """Inverse of the 20-digit layout; Spark cannot parse it with a pattern, so substr it."""
    c = col_of(s)
    secs = F.concat(F.substr(c, 13, 2), F.lit("."), F.substr(c, 15, 6)).cast("decimal(8,6)")
    return F.make_timestamp_ntz(F.substr(c, 1, 4).cast("int"), F.substr(c, 5, 2).cast("int"),
                                F.substr(c, 7, 2).cast("int"), F.substr(c, 9, 2).cast("int"),
                                F.substr(c, 11, 2).cast("int"), secs)
