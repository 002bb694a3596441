"""Crawl-log jobs: outcome rows for successes (T16) and errors (T15, T16e),
archive-style text lines (T18, T18b) and their parser, the all-outcomes log
and the items feed (J2), and wire size/digest from body chunks (A2).

Every job here is a projection or a union except A2, which hashes the sorted
chunks of a response batch by batch.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import col_of, once
from ..functions.digest import content_digest
from ..functions.timefmt import format_fetch_time, format_log_ts
from ..functions.urls import url_host

# Terminal status for a fetch that ended without a response,
# by exception class, first match wins.
ERROR_STATUS = [
    ("HttpError", -2),
    ("DNSLookupError", -1),
    ("TimeoutError", -4),
    ("TCPTimedOutError", -4),
    ("IgnoreRequest", -9998),
]

LOG_COLUMNS = ["timestamp", "status_code", "content_length", "url", "hop_path", "via", "mimetype",
               "thread", "start_time_plus_duration", "content_digest", "seed", "annotations"]
H3_FIELDS = 12
H3_LEGACY_FIELDS = 11


def mimetype_of(ct) -> Column:
    """Cut at the first ';' (no trim), '-' when absent."""
    return F.substring_index(F.coalesce(col_of(ct), F.lit("-")), ";", 1)


def error_status(exception_class) -> Column:
    """T15 as one CASE expression (null = unclassified)."""
    e = col_of(exception_class)
    out = None
    for name, code in ERROR_STATUS:
        out = (F.when(e == name, F.lit(code)) if out is None else out.when(e == name, F.lit(code)))
    return out.cast("int")


def classify_errors(errors: DataFrame, exc_col: str = "exception_class", strict: bool = False):
    """(classified, quarantine). Unclassified exceptions go to quarantine;
    with ``strict`` the job fails on the first one instead."""
    status = error_status(exc_col)
    if strict:
        status = F.coalesce(status, F.raise_error(F.concat(F.lit("Unknown exception type: "),
                                                           F.coalesce(F.col(exc_col), F.lit("null")))).cast("int"))
    df = errors.withColumn("status_code", status)
    return df.where(F.col("status_code").isNotNull()), df.where(F.col("status_code").isNull())


def _opt(df: DataFrame, name: str, default=None) -> Column:
    if name in df.columns:
        return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))
    return F.lit(default)


def to_crawl_log(responses: DataFrame, compat_duration: bool = False, keep=()) -> DataFrame:
    """One crawl-log row per response.

    The log timestamp is the end of the fetch (start + duration), which keeps
    rows reproducible; fetches without timing fall back to the start time.
    """
    r = responses
    start = F.col("fetch_start")
    dur = _opt(r, "duration_ms")
    finished = F.coalesce(F.timestamp_add("MICROSECOND", (dur * 1000).cast("bigint"), start), start)
    return r.select(
        *keep,
        finished.alias("timestamp"),
        F.col("status_code").cast("int").alias("status_code"),
        F.octet_length(F.col("body")).cast("bigint").alias("content_length"),
        F.col("url"),
        _opt(r, "hop_path", "").alias("hop_path"),
        _opt(r, "via", "-").alias("via"),
        F.coalesce(F.col("content_type"), F.lit("-")).alias("mimetype"),
        _opt(r, "thread", "-").alias("thread"),
        start.alias("fetch_start"),
        dur.cast("double").alias("duration_ms"),
        format_fetch_time(start, dur, compat=compat_duration).alias("start_time_plus_duration"),
        content_digest(F.col("body")).alias("content_digest"),
        _opt(r, "source", "-").alias("seed"),
        _opt(r, "annotations", "-").alias("annotations"),
        F.lit(None).cast("bigint").alias("size"),
        url_host(F.col("url")).alias("host"),
        F.lit(None).cast("string").alias("crawl_name"),
    )


def errors_to_crawl_log(errors: DataFrame, exc_col: str = "exception_class", strict: bool = False, keep=()):
    """T16e: crawl-log rows for fetches that failed; returns (log, quarantine)."""
    ok, bad = classify_errors(errors, exc_col, strict)
    start = F.col("fetch_start")
    log = ok.select(
        *keep,
        start.alias("timestamp"),
        F.col("status_code"),
        F.lit(0).cast("bigint").alias("content_length"),
        F.col("url"),
        _opt(ok, "hop_path", "").alias("hop_path"),
        _opt(ok, "via", "-").alias("via"),
        F.lit("-").alias("mimetype"),
        _opt(ok, "thread", "-").alias("thread"),
        start.alias("fetch_start"),
        F.lit(None).cast("double").alias("duration_ms"),
        format_fetch_time(start).alias("start_time_plus_duration"),
        _opt(ok, "content_digest", "-").alias("content_digest"),
        _opt(ok, "source", "-").alias("seed"),
        _opt(ok, "annotations", "-").alias("annotations"),
        F.lit(None).cast("bigint").alias("size"),
        url_host(F.col("url")).alias("host"),
        F.lit(None).cast("string").alias("crawl_name"),
    )
    return log, bad


def all_outcomes(success_log: DataFrame, error_log: DataFrame) -> DataFrame:
    """The crawl log holds every outcome: successes and errors."""
    return success_log.unionByName(error_log)


def items_feed(log: DataFrame) -> DataFrame:
    """Only responses that reached the spider (2xx, since errors are not allowed through)."""
    return log.where((F.col("status_code") >= 200) & (F.col("status_code") < 300))


def h3_line(log: DataFrame) -> Column:
    """12 single-space separated columns. ``concat_ws`` skips nulls, so coalesce first."""
    c = lambda name, d="-": F.coalesce(F.col(name).cast("string"), F.lit(d))
    return F.concat_ws(
        " ",
        F.coalesce(format_log_ts(F.col("timestamp")), F.lit("-")),
        c("status_code"), c("content_length", "0"), c("url"), c("hop_path", ""), c("via"),
        mimetype_of(F.col("mimetype")), c("thread"), c("start_time_plus_duration"),
        c("content_digest"), c("seed"), c("annotations"))


def h3_legacy_line(log: DataFrame) -> Column:
    """``ts sc url hop_path - ct - - - - -`` (11 columns)."""
    return F.concat_ws(
        " ",
        F.coalesce(format_log_ts(F.col("timestamp")), F.lit("-")),
        F.coalesce(F.col("status_code").cast("string"), F.lit("-")),
        F.col("url"), F.coalesce(F.col("hop_path"), F.lit("")), F.lit("-"),
        mimetype_of(F.col("mimetype")), F.lit("- - - - -"))


def to_h3_line(log: DataFrame, legacy: bool = False, keep=()) -> DataFrame:
    line = h3_legacy_line(log) if legacy else h3_line(log)
    return log.select(*keep, line.alias("line"))


def parse_h3_line(lines: DataFrame, line_col: str = "line"):
    """Inverse of T18: split on ONE space (an empty hop path leaves two in a row).

    Returns (good, bad): rows without exactly 12 columns, or with a time,
    status or size that is neither '-' nor readable, go to ``bad``. Times are
    read with and without fractional seconds (writers drop zero microseconds).
    """
    df = lines.select("*", once(F.split(F.col(line_col), " ", -1)).alias("_p"))
    g = lambda i: F.get("_p", F.lit(i - 1))
    time = F.when(g(1).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?$"), g(1).try_cast("timestamp_ntz"))
    number = lambda i, kind: F.when(g(i).rlike(r"^-?\d+$"), g(i).try_cast(kind))
    df = df.select("*", once(F.struct(time.alias("ts"), number(2, "int").alias("status"), number(3, "bigint").alias("size"))).alias("_v"))
    readable = [(1, "ts"), (2, "status"), (3, "size")]
    ok = F.size("_p") == H3_FIELDS
    for i, name in readable:
        ok = ok & ((g(i) == "-") | F.col(f"_v.{name}").isNotNull())
    ok = F.coalesce(ok, F.lit(False))
    bad = df.where(~ok).drop("_p", "_v")
    good = df.where(ok).select(
        *[c for c in lines.columns if c != line_col],
        F.col("_v.ts").alias("timestamp"), F.col("_v.status").alias("status_code"), F.col("_v.size").alias("content_length"),
        g(4).alias("url"), g(5).alias("hop_path"), g(6).alias("via"), g(7).alias("mimetype"),
        g(8).alias("thread"), g(9).alias("start_time_plus_duration"),
        g(10).alias("content_digest"), g(11).alias("seed"), g(12).alias("annotations"))
    return good, bad


def response_digest(chunks: DataFrame, key_col: str = "request_id", seq_col: str = "seq",
                    data_col: str = "data") -> DataFrame:
    """A2: per request, wire size (sum of chunk lengths) and base32 SHA-1 of the
    chunks concatenated in arrival order, for responses of any size.

    Chunks are dealt out by request and sorted inside their task; the hash runs
    over them one batch at a time, so a task holds a batch and one hash state
    however large a response is. Null chunks count as empty, equal positions
    are taken in order of their bytes.
    """
    rows = chunks.select(F.col(key_col).alias("key"), F.col(seq_col).alias("seq"),
                         F.coalesce(F.col(data_col).cast("binary"), F.lit(b"")).alias("data"))
    kind = rows.schema["key"].dataType.simpleString()

    def digest(batches):
        key, state, size, started = None, None, 0, False
        done = []

        def close():
            done.append((key, size, base64.b32encode(state.digest()).decode()))

        for batch in batches:
            keys, data = batch.column("key"), batch.column("data")
            for i, k in enumerate(keys.to_pylist()):
                if not started or k != key:
                    if started:
                        close()
                    key, state, size, started = k, hashlib.sha1(), 0, True
                piece = data[i].as_buffer()
                state.update(piece)
                size += piece.size
            if done:
                yield _digests(done, keys.type)
                done = []
        if started:
            close()
            yield _digests(done, keys.type)

    return (rows.repartition("key").sortWithinPartitions("key", "seq", "data")
            .mapInArrow(digest, f"key {kind}, response_bytes bigint, response_digest string")
            .withColumnRenamed("key", key_col))


def _digests(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], key_type), pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.string())], names=["key", "response_bytes", "response_digest"])
