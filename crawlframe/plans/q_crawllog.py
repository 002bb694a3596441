"""Queries for the crawl-log jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digest import content_digest
from ..functions.timefmt import format_fetch_time, format_log_ts
from ..operators import crawllog as C
from ..operators import discovery as D
from ..sinks.files import crawl_log_partitions, items_json
from . import inputs as I
from . import sqlgen as sg
from .catalog import register

R = I.RESPONSES_SQL
E = I.ERRORS_SQL

# T12 in SQL, on any relation with hop_path, hop, via, redirect_urls
_STEP = """
CASE WHEN hop_path IS NULL THEN ''
     WHEN redirect_urls IS NOT NULL AND len(redirect_urls) > 0 THEN hop_path || 'R'
     ELSE hop_path || coalesce(hop, 'L') END AS hop_path,
CASE WHEN hop_path IS NOT NULL AND redirect_urls IS NOT NULL AND len(redirect_urls) > 0
     THEN redirect_urls[1] ELSE via END AS via"""
STEPPED = f"SELECT * EXCLUDE (hop_path, via), {_STEP} FROM ({R})"
ERR_STEPPED = f"SELECT * EXCLUDE (hop_path, via), {_STEP} FROM ({E})"


def _pyfloat(x: str) -> str:
    return f"(CASE WHEN contains(CAST({x} AS VARCHAR), '.') THEN CAST({x} AS VARCHAR) ELSE CAST({x} AS VARCHAR) || '.0' END)"


def _stpd(start: str, dur: str | None, compat: bool = False) -> str:
    s = f"strftime({start}, '%Y%m%d%H%M%S%f')"
    if dur is None:
        return f"coalesce({s}, '-')"
    d = f"(({dur}) % 1000.0)" if compat else dur
    return f"(CASE WHEN {start} IS NULL THEN '-' WHEN {dur} IS NULL THEN {s} ELSE {s} || '+' || {_pyfloat(d)} END)"


_LOG_TS = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f')"

SUCCESS_LOG = f"""
SELECT page_id,
  fetch_start + to_microseconds(CAST(duration_ms * 1000 AS BIGINT)) AS timestamp,
  status_code, CAST(octet_length(body) AS BIGINT) AS content_length, url,
  coalesce(hop_path, '') AS hop_path, coalesce(via, '-') AS via, coalesce(content_type, '-') AS mimetype,
  '-' AS thread, {_stpd('fetch_start', 'duration_ms')} AS start_time_plus_duration,
  {sg.base32_sha1('body')} AS content_digest, coalesce(source, '-') AS seed, '-' AS annotations,
  {sg.host('url')} AS host
FROM ({STEPPED})"""

_ERR_STATUS = " ".join(f"WHEN {sg.q(n)} THEN {c}" for n, c in C.ERROR_STATUS)
ERROR_LOG = f"""
SELECT page_id, fetch_start AS timestamp, CAST(CASE exception_class {_ERR_STATUS} END AS INTEGER) AS status_code,
  CAST(0 AS BIGINT) AS content_length, url, coalesce(hop_path, '') AS hop_path, coalesce(via, '-') AS via,
  '-' AS mimetype, '-' AS thread, {_stpd('fetch_start', None)} AS start_time_plus_duration,
  '-' AS content_digest, coalesce(source, '-') AS seed, '-' AS annotations, {sg.host('url')} AS host
FROM ({ERR_STEPPED})
WHERE exception_class IN ({', '.join(sg.q(n) for n, _ in C.ERROR_STATUS)})"""

LOG_COLS = ["page_id", "timestamp", "status_code", "content_length", "url", "hop_path", "via", "mimetype",
            "thread", "start_time_plus_duration", "content_digest", "seed", "annotations", "host"]


@register("t12_hop_step", f"SELECT page_id, hop_path, via FROM ({STEPPED})")
def t12_hop_step(spark, sf_dir):
    return D.extend_hop_path(I.responses(spark, sf_dir)).select("page_id", "hop_path", "via")


@register("t14_content_digest", f"SELECT page_id, {sg.base32_sha1('html')} AS content_digest FROM pages")
def t14_content_digest(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", content_digest(F.col("html")).alias("content_digest"))


@register("t15_classify_errors", f"""
SELECT page_id, exception_class, CAST(CASE exception_class {_ERR_STATUS} END AS INTEGER) AS status_code
FROM ({E}) WHERE exception_class IN ({', '.join(sg.q(n) for n, _ in C.ERROR_STATUS)})""")
def t15_classify_errors(spark, sf_dir):
    ok, _ = C.classify_errors(I.errors(spark, sf_dir))
    return ok.select("page_id", "exception_class", "status_code")


@register("t15_quarantine", f"""
SELECT page_id, exception_class FROM ({E})
WHERE exception_class NOT IN ({', '.join(sg.q(n) for n, _ in C.ERROR_STATUS)})""")
def t15_quarantine(spark, sf_dir):
    _, bad = C.classify_errors(I.errors(spark, sf_dir))
    return bad.select("page_id", "exception_class")


def crawl_log_success(spark, sf_dir):
    return C.to_crawl_log(D.extend_hop_path(I.responses(spark, sf_dir)), keep=["page_id"])


def crawl_log_errors(spark, sf_dir):
    log, _ = C.errors_to_crawl_log(D.extend_hop_path(I.errors(spark, sf_dir)), keep=["page_id"])
    return log


@register("t16_crawl_log", f"SELECT {', '.join(LOG_COLS)} FROM ({SUCCESS_LOG})")
def t16_crawl_log(spark, sf_dir):
    return crawl_log_success(spark, sf_dir).select(*LOG_COLS)


@register("t16e_error_log", f"SELECT {', '.join(LOG_COLS)} FROM ({ERROR_LOG})")
def t16e_error_log(spark, sf_dir):
    return crawl_log_errors(spark, sf_dir).select(*LOG_COLS)


@register("t17_fetch_time", f"""
SELECT page_id, {_stpd('fetch_start', 'duration_ms')} AS start_time_plus_duration,
       {_stpd('fetch_start', 'duration_ms', compat=True)} AS start_time_plus_duration_compat
FROM ({R})""")
def t17_fetch_time(spark, sf_dir):
    r = I.responses(spark, sf_dir)
    return r.select("page_id",
                    format_fetch_time("fetch_start", "duration_ms").alias("start_time_plus_duration"),
                    format_fetch_time("fetch_start", "duration_ms", compat=True)
                    .alias("start_time_plus_duration_compat"))


_H3 = (f"concat_ws(' ', {_LOG_TS}, CAST(status_code AS VARCHAR), CAST(content_length AS VARCHAR), url, hop_path, via, "
       f"split_part(mimetype, ';', 1), thread, start_time_plus_duration, content_digest, seed, annotations)")
_H3_LEGACY = (f"concat_ws(' ', {_LOG_TS}, CAST(status_code AS VARCHAR), url, hop_path, '-', "
              f"split_part(mimetype, ';', 1), '- - - - -')")
ALL_LOG = f"""
SELECT * FROM ({SUCCESS_LOG}) WHERE page_id % 3 <> 0
UNION ALL
SELECT * FROM ({ERROR_LOG}) WHERE page_id % 3 = 0"""


def all_outcomes_log(spark, sf_dir):
    """J2 input: pages with id % 3 = 0 failed, the others got a response."""
    ok = crawl_log_success(spark, sf_dir).where(F.col("page_id") % 3 != 0)
    err = crawl_log_errors(spark, sf_dir).where(F.col("page_id") % 3 == 0)
    return C.all_outcomes(ok, err)


@register("t18_h3_lines", f"SELECT page_id, {_H3} AS line FROM ({ALL_LOG})")
def t18_h3_lines(spark, sf_dir):
    return C.to_h3_line(all_outcomes_log(spark, sf_dir), keep=["page_id"])


@register("t18b_h3_legacy_lines", f"SELECT page_id, {_H3_LEGACY} AS line FROM ({ALL_LOG})")
def t18b_h3_legacy_lines(spark, sf_dir):
    return C.to_h3_line(all_outcomes_log(spark, sf_dir), legacy=True, keep=["page_id"])


@register("t18_parse_h3", f"""
SELECT page_id, url, status_code, hop_path, content_digest FROM ({ALL_LOG})
WHERE len(string_split({_H3}, ' ')) = 12""")
def t18_parse_h3(spark, sf_dir):
    lines = C.to_h3_line(all_outcomes_log(spark, sf_dir), keep=["page_id"])
    good, _ = C.parse_h3_line(lines)
    return good.select("page_id", "url", "status_code", "hop_path", "content_digest")


@register("t18_bad_h3", f"""
SELECT page_id, {_H3} AS line FROM ({ALL_LOG}) WHERE len(string_split({_H3}, ' ')) <> 12""")
def t18_bad_h3(spark, sf_dir):
    lines = C.to_h3_line(all_outcomes_log(spark, sf_dir), keep=["page_id"])
    _, bad = C.parse_h3_line(lines)
    return bad


# The lines as a careless writer leaves them: every 5th without fraction of a second, every 7th with a status that is no
# number, every 11th with an impossible date, every 13th cut short.
_ODD_KIND = """CASE WHEN page_id % 13 = 0 THEN 'cut' WHEN page_id % 11 = 0 THEN 'date' WHEN page_id % 7 = 0 THEN 'status'
     WHEN page_id % 5 = 0 THEN 'second' ELSE 'plain' END"""


def _odd_lines(spark, sf_dir):
    line, kind = F.col("line"), F.expr(_ODD_KIND)
    odd = (F.when(kind == "cut", F.substring_index(line, " ", 5))
           .when(kind == "date", F.concat(F.lit("2024-02-31T00:00:00.000000"), F.substr(line, F.instr(line, " "))))
           .when(kind == "status", F.regexp_replace(line, r"^(\S+) (\S+)", r"$1 2x$2"))
           .when(kind == "second", F.regexp_replace(line, r"^([^ .]+)\.\d+", "$1")).otherwise(line))
    return C.to_h3_line(all_outcomes_log(spark, sf_dir), keep=["page_id"]).withColumn("line", odd)


@register("t18_parse_odd_lines", f"""
SELECT page_id, CASE WHEN {_ODD_KIND} = 'second' THEN date_trunc('second', timestamp) ELSE timestamp END AS timestamp,
       status_code, CAST(content_length AS BIGINT) AS content_length
FROM ({ALL_LOG}) WHERE {_ODD_KIND} IN ('plain', 'second') AND len(string_split({_H3}, ' ')) = 12""")
def t18_parse_odd_lines(spark, sf_dir):
    return C.parse_h3_line(_odd_lines(spark, sf_dir))[0].select("page_id", "timestamp", "status_code", "content_length")


@register("t18_bad_odd_lines", f"""
SELECT page_id, {_ODD_KIND} AS kind FROM ({ALL_LOG})
WHERE {_ODD_KIND} IN ('cut', 'date', 'status') OR len(string_split({_H3}, ' ')) <> 12""")
def t18_bad_odd_lines(spark, sf_dir):
    return C.parse_h3_line(_odd_lines(spark, sf_dir))[1].select("page_id", F.expr(_ODD_KIND).alias("kind"))


@register("j2_all_outcomes", f"SELECT {', '.join(LOG_COLS)} FROM ({ALL_LOG})")
def j2_all_outcomes(spark, sf_dir):
    return all_outcomes_log(spark, sf_dir).select(*LOG_COLS)


@register("j2_items_feed", f"SELECT {', '.join(LOG_COLS)} FROM ({ALL_LOG}) WHERE status_code >= 200 AND status_code < 300")
def j2_items_feed(spark, sf_dir):
    return C.items_feed(all_outcomes_log(spark, sf_dir)).select(*LOG_COLS)


@register("a2_response_digest", f"""
SELECT conv_id AS request_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS response_bytes,
       {sg.base32_sha1("string_agg(text, '' ORDER BY turn)")} AS response_digest
FROM conversations GROUP BY conv_id""")
def a2_response_digest(spark, sf_dir):
    return C.response_digest(I.chunks(spark, sf_dir))


@register("k1_crawl_log_lines", f"""
SELECT CAST(timestamp AS DATE) AS log_date, {_H3} AS line FROM ({ALL_LOG})""")
def k1_crawl_log_lines(spark, sf_dir):
    """What the daily-rolled text sink writes: (log_date, line)."""
    return crawl_log_partitions(all_outcomes_log(spark, sf_dir))


@register("k1_written_log", f"""
SELECT CAST(timestamp AS DATE) AS log_date, {_H3} AS line FROM ({ALL_LOG})""")
def k1_written_log(spark, sf_dir):
    """The files that the sink wrote, read back."""
    from ..session import scratch_path
    from ..sinks.files import write_crawl_log
    path = scratch_path(spark, "crawl-log")
    write_crawl_log(all_outcomes_log(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("log_date").cast("date").alias("log_date"), F.col("value").alias("line"))


@register("k1_streamed_log", f"""
SELECT CAST(timestamp AS DATE) AS log_date, {_H3} AS line FROM ({ALL_LOG})""")
def k1_streamed_log(spark, sf_dir):
    """The files that the streaming sink wrote in three micro-batches, stopped and started again in between."""
    from ..session import scratch_path
    from ..sinks.files import write_crawl_log_stream
    path, ckpt = scratch_path(spark, "crawl-log"), scratch_path(spark, "crawl-log-ckpt")
    log = all_outcomes_log(spark, sf_dir)
    feed = I.feed_in_order(spark, log, "timestamp", 3, I.FEED_FILES)
    for most in (I.FEED_FILES, None):  # one step, then, by a new query on the same checkpoint, the rest
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", most or 100 * I.FEED_FILES).parquet(feed)
        query = write_crawl_log_stream(stream, path, ckpt, {"once": True} if most else None)
        query.awaitTermination()
    return spark.read.text(path).select(F.col("log_date").cast("date").alias("log_date"), F.col("value").alias("line"))


def _item_json_sql() -> str:
    from ..sinks.files import ITEM_LINE_ORDER, NUMERIC_FIELDS
    parts = []
    for i, n in enumerate(ITEM_LINE_ORDER):
        v = (sg.json_string(_LOG_TS) if n == "timestamp" else
             sg.json_number(n) if n in NUMERIC_FIELDS else sg.json_string(n))
        parts.append(sg.q(("{" if i == 0 else ", ") + '"' + n + '": ') + " || " + v)
    return " || ".join(parts) + " || '}'"


_ITEM_JSON = _item_json_sql()


@register("k2_items_jsonl", f"""
SELECT page_id, {_ITEM_JSON} AS json FROM ({ALL_LOG}) WHERE status_code >= 200 AND status_code < 300""")
def k2_items_jsonl(spark, sf_dir):
    items = C.items_feed(all_outcomes_log(spark, sf_dir))
    return items.select("page_id", items_json(items).alias("json"))
