"""Inputs of the registered queries, derived from the driver's tables.

Each derivation exists twice: as a Spark DataFrame (used by the queries) and
as DuckDB SQL text (used by the oracles), written to give identical rows. The
recipes follow the test-table mapping of the blueprint: pages become fetched
responses, failed fetches, a URL queue and a link tree; events become
spider-log messages and captures; conversation turns become body chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_fingerprint, url_host

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts_plus_seconds(col) -> "F.Column":
    return F.timestamp_add("SECOND", col, F.lit(EPOCH).cast("timestamp_ntz"))


# ---------------------------------------------------------------- responses
CONTENT_TYPES = ["text/html; charset=utf-8", "text/html", "application/xhtml+xml", "text/plain",
                 "TEXT/HTML ; x", "application/json", None, "image/png"]


def _case(col, values, default=None):
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        out = F.when(col == i, lit) if out is None else out.when(col == i, lit)
    return out


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched responses: one per page, with status, type, timing and hop metadata."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    hop_path = F.when(pid % 6 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.repeat(F.lit("L"), (pid % 3).cast("int")), F.when(pid % 2 == 1, F.lit("I")).otherwise(F.lit(""))))
    return p.select(
        pid, F.col("url"), F.col("html"),
        F.when(pid % 10 == 3, 404).when(pid % 10 == 7, 301).otherwise(200).cast("int").alias("status_code"),
        _case(pid % 8, CONTENT_TYPES).alias("content_type"),
        F.encode(F.col("html"), "UTF-8").alias("body"),
        _ts_plus_seconds(pid).alias("fetch_start"),
        ((pid % 7) * 437.5).cast("double").alias("duration_ms"),
        hop_path.alias("hop_path"),
        F.when(pid % 5 == 0, F.lit(None).cast("string")).when(pid % 5 == 1, F.lit("I")).otherwise(F.lit("L"))
        .alias("hop"),
        F.when(pid % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("http://via.example.com/"), (pid / 2).cast("bigint").cast("string"))).alias("via"),
        F.concat(F.lit("http://seed.example.com/"), (pid % 11).cast("string")).alias("source"),
        F.when(pid % 9 == 4, F.array(F.concat(F.lit("http://r1.example.com/"), pid.cast("string")),
                                     F.concat(F.lit("http://r2.example.com/"), pid.cast("string"))))
        .alias("redirect_urls"),
    )


RESPONSES_SQL = """
SELECT page_id, url, html,
  CAST(CASE WHEN page_id % 10 = 3 THEN 404 WHEN page_id % 10 = 7 THEN 301 ELSE 200 END AS INTEGER) AS status_code,
  CASE page_id % 8 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/html'
    WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'TEXT/HTML ; x'
    WHEN 5 THEN 'application/json' WHEN 6 THEN NULL ELSE 'image/png' END AS content_type,
  encode(html) AS body,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS fetch_start,
  CAST((page_id % 7) * 437.5 AS DOUBLE) AS duration_ms,
  CASE WHEN page_id % 6 = 0 THEN NULL
       ELSE repeat('L', CAST(page_id % 3 AS INTEGER)) || CASE WHEN page_id % 2 = 1 THEN 'I' ELSE '' END END AS hop_path,
  CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'I' ELSE 'L' END AS hop,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'http://via.example.com/' || CAST(page_id // 2 AS VARCHAR) END AS via,
  'http://seed.example.com/' || CAST(page_id % 11 AS VARCHAR) AS source,
  CASE WHEN page_id % 9 = 4 THEN ['http://r1.example.com/' || CAST(page_id AS VARCHAR),
                                  'http://r2.example.com/' || CAST(page_id AS VARCHAR)] END AS redirect_urls
FROM pages"""


# ------------------------------------------------------------------- errors
EXCEPTION_CLASSES = ["HttpError", "DNSLookupError", "TimeoutError", "TCPTimedOutError", "IgnoreRequest",
                     "ConnectionRefusedError"]


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed fetches: one per page, exception class by page id (one unknown class)."""
    r = responses(spark, sf_dir)
    pid = F.col("page_id")
    return r.select("page_id", "url", _case(pid % 6, EXCEPTION_CLASSES).alias("exception_class"),
                    "fetch_start", "hop_path", "hop", "via", "source", "redirect_urls")


ERRORS_SQL = f"""
SELECT page_id, url,
  CASE page_id % 6 WHEN 0 THEN 'HttpError' WHEN 1 THEN 'DNSLookupError' WHEN 2 THEN 'TimeoutError'
    WHEN 3 THEN 'TCPTimedOutError' WHEN 4 THEN 'IgnoreRequest' ELSE 'ConnectionRefusedError' END AS exception_class,
  fetch_start, hop_path, hop, via, source, redirect_urls
FROM ({RESPONSES_SQL})"""


# -------------------------------------------------------------------- queue
def queue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the frontier, one per page: score, creation time, depth."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    return p.select(
        pid, F.col("url"),
        url_fingerprint(F.col("url")).alias("fingerprint"),
        url_host(F.col("url")).alias("host"),
        ((pid * 37) % 101 / 100.0).cast("double").alias("score"),
        _ts_plus_seconds(pid).alias("created_at"),
        (pid % 4).cast("smallint").alias("depth"),
    )


def queue_requests_sql(sg) -> str:
    return f"""
SELECT page_id, url, {sg.url_fingerprint('url')} AS fingerprint, {sg.host('url')} AS host,
  CAST((page_id * 37) % 101 / 100.0 AS DOUBLE) AS score,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS created_at,
  CAST(page_id % 4 AS SMALLINT) AS depth
FROM pages"""


# ------------------------------------------------------------- link tree
TREE_HOPS = ["L", "E", "R"]


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary tree over pages: page i links to pages 2i+1 and 2i+2 (hop by i % 3)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    # equi-join on the child id (two candidate ids per parent), never a theta join
    par = p.select(F.col("page_id").alias("pid"), F.col("url").alias("parent_url"),
                   F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("cid"))
    child = p.select(F.col("page_id").alias("cid"), F.col("url").alias("child_url"))
    return par.join(child, "cid").select("parent_url", "child_url",
                                         _case(F.col("pid") % 3, TREE_HOPS).alias("hop"))


# ------------------------------------------------------------------- chunks
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body chunks: a conversation is one response, its turns arrive in order."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("seq"),
                    F.encode(F.col("text"), "UTF-8").alias("data"))


# ----------------------------------------------------------------- messages
# Events become spider-log messages: click -> page_crawled, view ->
# links_extracted, error -> request_error, signup -> update_score,
# purchase -> offset. Every 97th message is cut in half (undecodable).
EVENT_TYPE_MAP = [("click", "page_crawled"), ("view", "links_extracted"), ("error", "request_error"),
                  ("signup", "update_score"), ("purchase", "offset")]


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = None
    for src, dst in EVENT_TYPE_MAP:
        t = F.when(F.col("event_type") == src, F.lit(dst)) if t is None else t.when(F.col("event_type") == src, F.lit(dst))
    host = F.concat(F.lit("h"), (F.col("user_id") % 17).cast("string"), F.lit(".example.org"))
    url = F.concat(F.lit("http://"), host, F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/p"),
                   (F.col("event_id") % 7).cast("string"))
    return e.select("event_id", F.col("ts"), "user_id", t.alias("type"), host.alias("host"), url.alias("url"),
                    "value", "props")


EVENT_ROWS_SQL = """
SELECT event_id, ts, user_id,
  CASE event_type WHEN 'click' THEN 'page_crawled' WHEN 'view' THEN 'links_extracted'
    WHEN 'error' THEN 'request_error' WHEN 'signup' THEN 'update_score' WHEN 'purchase' THEN 'offset' END AS type,
  'h' || CAST(user_id % 17 AS VARCHAR) || '.example.org' AS host,
  'http://h' || CAST(user_id % 17 AS VARCHAR) || '.example.org/u/' || CAST(user_id AS VARCHAR) || '/p'
    || CAST(event_id % 7 AS VARCHAR) AS url,
  value, props
FROM events"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spider-log messages (key, value, partition, offset, timestamp, ts) built with the K4 encoder."""
    from ..streaming.spiderlog import domain_meta, encode_event, request_struct, spider_log_key
    r = event_rows(spark, sf_dir)
    hfp = F.sha1(F.col("host").cast("binary"))
    # links k = 0 .. event_id % 3; the third link carries no domain fingerprint
    ks = F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))
    links = F.transform(ks, lambda k: request_struct(
        F.concat(F.lit("http://h"), ((F.col("user_id") + k) % 17).cast("string"), F.lit(".example.org/l/"),
                 F.col("event_id").cast("string"), F.lit("/"), k.cast("string")),
        domain_meta(F.when(k < 2, F.sha1(F.concat(F.lit("h"), ((F.col("user_id") + k) % 17).cast("string"),
                                                  F.lit(".example.org")).cast("binary"))))))
    value = encode_event(
        F.col("type"), F.col("url"), hfp,
        status_code=F.when(F.floor("value") % 5 == 0, F.lit(500)).otherwise(F.lit(200)),
        body=F.base64(F.encode(F.col("props"), "UTF-8")),
        links=links,
        error=F.concat(F.lit("err"), (F.col("event_id") % 4).cast("string")),
        score=F.col("value") / 100.0,
        schedule=(F.col("event_id") % 2 == 0),
        partition_id=(F.col("user_id") % 2).cast("int"),
        offset=F.col("event_id"))
    cut = F.when(F.col("event_id") % 97 == 0, F.substr(value, F.lit(1), (F.length(value) / 2).cast("int"))) \
        .otherwise(value)
    return r.select(spider_log_key(F.col("type"), hfp).alias("key"), cut.cast("binary").alias("value"),
                    (F.col("user_id") % 2).cast("int").alias("partition"), F.col("event_id").alias("offset"),
                    F.col("ts").alias("ts"))


# -------------------------------------------------------------------- feeds
FEED_ROW_GROUP = 1 << 20
STAGED_ROW_GROUP = 8 << 20
FEED_FILES = 24  # a step's files, which 2, 3, 4, 6, 8, 12 or 24 cores share evenly


def feed_in_order(spark: SparkSession, df: DataFrame, order_col: str, parts: int, files: int = 1) -> str:
    """``df`` as a folder of files that arrive in order of ``order_col``, in ``parts`` steps (stands in for a live feed).

    A step is ``files`` files (fewer if it has hardly as many rows), written by as many tasks and of small row groups, so
    that the tasks of a micro-batch share it: Spark splits a file by its size and the cores, but each row group goes to
    one task. The steps' bounds come from ``order_col`` alone, so that ``df`` is computed once, by all of its tasks."""
    from ..session import scratch_path
    path, staged = scratch_path(spark, "feed"), scratch_path(spark, "feed-parts")
    kind = df.schema[order_col].dataType.simpleString()
    cuts = F.percentile_approx(order_col, [k / parts for k in range(1, parts)])
    bounds = df.select(order_col).agg(F.transform(cuts, lambda x: x.cast("string"))).first()[0] if parts > 1 else None
    step = F.lit(0)
    for b in bounds or []:
        step = step + F.when(F.col(order_col) > F.lit(b).cast(kind), 1).otherwise(0)
    steps = df.withColumn("_part", step)
    steps.write.partitionBy("_part").option("parquet.block.size", STAGED_ROW_GROUP).parquet(staged)
    for k in range(parts):  # each reads its own folder only
        part = spark.read.schema(steps.schema).parquet(staged).where(F.col("_part") == k).drop("_part")
        part = part.repartition(files) if files > 1 else part.coalesce(1)
        part.write.mode("append").option("parquet.block.size", FEED_ROW_GROUP).parquet(path)
    return path
