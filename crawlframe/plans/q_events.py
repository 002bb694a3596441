"""Queries for the spider-log event jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import url_fingerprint
from ..operators import frontier as Q
from ..streaming import spiderlog as S
from . import inputs as I
from . import sqlgen as sg
from .catalog import register

GOOD = f"SELECT * FROM ({I.EVENT_ROWS_SQL}) WHERE event_id % 97 <> 0"
# links of links_extracted events, k = 0 .. event_id % 3 (the third has no fingerprint)
LINKS_SQL = f"""
SELECT event_id, ts, url AS source_url, CAST(k AS INTEGER) AS pos,
       'http://h' || CAST((user_id + k) % 17 AS VARCHAR) || '.example.org/l/' || CAST(event_id AS VARCHAR)
         || '/' || CAST(k AS VARCHAR) AS url,
       CASE WHEN k < 2 THEN sha1('h' || CAST((user_id + k) % 17 AS VARCHAR) || '.example.org') END AS host_fp
FROM ({GOOD}) CROSS JOIN LATERAL (SELECT unnest(range(0, event_id % 3 + 1)) AS k)
WHERE type = 'links_extracted'"""


def decoded(spark, sf_dir):
    good, _ = S.decode_spider_log(I.messages(spark, sf_dir))
    return good


@register("k4_spider_log_keys", f"""
SELECT event_id AS offset, CASE WHEN type = 'offset' THEN {sg.q(S.OFFSET_KEY)} ELSE sha1(host) END AS key_text,
       CAST(user_id % 2 AS INTEGER) AS partition
FROM ({I.EVENT_ROWS_SQL})""")
def k4_spider_log_keys(spark, sf_dir):
    m = I.messages(spark, sf_dir)
    return m.select("offset", F.col("key").cast("string").alias("key_text"), "partition")


@register("e1_decode_events", f"""
SELECT event_id AS offset, type,
  CASE WHEN type <> 'offset' THEN url END AS url,
  CASE WHEN type <> 'offset' THEN sha1(host) END AS host_fp,
  CASE WHEN type = 'page_crawled' THEN CAST(CASE WHEN CAST(floor(value) AS BIGINT) % 5 = 0 THEN 500 ELSE 200 END AS INTEGER) END AS status_code,
  CASE WHEN type = 'page_crawled' THEN props END AS body_text,
  CASE WHEN type = 'links_extracted' THEN CAST(event_id % 3 + 1 AS INTEGER) END AS n_links,
  CASE WHEN type = 'request_error' THEN 'err' || CAST(event_id % 4 AS VARCHAR) END AS error,
  CASE WHEN type = 'update_score' THEN value / 100.0 END AS score,
  CASE WHEN type = 'update_score' THEN event_id % 2 = 0 END AS schedule,
  CASE WHEN type = 'offset' THEN CAST(user_id % 2 AS INTEGER) END AS partition_id,
  CASE WHEN type = 'offset' THEN event_id END AS event_offset
FROM ({GOOD})""")
def e1_decode_events(spark, sf_dir):
    d = decoded(spark, sf_dir)
    return d.select("offset", "type", "url", F.col("meta.domain.fingerprint").alias("host_fp"), "status_code",
                    F.col("body").cast("string").alias("body_text"), F.size("links").cast("int").alias("n_links"),
                    "error", "score", "schedule", "partition_id", "event_offset") \
        .withColumn("n_links", F.when(F.col("type") == "links_extracted", F.col("n_links")))


@register("e2_bad_messages", f"""
SELECT event_id AS offset, 'undecodable' AS reason FROM events WHERE event_id % 97 = 0""")
def e2_bad_messages(spark, sf_dir):
    _, bad = S.decode_spider_log(I.messages(spark, sf_dir))
    return bad.select("offset", "reason")


@register("e4_request_errors", f"""
SELECT event_id AS offset, url, 'err' || CAST(event_id % 4 AS VARCHAR) AS error
FROM ({GOOD}) WHERE type = 'request_error'""")
def e4_request_errors(spark, sf_dir):
    return S.decode_events(I.messages(spark, sf_dir), "request_error").select("offset", "url", "error")


@register("e4_update_scores", f"""
SELECT event_id AS offset, url, value / 100.0 AS score, event_id % 2 = 0 AS schedule
FROM ({GOOD}) WHERE type = 'update_score'""")
def e4_update_scores(spark, sf_dir):
    return S.decode_events(I.messages(spark, sf_dir), "update_score").select("offset", "url", "score", "schedule")


@register("e4_offsets", f"""
SELECT event_id AS offset, CAST(user_id % 2 AS INTEGER) AS partition_id, event_id AS event_offset
FROM ({GOOD}) WHERE type = 'offset'""")
def e4_offsets(spark, sf_dir):
    return S.decode_events(I.messages(spark, sf_dir), "offset").select("offset", "partition_id", "event_offset")


# Messages of every kind with odd parts: extra meta keys, ids as text, stats events, bodies that are no base64 (every
# 13th crawl), ids that are no numbers (every 11th job id) and unknown types (every 17th view).
_ODD_KIND = {"click": "page_crawled", "view": "links_extracted", "error": "new_job_id", "signup": "stats", "purchase": "offset"}
_ODD_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ODD_KIND.items()) + " END"
ODD_SQL = f"""
SELECT event_id, ts, user_id, {_ODD_CASE} AS type,
       CASE WHEN event_type = 'click' AND event_id % 13 = 0 THEN 'undecodable body'
            WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'id is no number'
            WHEN event_type = 'view' AND event_id % 17 = 0 THEN 'unknown type' END AS reason
FROM events"""


def odd_messages(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    meta = text('"meta":{"depth":2,"redirect_urls":["http://r', u, '/",{"k":', i, '}],"own key":"v', i, '"}')
    body = F.when(F.col("event_id") % 13 == 0, F.lit("Y")).otherwise(F.base64(F.encode(i, "UTF-8")))
    job = F.when(F.col("event_id") % 11 == 0, F.lit('"seven"')).when(F.col("event_id") % 2 == 0, text('"', i, '"')).otherwise(i)
    kind = F.when(F.col("event_id") % 17 == 0, F.lit("links_lost")).otherwise(F.lit("links_extracted"))
    t = F.col("event_type")
    value = (F.when(t == "click", text('{"type":"page_crawled","r":{"url":"http://h', u, '/","status_code":200,"body":"', body, '",', meta, "}}"))
             .when(t == "view", text('{"type":"', kind, '","r":{"url":"http://h', u, '/","method":"GET",', meta,
                                     '},"links":[{"url":"http://l', i, '/","method":"GET"}]}'))
             .when(t == "error", text('{"type":"new_job_id","job_id":', job, "}"))
             .when(t == "signup", text('{"type":"stats","stats":{"pages":', u, ',"rate":"', i, '.5","note":"n","deep":{"a":', i, "}}}"))
             .when(t == "purchase", text('{"type":"offset","partition_id":"', (F.col("user_id") % 2).cast("string"), '","offset":', i, "}")))
    return e.select(value.cast("binary").alias("value"), F.col("event_id").alias("offset"), "ts")


def _odd(spark, sf_dir):
    return S.decode_spider_log(odd_messages(spark, sf_dir))


@register("e1_odd_messages", f"""
SELECT event_id AS offset, type, CASE WHEN type IN ('page_crawled', 'links_extracted') THEN 'v' || event_id END AS own_key,
       CASE WHEN type IN ('page_crawled', 'links_extracted') THEN event_id END AS nested,
       CASE WHEN type = 'page_crawled' THEN CAST(event_id AS VARCHAR) END AS body_text,
       CASE WHEN type = 'new_job_id' THEN event_id END AS job_id, CASE WHEN type = 'offset' THEN event_id END AS event_offset
FROM ({ODD_SQL}) WHERE reason IS NULL""")
def e1_odd_messages(spark, sf_dir):
    good, _ = _odd(spark, sf_dir)
    return good.select("offset", "type", F.variant_get("meta_all", "$['own key']", "string").alias("own_key"),
                       F.variant_get("meta_all", "$.redirect_urls[1].k", "bigint").alias("nested"),
                       F.col("body").cast("string").alias("body_text"), "job_id", "event_offset")


@register("e2_odd_messages_bad", f"SELECT event_id AS offset, reason FROM ({ODD_SQL}) WHERE reason IS NOT NULL")
def e2_odd_messages_bad(spark, sf_dir):
    return _odd(spark, sf_dir)[1].select("offset", "reason")


@register("e4_page_crawled", f"""
SELECT event_id AS offset, 'http://h' || user_id || '/' AS url, CAST(200 AS INTEGER) AS status_code, CAST(event_id AS VARCHAR) AS body_text,
       'http://r' || user_id || '/' AS redirect
FROM ({ODD_SQL}) WHERE type = 'page_crawled' AND reason IS NULL""")
def e4_page_crawled(spark, sf_dir):
    v = S.events_of(_odd(spark, sf_dir)[0], "page_crawled")
    return v.select("offset", "url", "status_code", F.col("body").cast("string").alias("body_text"),
                    F.variant_get("meta_all", "$.redirect_urls[0]", "string").alias("redirect"))


@register("e4_links_extracted", f"""
SELECT event_id AS offset, 'http://h' || user_id || '/' AS url, 'GET' AS method, CAST(2 AS INTEGER) AS depth, 'http://l' || event_id || '/' AS first_link
FROM ({ODD_SQL}) WHERE type = 'links_extracted' AND reason IS NULL""")
def e4_links_extracted(spark, sf_dir):
    v = S.events_of(_odd(spark, sf_dir)[0], "links_extracted")
    return v.select("offset", "url", "method", "meta.depth", F.col("links")[0]["url"].alias("first_link"))


@register("e4_new_job_ids", f"SELECT event_id AS offset, event_id AS job_id FROM ({ODD_SQL}) WHERE type = 'new_job_id' AND reason IS NULL")
def e4_new_job_ids(spark, sf_dir):
    return S.events_of(_odd(spark, sf_dir)[0], "new_job_id").select("offset", "job_id")


@register("e4_stats", f"""
SELECT event_id AS offset, CAST(user_id AS VARCHAR) AS pages, event_id AS deep FROM ({ODD_SQL}) WHERE type = 'stats'""")
def e4_stats(spark, sf_dir):
    v = S.events_of(_odd(spark, sf_dir)[0], "stats")
    return v.select("offset", F.col("stats")["pages"].alias("pages"), F.variant_get("stats_all", "$.deep.a", "bigint").alias("deep"))


@register("e3_strict_events", f"SELECT type, count(*) AS n FROM ({GOOD}) GROUP BY type")
def e3_strict_events(spark, sf_dir):
    """Strict decoding of messages whose types are all known: nothing fails, undecodable ones are still set aside."""
    good, _ = S.decode_spider_log(I.messages(spark, sf_dir), strict=True)
    return good.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register("a4_carried_stats", f"""
WITH s AS (SELECT event_id, ts, CAST(user_id AS DOUBLE) AS pages, event_id + 0.5 AS rate FROM ({ODD_SQL}) WHERE type = 'stats')
SELECT 'pages' AS name, count(*) AS n_events, sum(pages) AS total, arg_max(pages, (ts, pages)) AS latest FROM s
UNION ALL SELECT 'rate', count(*), CAST(sum(rate) AS DOUBLE), CAST(arg_max(rate, (ts, rate)) AS DOUBLE) FROM s
UNION ALL SELECT n, count(*), NULL, NULL FROM s, (VALUES ('note'), ('deep')) AS v(n) GROUP BY n""")
def a4_carried_stats(spark, sf_dir):
    return S.carried_stats(_odd(spark, sf_dir)[0])


# Bare requests on the feed: the request part of every message, every 97th cut.
def _request_feed(spark, sf_dir):
    r = I.event_rows(spark, sf_dir)
    req = F.to_json(S.request_struct(F.col("url"), S.domain_meta(F.sha1(F.col("host").cast("binary")))))
    cut = F.when(F.col("event_id") % 97 == 0, F.substr(req, F.lit(1), (F.length(req) / 2).cast("int"))).otherwise(req)
    return S.decode_requests(r.select(F.col("event_id").alias("offset"), cut.cast("binary").alias("value")))


@register("e5_decode_requests", f"SELECT event_id AS offset, url, 'GET' AS method FROM ({GOOD})")
def e5_decode_requests(spark, sf_dir):
    return _request_feed(spark, sf_dir)[0].select("offset", "url", "method")


@register("e5_bad_requests", "SELECT event_id AS offset FROM events WHERE event_id % 97 = 0")
def e5_bad_requests(spark, sf_dir):
    return _request_feed(spark, sf_dir)[1].select("offset")


@register("e6_links_of", f"SELECT event_id AS offset, source_url, pos, url, host_fp FROM ({LINKS_SQL})")
def e6_links_of(spark, sf_dir):
    return S.links_of(decoded(spark, sf_dir)).select("offset", "source_url", "pos", "url", "host_fp")


@register("a1_links_per_host", f"""
SELECT event_id AS offset, source_url, host_fp, count(*) AS n_links, string_agg(url, chr(10) ORDER BY pos) AS links
FROM ({LINKS_SQL}) WHERE host_fp IS NOT NULL GROUP BY event_id, source_url, host_fp""")
def a1_links_per_host(spark, sf_dir):
    links = S.links_of(decoded(spark, sf_dir))
    g = Q.links_per_host(links.withColumn("source", F.struct("offset", "source_url")), source_col="source")
    return g.select(F.col("source.offset").alias("offset"), F.col("source.source_url").alias("source_url"),
                    "host_fp", "n_links",
                    F.array_join(F.transform("links", lambda x: x["url"]), "\n").alias("links"))


@register("a3_latest_offsets", f"""
SELECT CAST(user_id % 2 AS INTEGER) AS partition_id, arg_max(event_id, (ts, event_id)) AS offset, max(ts) AS ts
FROM ({GOOD}) WHERE type = 'offset' GROUP BY user_id % 2""")
def a3_latest_offsets(spark, sf_dir):
    off = S.decode_events(I.messages(spark, sf_dir), "offset").select("partition_id", F.col("event_offset").alias("offset"),
                                                                 "ts")
    return Q.latest_offsets(off)


A4_SQL = f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       type, count(*) AS n_events
FROM ({GOOD}) GROUP BY 1, 2, 3"""


@register("a4_crawl_stats", A4_SQL)
def a4_crawl_stats(spark, sf_dir):
    return S.crawl_stats(decoded(spark, sf_dir), "1 hour")


# Domain metadata: per host fingerprint, the last crawled URL and its status.
@register("a5_domain_metadata", f"""
SELECT sha1(host) AS key, arg_max(url, (ts, event_id)) AS last_url,
       arg_max(CAST(CASE WHEN CAST(floor(value) AS BIGINT) % 5 = 0 THEN 500 ELSE 200 END AS INTEGER), (ts, event_id)) AS last_status
FROM ({GOOD}) WHERE type = 'page_crawled' GROUP BY sha1(host)""")
def a5_domain_metadata(spark, sf_dir):
    pc = S.events_of(decoded(spark, sf_dir), "page_crawled")
    rows = pc.select(F.col("meta.domain.fingerprint").alias("key"), F.col("url").alias("last_url"),
                     F.col("status_code").alias("last_status"), F.struct("ts", "offset").alias("_t"))
    return Q.domain_metadata(rows, "key", ("last_url", "last_status"), "_t")


def _fp(col):
    return url_fingerprint(F.col(col))


def _event_tables(spark, sf_dir):
    d = decoded(spark, sf_dir)
    links = S.links_of(d).select(_fp("url").alias("fingerprint"), "url", F.lit(1).alias("depth"), "ts")
    crawled = S.events_of(d, "page_crawled").select(_fp("url").alias("fingerprint"), "url", "status_code", "ts")
    errors = S.events_of(d, "request_error").select(_fp("url").alias("fingerprint"), "url", "error", "ts")
    return d, links, crawled, errors


_FPX = sg.url_fingerprint
J5_SQL = f"""
WITH l AS (SELECT {_FPX('url')} AS fingerprint, url, ts FROM ({LINKS_SQL})),
nl AS (SELECT fingerprint, arg_min(url, ts) AS url_new, min(ts) AS created_at_new FROM l GROUP BY fingerprint),
c AS (SELECT {_FPX('url')} AS fingerprint, url, ts,
             CAST(CASE WHEN CAST(floor(value) AS BIGINT) % 5 = 0 THEN 500 ELSE 200 END AS INTEGER) AS status_code
      FROM ({GOOD}) WHERE type = 'page_crawled'),
cr AS (SELECT fingerprint, arg_max(url, ts) AS url_cr, arg_max(status_code, ts) AS status_new, max(ts) AS fetched_at_new
       FROM c GROUP BY fingerprint),
e AS (SELECT {_FPX('url')} AS fingerprint, url, ts, 'err' || CAST(event_id % 4 AS VARCHAR) AS error
      FROM ({GOOD}) WHERE type = 'request_error'),
er AS (SELECT fingerprint, arg_max(url, ts) AS url_er, arg_max(error, ts) AS error_new, max(ts) AS error_at
       FROM e GROUP BY fingerprint),
k AS (SELECT fingerprint FROM nl UNION SELECT fingerprint FROM cr UNION SELECT fingerprint FROM er)
SELECT k.fingerprint, coalesce(url_new, url_cr, url_er) AS url,
       CAST(CASE WHEN nl.fingerprint IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS depth,
       coalesce(created_at_new, fetched_at_new, error_at) AS created_at,
       fetched_at_new AS fetched_at, status_new AS status_code,
       CASE WHEN error_at IS NOT NULL AND (fetched_at_new IS NULL OR error_at >= fetched_at_new) THEN error_new END AS error
FROM k LEFT JOIN nl ON k.fingerprint = nl.fingerprint LEFT JOIN cr ON k.fingerprint = cr.fingerprint
       LEFT JOIN er ON k.fingerprint = er.fingerprint"""


@register("j5_apply_events", J5_SQL)
def j5_apply_events(spark, sf_dir):
    facts = S.event_facts(decoded(spark, sf_dir), url_fingerprint).where(F.col("kind") != "queued")
    return Q.apply_event_facts(None, facts).drop("error_at")


def j5_batches_sql(batch: str, base: str | None = None) -> str:
    """Metadata after batches of facts, numbered by the expression ``batch`` in the order they come. The first batch that
    names a URL which ``base`` does not know creates it, by that batch's own facts; later ones change its fetch and error."""
    base = base or "SELECT NULL::VARCHAR AS fingerprint, NULL::VARCHAR AS url, NULL AS depth, NULL::DOUBLE AS score, NULL::TIMESTAMP AS created_at, " \
        "NULL::TIMESTAMP AS fetched_at, NULL::INTEGER AS status_code WHERE FALSE"
    status = "CAST(CASE WHEN CAST(floor(value) AS BIGINT) % 5 = 0 THEN 500 ELSE 200 END AS INTEGER)"
    return f"""
WITH b AS ({base}),
f AS (SELECT {_FPX('url')} AS fingerprint, 'link' AS kind, url, NULL::INTEGER AS status, NULL::VARCHAR AS error, ts FROM ({LINKS_SQL})
      UNION ALL SELECT {_FPX('url')}, 'crawl', url, {status}, NULL, ts FROM ({GOOD}) WHERE type = 'page_crawled'
      UNION ALL SELECT {_FPX('url')}, 'error', url, NULL, 'err' || CAST(event_id % 4 AS VARCHAR), ts FROM ({GOOD}) WHERE type = 'request_error'),
n AS (SELECT *, {batch} AS batch FROM f),
first AS (SELECT fingerprint, min(batch) AS batch FROM n GROUP BY fingerprint),
made AS (SELECT fingerprint,
    coalesce(arg_min(url, (ts, url)) FILTER (kind = 'link'), arg_max(url, (ts, status, url)) FILTER (kind = 'crawl'), arg_max(url, (ts, error, url)) FILTER (kind = 'error')) AS url,
    CASE WHEN bool_or(kind = 'link') THEN 1 ELSE 0 END AS depth,
    coalesce(min(ts) FILTER (kind = 'link'), max(ts) FILTER (kind = 'crawl'), max(ts) FILTER (kind = 'error')) AS created_at
  FROM n JOIN first USING (fingerprint, batch) GROUP BY fingerprint),
latest AS (SELECT fingerprint, max(ts) FILTER (kind = 'crawl') AS crawl_at, arg_max(status, (ts, status)) FILTER (kind = 'crawl') AS status,
    max(ts) FILTER (kind = 'error') AS error_at, arg_max(error, (ts, error)) FILTER (kind = 'error') AS error FROM n GROUP BY fingerprint),
j AS (SELECT coalesce(b.fingerprint, made.fingerprint) AS fingerprint, coalesce(b.url, made.url) AS url, coalesce(b.depth, made.depth) AS depth, b.score,
    coalesce(b.created_at, made.created_at) AS created_at,
    CASE WHEN crawl_at IS NULL OR b.fetched_at > crawl_at THEN b.fetched_at ELSE crawl_at END AS fetched_at,
    CASE WHEN crawl_at IS NULL OR b.fetched_at > crawl_at THEN b.status_code ELSE status END AS status_code, error_at, error
  FROM b FULL OUTER JOIN made USING (fingerprint) LEFT JOIN latest ON latest.fingerprint = coalesce(b.fingerprint, made.fingerprint))
SELECT fingerprint, url, CAST(depth AS INTEGER) AS depth{', score' if 'WHERE FALSE' not in base else ''}, created_at, fetched_at, CAST(status_code AS INTEGER) AS status_code,
       CASE WHEN fetched_at IS NULL OR error_at >= fetched_at THEN error END AS error
FROM j"""


# A table that knows the URL of every third event, with a score and a fetch in the middle of the period; then the
# events in two batches out of order: first the later two thirds, then all (the overlap counts once).
MID = "2024-01-16 00:00:00"
LATER = "2024-01-10"
_BASE_SQL = f"""SELECT DISTINCT {_FPX('url')} AS fingerprint, url, 5 AS depth, CAST(user_id % 10 AS DOUBLE) AS score, TIMESTAMP '2024-01-01 00:00:00' AS created_at,
       TIMESTAMP '{MID}' AS fetched_at, 299 AS status_code FROM ({GOOD}) WHERE user_id % 3 = 0 AND type <> 'offset'"""


@register("j5_two_batches", j5_batches_sql(f"(CASE WHEN ts >= TIMESTAMP '{LATER}' THEN 0 ELSE 1 END)", _BASE_SQL))
def j5_two_batches(spark, sf_dir):
    facts = S.event_facts(decoded(spark, sf_dir), url_fingerprint).where(F.col("kind") != "queued")
    base = I.event_rows(spark, sf_dir).where("event_id % 97 != 0 and user_id % 3 = 0 and type != 'offset'").select(
        _fp("url").alias("fingerprint"), "url", (F.col("user_id") % 10).cast("double").alias("score")).distinct().select(
        "*", F.lit(5).alias("depth"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit(MID).cast("timestamp_ntz").alias("fetched_at"), F.lit(299).alias("status_code"), F.lit(None).cast("string").alias("error"))
    first = Q.apply_event_facts(base, facts.where(F.col("ts") >= F.lit(LATER).cast("timestamp_ntz")))
    return Q.apply_event_facts(first, facts).select("fingerprint", "url", "depth", "score", "created_at", "fetched_at",
                                                    "status_code", "error")


J6_SQL = f"""
WITH t AS (
  SELECT {_FPX('url')} AS fingerprint, CAST(0 AS SMALLINT) AS state, ts FROM ({LINKS_SQL})
  UNION ALL
  SELECT {_FPX('url')}, CAST(CASE type WHEN 'update_score' THEN 1 WHEN 'page_crawled' THEN 2 ELSE 3 END AS SMALLINT), ts
  FROM ({GOOD}) WHERE type IN ('page_crawled', 'request_error') OR (type = 'update_score' AND event_id % 2 = 0)
)
SELECT fingerprint, CAST(arg_max(state, (ts, state)) AS SMALLINT) AS state FROM t GROUP BY fingerprint"""


@register("j6_url_states", J6_SQL)
def j6_url_states(spark, sf_dir):
    facts = S.event_facts(decoded(spark, sf_dir), url_fingerprint)
    return Q.url_states(facts.select("fingerprint", "state", "ts"))


# Score updates: metadata = every URL seen in a decoded event (score unset).
F9_UPD = f"""SELECT {_FPX('url')} AS fingerprint, url, value / 100.0 AS score, event_id % 2 = 0 AS schedule, ts, event_id,
                    event_id % 9 AS depth FROM ({GOOD}) WHERE type = 'update_score'"""
F9_LAST = f"""SELECT fingerprint, arg_max(url, (ts, event_id)) AS url, arg_max(score, (ts, event_id)) AS score,
                     arg_max(schedule, (ts, event_id)) AS schedule, max(ts) AS ts, arg_max(depth, (ts, event_id)) AS depth
              FROM ({F9_UPD}) GROUP BY fingerprint"""


def _f9(spark, sf_dir):
    d = decoded(spark, sf_dir)
    # metadata knows the crawled URLs only (with a score that updates replace); the queue starts with one row per error
    md = d.where(F.col("type") == "page_crawled").select(_fp("url").alias("fingerprint"), "url").distinct() \
        .select("*", F.lit(-1.0).alias("score"), F.lit(3).alias("depth"))
    upd = S.events_of(d, "update_score").select(_fp("url").alias("fingerprint"), "url", "score", "schedule", "ts",
                                                (F.col("offset") % 9).cast("int").alias("depth"), "offset")
    errors = S.events_of(d, "request_error").select("url", F.lit(0.5).alias("score"), F.col("ts").alias("created_at"), F.lit(1).alias("depth"))
    queue = Q.to_queue(errors).withColumn("headers", F.create_map(F.lit("a"), F.array(F.lit("b"))))
    return Q.apply_scores(md, queue, upd)


@register("f9_metadata_scores", f"""
WITH md AS (SELECT DISTINCT {_FPX('url')} AS fingerprint, url FROM ({GOOD}) WHERE type = 'page_crawled')
SELECT coalesce(md.fingerprint, l.fingerprint) AS fingerprint, coalesce(md.url, l.url) AS url,
       coalesce(l.score, CASE WHEN md.fingerprint IS NOT NULL THEN -1.0 END) AS score,
       CAST(CASE WHEN md.fingerprint IS NOT NULL THEN 3 ELSE l.depth END AS INTEGER) AS depth
FROM md FULL OUTER JOIN ({F9_LAST}) l ON md.fingerprint = l.fingerprint""")
def f9_metadata_scores(spark, sf_dir):
    md, _ = _f9(spark, sf_dir)
    return md.select("fingerprint", "url", "score", "depth")


@register("f9_queue_appended", f"""
SELECT {sg.host_partition('url', 2)} AS partition_id, fingerprint, url, score, ts AS created_at, CAST(depth AS INTEGER) AS depth, FALSE AS has_headers
FROM ({F9_LAST}) WHERE schedule
UNION ALL
SELECT {sg.host_partition('url', 2)}, {_FPX('url')}, url, 0.5, ts, 1, TRUE FROM ({GOOD}) WHERE type = 'request_error'""")
def f9_queue_appended(spark, sf_dir):
    _, q = _f9(spark, sf_dir)
    return q.select("partition_id", "fingerprint", "url", "score", "created_at", F.col("depth").cast("int").alias("depth"),
                    F.col("headers").isNotNull().alias("has_headers"))


# ---------------------------------------------------------------- streaming
def _message_stream(spark, sf_dir, steps: int):
    """The messages as a stream, a step of the feed per micro-batch."""
    path = I.feed_in_order(spark, I.messages(spark, sf_dir), "offset", steps, I.FEED_FILES)
    schema = spark.read.parquet(path).schema
    return S.read_messages(spark, path, schema=schema, max_files_per_trigger=I.FEED_FILES)


@register("e7_stream_states", J6_SQL)
def e7_stream_states(spark, sf_dir):
    """J6 as a stream: four sets of message files, one per micro-batch, folded in the state store."""
    from ..session import scratch_path
    from ..streaming.jobs import read_states, stream_url_states
    good, _ = S.decode_spider_log(_message_stream(spark, sf_dir, 4))
    facts = S.event_facts(good, url_fingerprint).select("fingerprint", "state", "ts")
    out, ckpt = scratch_path(spark, "states-out"), scratch_path(spark, "states-ckpt")
    q = stream_url_states(facts, out, ckpt)
    q.awaitTermination()
    return read_states(spark, out)


@register("e7_stream_stats", A4_SQL)
def e7_stream_stats(spark, sf_dir):
    """A4 as a stream: four micro-batches of partial window counts, added up by the reader."""
    from ..session import scratch_path
    from ..streaming.jobs import read_stats, stream_crawl_stats
    good, _ = S.decode_spider_log(_message_stream(spark, sf_dir, 4))
    out, ckpt = scratch_path(spark, "stats-out"), scratch_path(spark, "stats-ckpt")
    q = stream_crawl_stats(good, out, ckpt, interval="1 hour", late_after="1 hour")
    q.awaitTermination()
    return read_stats(spark, out).drop("n_late")
