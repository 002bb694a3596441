"""Queries for the capture-store stretch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digest import content_digest
from ..functions.urls import url_host
from ..operators import captures as X
from ..operators.discovery import DEFAULT_WELL_KNOWN_URIS
from ..session import scratch_path
from . import inputs as I
from . import sqlgen as sg
from .catalog import register


def _surt_host_sql(h: str) -> str:
    return f"array_to_string(list_reverse(string_split(regexp_replace(lower({h}), '^www\\d*\\.', ''), '.')), ',')"


def _surt_key_sql(u: str) -> str:
    rest = f"lower(regexp_extract({u}, {sg.q(X.SURT_PATH_RE)}, 1))"
    return f"({_surt_host_sql(sg.host(u))} || ')' || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END)"


# Captures: every event is a capture of key user_id at ts. Requests: two per
# user, one inside the month and one near its end (often with no later capture).
_REQ_SQL = """
SELECT DISTINCT user_id AS key, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(user_id % 30 AS INTEGER))
       + to_hours(CAST(user_id % 24 AS INTEGER)) AS asked FROM events
UNION
SELECT DISTINCT user_id AS key, TIMESTAMP '2024-01-30 12:00:00' + to_minutes(CAST(user_id AS INTEGER)) AS asked FROM events"""


def _requests(spark, sf_dir):
    users = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    base = F.lit(I.EPOCH).cast("timestamp_ntz")
    a1 = F.timestamp_add("HOUR", (F.col("key") % 24), F.timestamp_add("DAY", F.col("key") % 30, base))
    a2 = F.timestamp_add("MINUTE", F.col("key"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return users.select("key", a1.alias("asked")).unionByName(users.select("key", a2.alias("asked"))).distinct()


@register("x1_capture_lookup", f"""
SELECT r.key, r.asked, c.ts AS capture_ts, c.event_id AS capture_id,
       CASE WHEN c.ts IS NULL THEN 'fetch' ELSE 'reuse' END AS action
FROM ({_REQ_SQL}) r ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events) c
  ON r.key = c.user_id AND r.asked <= c.ts""")
def x1_capture_lookup(spark, sf_dir):
    caps = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts",
                                                   F.col("event_id").alias("capture_id"))
    return X.capture_lookup(_requests(spark, sf_dir), caps)


_PREFIX_SQL = f"""
SELECT DISTINCT {_surt_host_sql(sg.host('url'))} || s AS prefix FROM pages
CROSS JOIN (VALUES (')'), (',')) AS v(s)
WHERE len(string_split({sg.host('url')}, '.')) = 3"""


def _prefixes(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages")
    h = url_host("url")
    three = p.where(F.size(F.split(h, r"\.")) == 3).select(X.surt_host(h).alias("sh"))
    return three.select(F.concat("sh", F.lit(")")).alias("prefix")).unionByName(
        three.select(F.concat("sh", F.lit(",")).alias("prefix"))).distinct()


@register("x2_scope_in", f"""
SELECT page_id, url, {_surt_key_sql('url')} AS urlkey FROM pages
WHERE EXISTS (SELECT 1 FROM ({_PREFIX_SQL}) p WHERE starts_with({_surt_key_sql('url')}, p.prefix))""")
def x2_scope_in(spark, sf_dir):
    ins, _ = X.scope_filter(I.table(spark, sf_dir, "pages").select("page_id", "url"), _prefixes(spark, sf_dir))
    return ins.select("page_id", "url", X.surt_key(F.col("url")).alias("urlkey"))


@register("x2_scope_out", f"""
SELECT page_id, url FROM pages
WHERE NOT EXISTS (SELECT 1 FROM ({_PREFIX_SQL}) p WHERE starts_with({_surt_key_sql('url')}, p.prefix))""")
def x2_scope_out(spark, sf_dir):
    _, outs = X.scope_filter(I.table(spark, sf_dir, "pages").select("page_id", "url"), _prefixes(spark, sf_dir))
    return outs.select("page_id", "url")


# Documents as captures: one URL per language, a capture per document.
@register("x3_digest_dedupe", f"""
WITH c AS (SELECT doc_id AS capture_id, 'http://docs.example/' || lang AS url,
                  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS ts,
                  {sg.base32_sha1('text')} AS digest FROM documents)
SELECT capture_id, url, digest, capture_id <> min(capture_id) OVER (PARTITION BY url, digest) AS is_revisit,
       min(capture_id) OVER (PARTITION BY url, digest) AS original_capture_id FROM c""")
def x3_digest_dedupe(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    caps = d.select(F.col("doc_id").alias("capture_id"), F.concat(F.lit("http://docs.example/"), "lang").alias("url"),
                    F.timestamp_add("MINUTE", F.col("doc_id"), F.lit(I.EPOCH).cast("timestamp_ntz")).alias("ts"),
                    content_digest(F.col("text")).alias("digest"))
    return X.dedupe_digests(caps).select("capture_id", "url", "digest", "is_revisit", "original_capture_id")


@register("x4_capture_index", f"SELECT page_id, url, {_surt_key_sql('url')} AS urlkey FROM pages")
def x4_capture_index(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("ts"))
    return X.capture_index(p).select("page_id", "url", "urlkey")


# One key (of the first page) and one prefix (the second page's host) looked up in the stored index.
@register("x4_lookup", f"""
WITH k AS (SELECT page_id, url, {_surt_key_sql('url')} AS urlkey FROM pages),
a AS (SELECT urlkey FROM k WHERE page_id = (SELECT min(page_id) FROM pages)),
b AS (SELECT split_part(urlkey, ')', 1) || ')' AS prefix FROM k WHERE page_id = (SELECT max(page_id) FROM pages))
SELECT 'key' AS found_by, page_id, url, urlkey FROM k WHERE urlkey IN (SELECT urlkey FROM a)
UNION ALL SELECT 'prefix', page_id, url, urlkey FROM k WHERE starts_with(urlkey, (SELECT prefix FROM b))""")
def x4_lookup(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("ts"))
    path = scratch_path(spark, "capture-index")
    X.write_capture_index(p, path, 12)
    ends = p.agg(F.min_by(X.surt_key("url"), "page_id"), F.max_by(X.surt_key("url"), "page_id")).first()
    one = X.lookup_captures(spark, path, key=ends[0]).withColumn("found_by", F.lit("key"))
    many = X.lookup_captures(spark, path, prefix=ends[1].split(")")[0] + ")").withColumn("found_by", F.lit("prefix"))
    return one.unionByName(many).select("found_by", "page_id", "url", "urlkey")


QUOTA = 200000


@register("x5_host_quota", f"""
SELECT id, host, running_bytes FROM (
  SELECT event_id AS id, host,
         CAST(sum(CAST(trunc(value * 100) AS BIGINT)) OVER (PARTITION BY host ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_bytes
  FROM ({I.EVENT_ROWS_SQL})
) WHERE running_bytes <= {QUOTA}""")
def x5_host_quota(spark, sf_dir):
    r = I.event_rows(spark, sf_dir).select(F.col("event_id").alias("id"), "host", "ts",
                                           (F.col("value") * 100).cast("bigint").alias("content_length"))
    return X.quota_per_host(r, QUOTA).select("id", "host", "running_bytes")


_WK_IN = ", ".join(sg.q(u) for u in DEFAULT_WELL_KNOWN_URIS)
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def _scan_sql(log: str) -> str:
    return f"""
SELECT {sg.host('url')} AS host, bool_or(status_code = 200) AS serving,
       count(*) FILTER (WHERE status_code = 200) AS n_ok, count(*) AS n_fetched,
       coalesce(string_agg(DISTINCT {_PATH}, ',' ORDER BY {_PATH}) FILTER (WHERE status_code = 200 AND {_PATH} IN ({_WK_IN})), '') AS well_known
FROM ({log}) GROUP BY 1"""


@register("x8_domain_scan", _scan_sql(I.RESPONSES_SQL))
def x8_domain_scan(spark, sf_dir):
    return X.domain_scan_report(I.responses(spark, sf_dir))


# The pages and one well-known URL of each page's host, found or not by turns.
_WK_LIST = "[" + _WK_IN + "]"


@register("x8_well_known_found", _scan_sql(f"""
SELECT url, status_code FROM ({I.RESPONSES_SQL})
UNION ALL SELECT 'http://' || {sg.host('url')} || {_WK_LIST}[CAST(page_id % {len(DEFAULT_WELL_KNOWN_URIS)} + 1 AS INTEGER)] || '?r=' || page_id,
                 CASE WHEN page_id % 3 = 0 THEN 404 ELSE 200 END FROM pages"""))
def x8_well_known_found(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    uris = F.array(*[F.lit(u) for u in DEFAULT_WELL_KNOWN_URIS])
    uri = F.element_at(uris, (F.col("page_id") % len(DEFAULT_WELL_KNOWN_URIS) + 1).cast("int"))
    probes = pages.select(F.concat(F.lit("http://"), url_host("url"), uri, F.lit("?r="), F.col("page_id").cast("string")).alias("url"),
                          F.when(F.col("page_id") % 3 == 0, 404).otherwise(200).alias("status_code"))
    log = I.responses(spark, sf_dir).select("url", F.col("status_code").cast("int").alias("status_code"))
    return X.domain_scan_report(log.unionByName(probes))


# The same captures by day only: many share their time, the smallest id wins.
@register("x1_tied_times", f"""
SELECT r.key, r.asked, min(c.ts) AS capture_ts, arg_min(c.id, (c.ts, c.id)) AS capture_id,
       CASE WHEN min(c.ts) IS NULL THEN 'fetch' ELSE 'reuse' END AS action
FROM ({_REQ_SQL}) r LEFT JOIN (SELECT user_id % 50 AS user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, event_id AS id FROM events) c
  ON r.key = c.user_id AND r.asked <= c.ts
GROUP BY r.key, r.asked""")
def x1_tied_times(spark, sf_dir):
    caps = I.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"),
                                                   F.col("event_id").alias("capture_id"))
    return X.capture_lookup(_requests(spark, sf_dir), caps)
