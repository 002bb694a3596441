"""Queries for the frontier tables (F1-F10, J1) over a queue derived from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import host_crc32, host_fingerprint, host_partition, url_fingerprint, url_host
from ..operators import frontier as Q
from . import inputs as I
from . import sqlgen as sg
from .catalog import register

REQ_SQL = I.queue_requests_sql(sg)
QUEUE_SQL = f"""
SELECT {sg.host_partition('url', 2)} AS partition_id, score, url, fingerprint,
       {sg.crc32(sg.host('url'))} AS host_crc32, created_at, depth, host
FROM ({REQ_SQL})"""

BATCH_N = 25  # per-partition batch size for the test queue (the limit is the feature)


def queue(spark, sf_dir):
    req = I.queue_requests(spark, sf_dir)
    return Q.to_queue(req).withColumn("host", url_host("url"))


@register("f1_url_fingerprint", f"SELECT page_id, url, {sg.url_fingerprint('url')} AS fingerprint FROM pages")
def f1_url_fingerprint(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", "url", url_fingerprint("url").alias("fingerprint"))


@register("f2_host_fingerprint", f"""
SELECT page_id, {sg.host('url')} AS host, {sg.host_fingerprint('url')} AS host_fp FROM pages""")
def f2_host_fingerprint(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", url_host("url").alias("host"),
                                                   host_fingerprint("url").alias("host_fp"))


@register("f3_assign_partition", f"""
SELECT page_id, {sg.host('url')} AS host, {sg.crc32(sg.host('url'))} AS host_crc32,
       {sg.host_partition('url', 2)} AS partition_id FROM pages""")
def f3_assign_partition(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages")
    return p.select("page_id", url_host("url").alias("host"), host_crc32("url").alias("host_crc32"),
                    host_partition("url", 2).alias("partition_id"))


# Candidates: every page URL and its other-scheme copy (same fingerprint, a day
# later); seen: pages whose id is a multiple of 3.
_CAND_SQL = """
SELECT url, created_at FROM ({r})
UNION ALL
SELECT CASE WHEN starts_with(url, 'https:') THEN 'http:' || substr(url, 7) ELSE 'https:' || substr(url, 6) END AS url,
       created_at + INTERVAL 1 DAY AS created_at FROM ({r})""".format(r=REQ_SQL)


def candidates(spark, sf_dir):
    r = I.queue_requests(spark, sf_dir).select("url", "created_at")
    other = F.when(F.col("url").startswith("https:"), F.concat(F.lit("http:"), F.substr("url", F.lit(7))))\
        .otherwise(F.concat(F.lit("https:"), F.substr("url", F.lit(6))))
    copy = r.select(other.alias("url"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return r.unionByName(copy).withColumn("fingerprint", url_fingerprint("url"))


J1_SQL = f"""
WITH c AS (SELECT url, created_at, {sg.url_fingerprint('url')} AS fingerprint FROM ({_CAND_SQL})),
first AS (SELECT fingerprint, arg_min(url, (created_at, url)) AS url, min(created_at) AS created_at
          FROM c GROUP BY fingerprint),
seen AS (SELECT {sg.url_fingerprint('url')} AS fingerprint FROM pages WHERE page_id % 3 = 0)
SELECT fingerprint, url, created_at FROM first WHERE fingerprint NOT IN (SELECT fingerprint FROM seen)"""


@register("j1_filter_unseen", J1_SQL)
def j1_filter_unseen(spark, sf_dir):
    seen = I.table(spark, sf_dir, "pages").where(F.col("page_id") % 3 == 0) \
        .select(url_fingerprint("url").alias("fingerprint"))
    return Q.filter_unseen(candidates(spark, sf_dir), seen).select("fingerprint", "url", "created_at")


def _batch_sql(order: str) -> str:
    return f"""
SELECT partition_id, url, fingerprint, score, created_at, depth FROM (
  SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY {order}) AS rn FROM ({QUEUE_SQL})
  WHERE partition_id IN (0, 1)
) WHERE rn <= {BATCH_N}"""


_SCORE_ORDER = "score DESC, created_at, fingerprint"
_BFS_ORDER = "depth, created_at, fingerprint"


@register("f4_next_batch", _batch_sql(_SCORE_ORDER))
def f4_next_batch(spark, sf_dir):
    return Q.next_batch(queue(spark, sf_dir), [0, 1], BATCH_N).select(
        "partition_id", "url", "fingerprint", "score", "created_at", "depth")


@register("f5_next_batch_bfs", _batch_sql(_BFS_ORDER))
def f5_next_batch_bfs(spark, sf_dir):
    return Q.next_batch(queue(spark, sf_dir), [0, 1], BATCH_N, order="bfs").select(
        "partition_id", "url", "fingerprint", "score", "created_at", "depth")


@register("f6_consume_batch", f"""
SELECT q.partition_id, q.fingerprint, q.created_at FROM ({QUEUE_SQL}) q
WHERE NOT EXISTS (SELECT 1 FROM ({_batch_sql(_SCORE_ORDER)}) b
                  WHERE b.fingerprint = q.fingerprint)""")
def f6_consume_batch(spark, sf_dir):
    q = queue(spark, sf_dir)
    remaining, _ = Q.consume_batch(q, Q.next_batch(q, [0, 1], BATCH_N))
    return remaining.select("partition_id", "fingerprint", "created_at")


@register("f6_mark_queued", f"""
SELECT DISTINCT fingerprint, CAST(1 AS SMALLINT) AS state FROM ({_batch_sql(_SCORE_ORDER)})""")
def f6_mark_queued(spark, sf_dir):
    q = queue(spark, sf_dir)
    _, states = Q.consume_batch(q, Q.next_batch(q, [0, 1], BATCH_N))
    return states


# States: every fifth page was crawled (2), every seventh failed (3); the batch overwrites what it takes.
@register("f6_states_upsert", f"""
WITH b AS (SELECT DISTINCT fingerprint FROM ({_batch_sql(_SCORE_ORDER)})),
s AS (SELECT DISTINCT {sg.url_fingerprint('url')} AS fingerprint, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 3 END AS state
      FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0)
SELECT coalesce(b.fingerprint, s.fingerprint) AS fingerprint,
       CAST(CASE WHEN b.fingerprint IS NOT NULL THEN 1 ELSE s.state END AS SMALLINT) AS state
FROM s FULL OUTER JOIN b ON s.fingerprint = b.fingerprint""")
def f6_states_upsert(spark, sf_dir):
    q = queue(spark, sf_dir)
    p = I.table(spark, sf_dir, "pages").where((F.col("page_id") % 5 == 0) | (F.col("page_id") % 7 == 0))
    states = p.select(url_fingerprint("url").alias("fingerprint"),
                      F.when(F.col("page_id") % 5 == 0, 2).otherwise(3).cast("smallint").alias("state")).distinct()
    return Q.consume_batch(q, Q.next_batch(q, [0, 1], BATCH_N), states)[1]


@register("f7_cap_per_host", f"""
SELECT host, url, score FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY {_SCORE_ORDER}) AS rn FROM ({QUEUE_SQL})
) WHERE rn <= 10""")
def f7_cap_per_host(spark, sf_dir):
    return Q.cap_per_host(queue(spark, sf_dir), 10).select("host", "url", "score")


# Metadata: a page was fetched page_id hours after the epoch, except every 7th.
_MD_SQL = f"""
SELECT {sg.url_fingerprint('url')} AS fingerprint, url,
       CASE WHEN page_id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id) END AS fetched_at
FROM pages"""
NOW = "2024-01-08 00:00:00"


def metadata(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages")
    fetched = F.timestamp_add("HOUR", F.col("page_id"), F.lit(I.EPOCH).cast("timestamp_ntz"))
    return p.select(url_fingerprint("url").alias("fingerprint"), "url",
                    F.when(F.col("page_id") % 7 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(fetched)
                    .alias("fetched_at"))


@register("f8_due_for_revisit", f"""
SELECT fingerprint, url, fetched_at FROM ({_MD_SQL})
WHERE fetched_at IS NULL OR fetched_at <= TIMESTAMP '{NOW}' - INTERVAL 3 DAY""")
def f8_due_for_revisit(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    return Q.due_for_revisit(metadata(spark, sf_dir), now).select("fingerprint", "url", "fetched_at")


@register("f10_peek_queue", f"""
SELECT partition_id, fingerprint, url, score FROM ({QUEUE_SQL}) ORDER BY fingerprint, created_at LIMIT 50""")
def f10_peek_queue(spark, sf_dir):
    return Q.peek(queue(spark, sf_dir), 50, ["fingerprint", "created_at"]).select(
        "partition_id", "fingerprint", "url", "score")


@register("f10_peek_metadata", f"""
SELECT fingerprint, url, fetched_at FROM ({_MD_SQL}) ORDER BY fingerprint, url LIMIT 10""")
def f10_peek_metadata(spark, sf_dir):
    return Q.peek(metadata(spark, sf_dir), 10, ["fingerprint", "url"])


# A frontier database with a stale table is reset and gets the queue as its only table.
@register("k3_reset_frontier", f"SELECT partition_id, fingerprint, url, score, 1 AS n_tables FROM ({QUEUE_SQL})")
def k3_reset_frontier(spark, sf_dir):
    import uuid
    db = f"crawlframe_k3_{uuid.uuid4().hex[:8]}"
    q = queue(spark, sf_dir)
    Q.reset_frontier(spark, db, {"stale": q.select("url"), "queue": q.limit(1)})
    Q.reset_frontier(spark, db, {"queue": q})
    n = len(spark.catalog.listTables(db))
    rows = spark.table(f"{db}.queue").select("partition_id", "fingerprint", "url", "score", F.lit(n).alias("n_tables"))
    from ..session import scratch_path
    path = scratch_path(spark, "k3")
    rows.write.parquet(path)
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.read.parquet(path)


PER_HOST = 3


@register("f7_fair_batch", f"""
WITH h AS (SELECT *, row_number() OVER (PARTITION BY host_crc32 ORDER BY score DESC, created_at, fingerprint) AS host_rank FROM ({QUEUE_SQL})),
p AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY host_rank, score DESC, created_at, fingerprint) AS place FROM h WHERE host_rank <= {PER_HOST})
SELECT partition_id, fingerprint, url, score FROM p WHERE place <= {BATCH_N}""")
def f7_fair_batch(spark, sf_dir):
    return Q.fair_batch(queue(spark, sf_dir), [0, 1], BATCH_N, PER_HOST).select("partition_id", "fingerprint", "url", "score")


# Robots rules for every page host: '*' disallows /fr/ except /fr/8..., and
# any path with ?page=; hosts of even name length also have a group of their
# own that disallows /en/ (and so ignores the '*' group).
AGENT = "crawlframe"
_RULES_SQL = f"""
WITH h AS (SELECT DISTINCT {sg.host('url')} AS host FROM pages)
SELECT host, '*' AS agent, false AS allow, '/fr/' AS pattern FROM h
UNION ALL SELECT host, '*', true, '/fr/8' FROM h
UNION ALL SELECT host, '*', false, '/*?page=' FROM h
UNION ALL SELECT host, '{AGENT}', false, '/en/' FROM h WHERE length(host) % 2 = 0"""


def robots_rules(spark, sf_dir):
    h = I.table(spark, sf_dir, "pages").select(url_host("url").alias("host")).distinct()
    star = [("*", False, "/fr/"), ("*", True, "/fr/8"), ("*", False, "/*?page=")]
    rows = None
    for agent, allow, pat in star:
        part = h.select("host", F.lit(agent).alias("agent"), F.lit(allow).alias("allow"), F.lit(pat).alias("pattern"))
        rows = part if rows is None else rows.unionByName(part)
    own = h.where(F.length("host") % 2 == 0).select("host", F.lit(AGENT).alias("agent"), F.lit(False).alias("allow"),
                                                    F.lit("/en/").alias("pattern"))
    return rows.unionByName(own)


@register("t8_robots", f"""
WITH r AS ({_RULES_SQL}),
own AS (SELECT host, bool_or(agent = '{AGENT}') AS has_own FROM r GROUP BY host),
eff AS (SELECT r.* FROM r JOIN own USING (host) WHERE (has_own AND agent = '{AGENT}') OR (NOT has_own AND agent = '*')),
u AS (SELECT page_id, url, {sg.host('url')} AS host,
             CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1) = '' THEN '/'
                  ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1) END AS pq FROM pages),
m AS (SELECT u.page_id, arg_max(eff.allow, (length(eff.pattern), eff.allow)) AS allow
      FROM u JOIN eff ON u.host = eff.host
      WHERE u.pq LIKE replace(CASE WHEN ends_with(eff.pattern, '$') THEN substr(eff.pattern, 1, length(eff.pattern) - 1)
                                   ELSE eff.pattern END, '*', '%')
                      || CASE WHEN ends_with(eff.pattern, '$') THEN '' ELSE '%' END
      GROUP BY u.page_id)
SELECT u.page_id, u.url, coalesce(m.allow, true) AS allowed,
       CAST(CASE WHEN coalesce(m.allow, true) THEN NULL ELSE -9998 END AS INTEGER) AS status_code
FROM u LEFT JOIN m ON u.page_id = m.page_id""")
def t8_robots(spark, sf_dir):
    from ..operators.robots import apply_robots
    urls = I.table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_robots(urls, robots_rules(spark, sf_dir), AGENT)


@register("e7_stream_unseen", J1_SQL)
def e7_stream_unseen(spark, sf_dir):
    """J1 as a stream: candidates arrive in ten sets of files, in time order; each micro-batch
    is filtered against the seen table and everything earlier batches let through."""
    from ..session import scratch_path
    from ..streaming.jobs import read_batches, stream_unseen
    seen = I.table(spark, sf_dir, "pages").where(F.col("page_id") % 3 == 0) \
        .select(url_fingerprint("url").alias("fingerprint"))
    feed = I.feed_in_order(spark, candidates(spark, sf_dir), "created_at", 10, I.FEED_FILES)
    schema = spark.read.parquet(feed).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", I.FEED_FILES).parquet(feed)
    out, added, ckpt = (scratch_path(spark, "unseen-out"), scratch_path(spark, "unseen-seen"),
                        scratch_path(spark, "unseen-ckpt"))
    stream_unseen(stream, seen, added, out, ckpt).awaitTermination()
    return read_batches(spark, out).select("fingerprint", "url", "created_at")
