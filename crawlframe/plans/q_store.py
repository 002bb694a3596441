"""Queries for the frontier store (J5, J6, F6, F9 batch by batch) and the message log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import url_fingerprint
from ..operators import frontier as Q
from ..operators import frontier_store as FS
from ..operators import path_store as PS
from ..session import scratch_path
from ..streaming import revisit as RV
from ..streaming import spiderlog as S
from . import inputs as I
from . import sqlgen as sg
from .catalog import register
from .q_discovery import PATHS_SQL
from .q_events import GOOD, J6_SQL, LINKS_SQL, decoded, j5_batches_sql

FIRST_DAYS = ("2024-01-11", "2024-01-21")  # the events come in three batches
BATCH_SQL = f"(CASE WHEN ts < TIMESTAMP '{FIRST_DAYS[0]}' THEN 0 WHEN ts < TIMESTAMP '{FIRST_DAYS[1]}' THEN 1 ELSE 2 END)"
TAKEN = 20  # rows of a batch (the limit is the feature)


def _batches(df):
    day = [F.lit(d).cast("timestamp_ntz") for d in FIRST_DAYS]
    return [df.where(F.col("ts") < day[0]), df.where((F.col("ts") >= day[0]) & (F.col("ts") < day[1])), df.where(F.col("ts") >= day[1])]


def _event_store(spark, sf_dir):
    """Three batches of events, the second given twice, as after a crash of its caller."""
    store = FS.open_store(spark, scratch_path(spark, "frontier"), groups=8, spread=2)
    path = scratch_path(spark, "facts")
    S.event_facts(decoded(spark, sf_dir), url_fingerprint).write.parquet(path)
    parts = _batches(spark.read.parquet(path))
    for batch_id, part in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2])):
        FS.apply_events(store, part, batch_id)
    return store


@register("j5_store_batches", j5_batches_sql(BATCH_SQL))
def j5_store_batches(spark, sf_dir):
    return _event_store(spark, sf_dir).read("metadata").drop("score", "error_at")


@register("j6_store_states", J6_SQL)
def j6_store_states(spark, sf_dir):
    return _event_store(spark, sf_dir).read("states").select("fingerprint", "state")


_UPDATES = f"""SELECT {sg.url_fingerprint('url')} AS fingerprint, url, value / 100.0 AS score, event_id % 2 = 0 AS schedule, ts, event_id,
       event_id % 9 AS depth, {BATCH_SQL} AS batch FROM ({GOOD}) WHERE type = 'update_score'"""
_QUEUED = f"""SELECT batch, fingerprint, arg_max(url, (ts, event_id)) AS url, arg_max(score, (ts, event_id)) AS score, max(ts) AS created_at,
       arg_max(depth, (ts, event_id)) AS depth FROM ({_UPDATES}) GROUP BY batch, fingerprint HAVING arg_max(schedule, (ts, event_id))"""
_RANKED = f"""SELECT *, {sg.host_partition('url', 2)} AS partition_id,
       row_number() OVER (PARTITION BY {sg.host_partition('url', 2)} ORDER BY score DESC, created_at, fingerprint) AS place
FROM ({_QUEUED}) WHERE batch = 0"""


def _score_store(spark, sf_dir):
    """Scores in three batches; after the first, the best rows of both partitions are taken, twice with one batch id."""
    store = FS.open_store(spark, scratch_path(spark, "frontier"), groups=8, spread=2)
    d = S.events_of(decoded(spark, sf_dir), "update_score")
    parts = _batches(d.select(url_fingerprint("url").alias("fingerprint"), "url", "score", "schedule", "ts",
                              (F.col("offset") % 9).cast("int").alias("depth"), "offset"))
    FS.apply_scores(store, parts[0], 0)
    FS.take_batch(store, [0, 1], 0, "2024-02-01", TAKEN)
    taken = FS.take_batch(store, [0, 1], 0, "2024-02-01", TAKEN)
    FS.apply_scores(store, parts[1], 1)
    FS.apply_scores(store, parts[2], 2)
    return store, taken


@register("f9_store_queue", f"""
WITH r AS ({_RANKED})
SELECT partition_id, fingerprint, url, score, created_at, CAST(depth AS SMALLINT) AS depth FROM r
WHERE place > {TAKEN} AND fingerprint NOT IN (SELECT fingerprint FROM r WHERE place <= {TAKEN})
UNION ALL SELECT {sg.host_partition('url', 2)}, fingerprint, url, score, created_at, CAST(depth AS SMALLINT) FROM ({_QUEUED}) WHERE batch > 0""")
def f9_store_queue(spark, sf_dir):
    return _score_store(spark, sf_dir)[0].read("queue").drop("host_crc32")


@register("f9_store_scores", f"""
SELECT fingerprint, arg_max(score, (ts, event_id)) AS score FROM ({_UPDATES}) GROUP BY fingerprint""")
def f9_store_scores(spark, sf_dir):
    return _score_store(spark, sf_dir)[0].read("metadata").select("fingerprint", "score")


@register("f6_store_taken", f"""
SELECT partition_id, fingerprint, url, score, CAST(1 AS SMALLINT) AS state FROM ({_RANKED}) WHERE place <= {TAKEN}""")
def f6_store_taken(spark, sf_dir):
    store, taken = _score_store(spark, sf_dir)
    return taken.select("partition_id", "fingerprint", "url", "score").join(store.read("states").drop("ts"), "fingerprint")


# Fetches of the event log as a feed in time order: at the end the watermark stands an hour before the last fetch.
@register("f8_stream_due", f"""
WITH f AS (SELECT {sg.url_fingerprint('url')} AS fingerprint, arg_max(url, (ts, url)) AS url, max(ts) AS fetched_at FROM ({GOOD}) WHERE type = 'page_crawled' GROUP BY 1)
SELECT * FROM f WHERE fetched_at <= (SELECT max(fetched_at) FROM f) - INTERVAL 1 HOUR - INTERVAL 3 DAY""")
def f8_stream_due(spark, sf_dir):
    d = S.decode_events(I.messages(spark, sf_dir), "page_crawled")
    fetches = d.select(url_fingerprint("url").alias("fingerprint"), "url", F.col("ts").cast("timestamp").alias("fetched_at"))
    feed, out = I.feed_in_order(spark, fetches, "fetched_at", 3, I.FEED_FILES), scratch_path(spark, "due")
    stream = spark.readStream.schema(fetches.schema).option("maxFilesPerTrigger", I.FEED_FILES).parquet(feed)
    RV.stream_due(stream, out, scratch_path(spark, "due-ckpt"), late_after="1 hour").awaitTermination()
    return RV.read_due(spark, out).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


# Paths of the link tree, its edges in two batches: first those of every third child, most of them out of reach, then the
# rest, which bring the reached part together.
@register("j4_stored_paths", PATHS_SQL)
def j4_stored_paths(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select("page_id", "url")
    edges = I.tree_edges(spark, sf_dir).join(pages.select(F.col("page_id").alias("child_id"), F.col("url").alias("child_url")), "child_url")
    store = PS.open_paths(spark, scratch_path(spark, "path-store"), groups=8)
    seeds = pages.where("page_id = 0").select("url")
    PS.add_paths(store, seeds, edges.where("child_id % 3 = 0"), 0)
    PS.add_paths(store, seeds.limit(0), edges.where("child_id % 3 != 0"), 1)
    return PS.read_paths(store)


# ------------------------------------------------------------- message log
def _log(spark, sf_dir):
    """All messages through the sink, in three micro-batches."""
    path = scratch_path(spark, "log")
    m = I.messages(spark, sf_dir).select("key", "value", "partition", F.col("offset").alias("sequence"), F.col("ts").cast("timestamp").alias("timestamp"))
    feed = I.feed_in_order(spark, m, "sequence", 3, I.FEED_FILES)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", I.FEED_FILES).parquet(feed)
    S.write_spider_log(stream, path, scratch_path(spark, "log-ckpt"), 2).awaitTermination()
    return path


def _request_sql(url, fp):
    return (f"'{{\"url\":\"' || {url} || '\",\"method\":\"GET\",\"headers\":{{}},\"cookies\":{{}},\"meta\":{{\"domain\":{{' "
            f"|| coalesce('\"fingerprint\":\"' || {fp} || '\"', '') || '}}}}}}'")


_LINK_URL = "'http://h' || (user_id + k) % 17 || '.example.org/l/' || event_id || '/' || k"
_LINK_FP = "CASE WHEN k < 2 THEN sha1('h' || (user_id + k) % 17 || '.example.org') END"
VALUES_SQL = f"""
SELECT event_id, user_id, host, type, CASE type
  WHEN 'page_crawled' THEN '{{"type":"page_crawled","r":{{"url":"' || url || '","status_code":'
    || CASE WHEN CAST(floor(value) AS BIGINT) % 5 = 0 THEN 500 ELSE 200 END || ',"meta":{{"domain":{{"fingerprint":"' || sha1(host)
    || '"}}}},"body":"' || to_base64(encode(props)) || '"}}}}'
  WHEN 'links_extracted' THEN '{{"type":"links_extracted","r":' || {_request_sql('url', 'sha1(host)')} || ',"links":['
    || list_aggregate(list_transform(range(0, event_id % 3 + 1), lambda k: {_request_sql(_LINK_URL, _LINK_FP)}), 'string_agg', ',') || ']}}'
  WHEN 'request_error' THEN '{{"type":"request_error","r":' || {_request_sql('url', 'sha1(host)')} || ',"error":"err' || event_id % 4 || '"}}'
  WHEN 'update_score' THEN '{{"type":"update_score","r":' || {_request_sql('url', 'sha1(host)')} || ',"score":' || CASE WHEN value > 0 AND value < 0.1 THEN round(value * 100)::INTEGER || '.0E-4' ELSE (value / 100.0)::VARCHAR END
    || ',"schedule":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}'
  WHEN 'offset' THEN '{{"type":"offset","partition_id":' || user_id % 2 || ',"offset":' || event_id || '}}' END AS whole
FROM ({I.EVENT_ROWS_SQL})"""


@register("k4_spider_log_values", f"""
SELECT CAST(user_id % 2 AS INTEGER) AS partition, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS offset,
       CASE WHEN type = 'offset' THEN {sg.q(S.OFFSET_KEY)} ELSE sha1(host) END AS key_text,
       CASE WHEN event_id % 97 = 0 THEN left(whole, length(whole) // 2) ELSE whole END AS value
FROM ({VALUES_SQL})""")
def k4_spider_log_values(spark, sf_dir):
    """Keys, values and places of all messages in the log, of every kind and the cut ones too."""
    return S.read_whole_log(spark, _log(spark, sf_dir)).select("partition", "offset", F.col("key").cast("string").alias("key_text"),
                                                               F.col("value").cast("string").alias("value"))


@register("s5_log_offsets", f"""
SELECT CAST(user_id % 2 AS INTEGER) AS partition_id, arg_max(event_id, (ts, event_id)) AS offset, max(ts) AS ts
FROM ({GOOD}) WHERE type = 'offset' GROUP BY user_id % 2""")
def s5_log_offsets(spark, sf_dir):
    """A3 over a log that is polled, with a restart: a bounded poll, then a new query on the same checkpoint."""
    path, out, ckpt = (scratch_path(spark, n) for n in ("log", "polled", "poll-ckpt"))
    path = _log(spark, sf_dir)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for most in (1000, None):
        polls = S.read_log(spark, path, [0, 1], most).writeStream.option("checkpointLocation", ckpt).foreachBatch(keep)
        polls.trigger(availableNow=True).start().awaitTermination()
    good, _ = S.decode_spider_log(spark.read.parquet(out).drop("batch_id", "offset", "partition"))
    offsets = S.events_of(good, "offset").select("partition_id", F.col("event_offset").alias("offset"), F.col("timestamp").cast("timestamp_ntz").alias("ts"))
    return Q.latest_offsets(offsets)
