"""Spider-log events: encode (K4), read (S5), decode (E1), split bad messages
(E2, E3), route by type (E4), bare requests (E5), extracted links (E6) and
per-interval stats (A4). The same functions serve batch and streaming
DataFrames; ``streaming.jobs`` wires them into continuous queries (E7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import once

# The event types of the spider log.
EVENT_TYPES = ["page_crawled", "links_extracted", "request_error", "update_score", "new_job_id",
               "offset", "stats"]
# Fixed value: message key used for offset reports (they concern no host).
OFFSET_KEY = "0123456789abcdef0123456789abcdef012345678"

DOMAIN = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("name", T.StringType()),
                       T.StructField("netloc", T.StringType())])
META = T.StructType([
    T.StructField("domain", DOMAIN),
    T.StructField("hop_path", T.StringType()), T.StructField("hop", T.StringType()),
    T.StructField("via", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("link_text", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("state", T.IntegerType()), T.StructField("score", T.DoubleType()),
])
HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
COOKIES = T.MapType(T.StringType(), T.StringType())
REQUEST = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("headers", HEADERS), T.StructField("cookies", COOKIES), T.StructField("meta", META),
])
RESPONSE_OR_REQUEST = T.StructType(REQUEST.fields + [
    T.StructField("status_code", T.IntegerType()), T.StructField("body", T.StringType())])
def _schema(*fields: T.StructField) -> T.StructType:
    return T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])


_R = T.StructField("r", REQUEST)
# what a message of each type is parsed into, and nothing else
SCHEMAS = {
    "page_crawled": _schema(T.StructField("r", RESPONSE_OR_REQUEST)),
    "links_extracted": _schema(_R, T.StructField("links", T.ArrayType(REQUEST))),
    "request_error": _schema(_R, T.StructField("error", T.StringType())),
    "update_score": _schema(_R, T.StructField("score", T.DoubleType()), T.StructField("schedule", T.BooleanType())),
    # ids come as numbers or as their text
    "new_job_id": _schema(T.StructField("job_id", T.StringType())),
    "offset": _schema(T.StructField("partition_id", T.StringType()), T.StructField("offset", T.StringType())),
    "stats": _schema(T.StructField("stats", T.MapType(T.StringType(), T.StringType()))),
}
_TYPE_FIRST_RE = r'^\s*\{\s*"type"\s*:\s*"([a-z_]+)"'
REQUEST_MSG = T.StructType(REQUEST.fields + [T.StructField("_corrupt_record", T.StringType())])
MESSAGE = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


# ------------------------------------------------------------------ reading
def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                  schema: T.StructType = MESSAGE) -> DataFrame:
    """A stream of keyed messages from files dropped in ``path`` (tests and
    local runs); bounded per micro-batch like a poll of N messages."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def read_log(spark: SparkSession, path: str, partitions=None, max_messages: int | None = 2048, starting="earliest") -> DataFrame:
    """A stream of keyed messages from a message log: all or some partitions, at most N messages per poll, offsets
    per partition kept in the query's checkpoint."""
    from ..sources.message_log import MessageLog

    spark.dataSource.register(MessageLog)
    r = spark.readStream.format("message_log").option("path", path).option("startingOffsets", starting)
    if partitions is not None:
        r = r.option("partitions", ",".join(str(p) for p in partitions))
    if max_messages:
        r = r.option("maxMessages", max_messages)
    return r.load()


def read_whole_log(spark: SparkSession, path: str) -> DataFrame:
    """All messages of a log, as a batch."""
    from ..sources.message_log import MessageLog

    spark.dataSource.register(MessageLog)
    return spark.read.format("message_log").option("path", path).load()


# ------------------------------------------------------------------ decoding
def type_of(raw) -> Column:
    """The type of a message: read off its beginning where it comes first, else looked up; null if there is none or the
    message is cut. Only a whole message's type counts, which the parse that follows checks."""
    first = F.regexp_extract(raw, _TYPE_FIRST_RE, 1)
    return F.when(first != "", first).otherwise(F.get_json_object(raw, "$.type"))


def _typed(raw: Column, kind: Column) -> Column:
    """Struct with a field per event type, parsed with that type's schema for messages of the type and null for others."""
    return F.struct(*[F.when(kind == t, F.from_json(raw, s, _JSON_OPTS)).alias(t) for t, s in SCHEMAS.items()])


def _numbers(parsed: Column, names: list[str]) -> tuple[dict[str, Column], Column]:
    """Ids as numbers, and whether one that is there is none."""
    values = {n: parsed[n].try_cast("bigint") for n in names}
    bad = F.lit(False)
    for n, v in values.items():
        bad = bad | (parsed[n].isNotNull() & v.isNull())
    return values, bad


def _variant(path: str) -> Column:
    return F.try_parse_json(F.get_json_object(F.col("_raw"), path))


def decode_spider_log(messages: DataFrame, strict: bool = False, value_col: str = "value"):
    """JSON bytes -> typed columns. Returns (good, bad).

    A message is parsed once, with the narrow schema of its type, which is read first; a body is decoded once.
    Undecodable messages, bodies that are no base64, ids that are no numbers and
    unknown types go to ``bad`` with the raw text and a reason; the batch
    continues. With ``strict`` an unknown type fails the job, as the original
    decoder raised on it.

    ``meta`` holds the meta keys that jobs here read, typed; ``meta_all`` and
    ``stats_all`` are the whole objects as VARIANT, any key and nesting kept
    (parsed from the message again, and only where they are selected).
    """
    raw = F.col(value_col).cast("string")
    df = messages.select("*", raw.alias("_raw")).select("*", once(type_of(F.col("_raw"))).alias("_type"))
    known = F.coalesce(F.col("_type").isin(EVENT_TYPES), F.lit(False))
    df = df.select("*", once(_typed(F.col("_raw"), F.col("_type"))).alias("_e"))
    e = {t: F.col("_e")[t] for t in EVENT_TYPES}
    r = [e[t]["r"] for t in ("page_crawled", "links_extracted", "request_error", "update_score")]
    broken = [e[t].isNull() | e[t]["_corrupt_record"].isNotNull() for t in EVENT_TYPES]
    corrupt = F.lit(False)
    for t, b in zip(EVENT_TYPES, broken):
        corrupt = corrupt | ((F.col("_type") == t) & b)
    # of an unknown or missing type: is it JSON at all?
    whole = F.from_json(F.col("_raw"), _schema(T.StructField("type", T.StringType())), _JSON_OPTS)
    corrupt = F.when(known, corrupt).otherwise(F.col("_raw").isNull() | whole.isNull() | whole["_corrupt_record"].isNotNull())
    body = F.try_to_binary(e["page_crawled"]["r"]["body"], F.lit("base64"))
    df = df.select("*", once(F.struct(corrupt.alias("corrupt"), body.alias("body"))).alias("_d"))
    corrupt = F.col("_d.corrupt")
    if strict:
        known = F.when(corrupt | known, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("Unknown message type: "), F.coalesce(F.col("_type"), F.lit("null"))))
            .cast("boolean"))
    jobs, bad_job = _numbers(e["new_job_id"], ["job_id"])
    offsets, bad_offset = _numbers(e["offset"], ["partition_id", "offset"])
    bad_body = e["page_crawled"]["r"]["body"].isNotNull() & F.col("_d.body").isNull()
    reason = (F.when(corrupt, F.lit("undecodable")).when(~known, F.lit("unknown type"))
              .when(bad_body, F.lit("undecodable body"))
              .when(F.coalesce(bad_job, F.lit(False)) | F.coalesce(bad_offset, F.lit(False)), F.lit("id is no number")))
    keep = [c for c in messages.columns if c != value_col]
    df = df.select("*", once(reason).alias("_reason"))
    bad = df.where(F.col("_reason").isNotNull()).select(*keep, F.col("_raw").alias("raw"), F.col("_reason").alias("reason"))
    of_request = lambda field: F.coalesce(*[x[field] for x in r])
    good = df.where(F.col("_reason").isNull()).select(
        *keep,
        F.col("_type").alias("type"),
        of_request("url").alias("url"),
        of_request("method").alias("method"),
        e["page_crawled"]["r"]["status_code"].alias("status_code"),
        F.col("_d.body").alias("body"),
        of_request("headers").alias("headers"),
        of_request("cookies").alias("cookies"),
        of_request("meta").alias("meta"),
        e["links_extracted"]["links"].alias("links"),
        e["request_error"]["error"].alias("error"),
        e["update_score"]["score"].alias("score"),
        e["update_score"]["schedule"].alias("schedule"),
        jobs["job_id"].alias("job_id"),
        offsets["partition_id"].cast("int").alias("partition_id"),
        offsets["offset"].alias("event_offset"),
        e["stats"]["stats"].alias("stats"),
        _variant("$.r.meta").alias("meta_all"),
        _variant("$.stats").alias("stats_all"),
    )
    return good, bad


def decode_events(messages: DataFrame, event_type: str, value_col: str = "value") -> DataFrame:
    """E4 straight from the messages: the good events of one type, as ``events_of`` gives them.

    Messages of other types are not parsed; of those of the type only what the view returns (``decode_spider_log`` has
    the ones that are set aside).
    """
    if event_type not in SCHEMAS:
        raise ValueError(f"unknown event type {event_type}")
    keep = [c for c in messages.columns if c != value_col]
    df = messages.select(*keep, F.col(value_col).cast("string").alias("_raw"))
    df = df.select("*", once(type_of(F.col("_raw"))).alias("_type")).where(F.col("_type") == event_type)
    df = df.select("*", once(F.from_json(F.col("_raw"), SCHEMAS[event_type], _JSON_OPTS)).alias("_e"))
    e = F.col("_e")
    good = e.isNotNull() & e["_corrupt_record"].isNull()
    own: dict[str, Column] = {"meta_all": _variant("$.r.meta"), "stats_all": _variant("$.stats")}
    if event_type in ("new_job_id", "offset"):
        names = [f for f in SCHEMAS[event_type].fieldNames() if f != "_corrupt_record"]
        numbers, bad = _numbers(e, names)
        good = good & ~bad
        own |= {"job_id": numbers.get("job_id"), "event_offset": numbers.get("offset")}
        own["partition_id"] = numbers["partition_id"].cast("int") if "partition_id" in numbers else None
    df = df.where(good)
    if event_type == "page_crawled":
        df = df.select("*", once(F.try_to_binary(e["r"]["body"], F.lit("base64"))).alias("_body")).where(
            e["r"]["body"].isNull() | F.col("_body").isNotNull())
        own["body"] = F.col("_body")
    top = SCHEMAS[event_type].fieldNames()
    columns = []
    for c in VIEWS[event_type]:
        found = own.get(c)
        columns.append((found if found is not None else e[c] if c in top else e["r"][c]).alias(c))
    return df.select(*keep, *columns)


VIEWS = {
    "page_crawled": ["url", "status_code", "body", "meta", "meta_all"],
    "links_extracted": ["url", "method", "headers", "cookies", "meta", "meta_all", "links"],
    "request_error": ["url", "method", "headers", "cookies", "meta", "meta_all", "error"],
    "update_score": ["url", "method", "meta", "meta_all", "score", "schedule"],
    "new_job_id": ["job_id"],
    "offset": ["partition_id", "event_offset"],
    "stats": ["stats", "stats_all"],
}


def events_of(decoded: DataFrame, event_type: str) -> DataFrame:
    """The typed view of one event kind, with only its own columns."""
    base = [c for c in decoded.columns if c not in
            ("type", "url", "method", "status_code", "body", "headers", "cookies", "meta", "links", "error",
             "score", "schedule", "job_id", "partition_id", "event_offset", "stats", "meta_all", "stats_all")]
    return decoded.where(F.col("type") == event_type).select(*base, *VIEWS[event_type])


def decode_requests(messages: DataFrame, value_col: str = "value"):
    """E5: bare requests of the feed. Returns (good, bad): undecodable messages
    are set aside and the batch continues."""
    raw = F.col(value_col).cast("string")
    df = messages.select("*", raw.alias("_raw")).select(
        "*", once(F.from_json(F.col("_raw"), REQUEST_MSG, _JSON_OPTS)).alias("_r"))
    bad_c = F.col("_r._corrupt_record").isNotNull() | F.col("_r").isNull() | F.col("_r.url").isNull()
    keep = [c for c in messages.columns if c != value_col]
    good = df.where(~bad_c).select(*keep, "_r.url", "_r.method", "_r.headers", "_r.cookies", "_r.meta")
    bad = df.where(bad_c).select(*keep, F.col("_raw").alias("raw"))
    return good, bad


def links_of(decoded: DataFrame) -> DataFrame:
    """One row per extracted link of ``links_extracted`` events, in order."""
    keep = [c for c in decoded.columns if c not in ("links", "type", "url", "meta", "method", "headers", "cookies")]
    src = decoded.where(F.col("type") == "links_extracted")
    return src.select(*keep, F.col("url").alias("source_url"),
                      F.posexplode_outer(F.col("links")).alias("pos", "_l")) \
        .where(F.col("_l").isNotNull()) \
        .select(*keep, "source_url", F.col("pos").cast("int").alias("pos"), F.col("_l.url").alias("url"),
                F.col("_l.meta.domain.fingerprint").alias("host_fp"), F.col("_l.method").alias("method"))


def crawl_stats(decoded: DataFrame, interval: str = "10 seconds", ts_col: str = "ts") -> DataFrame:
    """A4: events per type per tumbling interval (watermark it on a stream)."""
    return decoded.groupBy(F.window(F.col(ts_col), interval).alias("w"), "type").agg(
        F.count(F.lit(1)).alias("n_events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "type", "n_events")


def carried_stats(decoded: DataFrame, ts_col: str = "ts") -> DataFrame:
    """A4, the numbers that ``stats`` events carry: per name their number, sum,
    and latest value (by time, then value). Values that are no numbers count in
    ``n_events`` only."""
    rows = events_of(decoded, "stats").select(F.col(ts_col).alias("_ts"), F.explode_outer("stats").alias("name", "_v"))
    rows = rows.where(F.col("name").isNotNull()).withColumn("_v", F.col("_v").try_cast("double"))
    return rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("_v").alias("total"),
        F.max(F.when(F.col("_v").isNotNull(), F.struct("_ts", "_v"))).getField("_v").alias("latest"))


# ------------------------------------------------------------------ encoding
def request_struct(url: Column, meta: Column, method: Column | None = None) -> Column:
    return F.struct(url.alias("url"), (method if method is not None else F.lit("GET")).alias("method"),
                    F.create_map().cast(HEADERS).alias("headers"), F.create_map().cast(COOKIES).alias("cookies"),
                    meta.alias("meta"))


def domain_meta(host_fp: Column) -> Column:
    """meta with the domain fingerprint (an empty domain when there is none)."""
    return F.struct(F.struct(host_fp.alias("fingerprint")).alias("domain"))


def encode_event(event_type: Column, url: Column, host_fp: Column, status_code=None, body=None, links=None,
                 error=None, score=None, schedule=None, job_id=None, partition_id=None, offset=None,
                 stats=None) -> Column:
    """K4: one spider-log event as JSON text, shaped by its type."""
    null = lambda t: F.lit(None).cast(t)
    status_code = status_code if status_code is not None else null("int")
    body = body if body is not None else null("string")
    links = links if links is not None else null(T.ArrayType(REQUEST))
    error = error if error is not None else null("string")
    score = score if score is not None else null("double")
    schedule = schedule if schedule is not None else null("boolean")
    job_id = job_id if job_id is not None else null("bigint")
    partition_id = partition_id if partition_id is not None else null("int")
    offset = offset if offset is not None else null("bigint")
    stats = stats if stats is not None else null(T.MapType(T.StringType(), T.StringType()))
    req = request_struct(url, domain_meta(host_fp))
    resp = F.struct(url.alias("url"), F.coalesce(status_code, F.lit(200)).alias("status_code"),
                    domain_meta(host_fp).alias("meta"), body.alias("body"))
    t = event_type
    lit_t = lambda s: F.lit(s).alias("type")
    return (F.when(t == "page_crawled", F.to_json(F.struct(lit_t("page_crawled"), resp.alias("r"))))
            .when(t == "links_extracted", F.to_json(F.struct(lit_t("links_extracted"), req.alias("r"),
                                                             links.alias("links"))))
            .when(t == "request_error", F.to_json(F.struct(lit_t("request_error"), req.alias("r"),
                                                           error.alias("error"))))
            .when(t == "update_score", F.to_json(F.struct(lit_t("update_score"), req.alias("r"),
                                                          score.alias("score"), schedule.alias("schedule"))))
            .when(t == "new_job_id", F.to_json(F.struct(lit_t("new_job_id"), job_id.alias("job_id"))))
            .when(t == "offset", F.to_json(F.struct(lit_t("offset"), partition_id.alias("partition_id"),
                                                    offset.alias("offset"))))
            .when(t == "stats", F.to_json(F.struct(lit_t("stats"), stats.alias("stats")))))


def spider_log_key(event_type: Column, host_fp: Column) -> Column:
    """K4 key: host fingerprint (null without one); offsets share one constant key."""
    return F.when(event_type == "offset", F.lit(OFFSET_KEY)).otherwise(host_fp).cast("binary")


def write_spider_log(messages: DataFrame, path: str, checkpoint: str, partitions: int, writer: str = "writer", trigger: dict | None = None):
    """K4: a stream of messages (key, value, partition, and ``sequence`` to order them by) appended to a message log.

    A partition's messages go through one task of each micro-batch, which keeps them in order; more partitions are
    more parallel. Spark sorts a micro-batch (and spills), so that the tasks write messages as they come. Each
    micro-batch comes in whole, and once.
    """
    from ..sources.message_log import MessageLog

    order = [F.asc_nulls_last(c) for c in ("partition", "sequence") if c in messages.columns]

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.repartition(partitions, "partition")
        rows = rows.sortWithinPartitions(*order) if "sequence" in batch.columns else rows
        rows.write.format("message_log").mode("append").options(path=path, writer=writer, batch=batch_id, inOrder=True).save()

    messages.sparkSession.dataSource.register(MessageLog)
    w = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def event_facts(decoded: DataFrame, fingerprint) -> DataFrame:
    """One row per fact an event carries, from a single decode: its own request
    (crawl / error / scheduled score) and every extracted link.

    Output (fingerprint, kind, url, depth, status_code, error, state, ts);
    ``fingerprint`` is a function url-column -> fingerprint column.
    """
    t = F.col("type")
    own_kind = (F.when(t == "page_crawled", F.lit("crawl")).when(t == "request_error", F.lit("error"))
                .when((t == "update_score") & F.col("schedule"), F.lit("queued")))
    own_state = F.when(t == "page_crawled", F.lit(2)).when(t == "request_error", F.lit(3)).when(
        (t == "update_score") & F.col("schedule"), F.lit(1))

    def fact(url, kind, depth, status, error, state):
        return F.struct(fingerprint(url).alias("fingerprint"), kind.alias("kind"), url.alias("url"),
                        depth.cast("int").alias("depth"), status.cast("int").alias("status_code"),
                        error.cast("string").alias("error"), state.cast("smallint").alias("state"))

    own = F.when(own_kind.isNotNull(), F.array(fact(F.col("url"), own_kind, F.lit(None), F.col("status_code"),
                                                    F.col("error"), own_state)))
    links = F.transform(F.coalesce(F.col("links"), F.array().cast(T.ArrayType(REQUEST))),
                        lambda l: fact(l["url"], F.lit("link"), F.lit(1), F.lit(None), F.lit(None), F.lit(0)))
    all_facts = F.concat(F.coalesce(own, F.array().cast(T.ArrayType(_FACT))), links)
    # explode_outer + filter: no inferred size() filter re-running the fingerprints
    return decoded.select("ts", F.explode_outer(all_facts).alias("_f")).where(F.col("_f").isNotNull()) \
        .select("_f.*", "ts")


_FACT = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("kind", T.StringType()),
                      T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType()),
                      T.StructField("status_code", T.IntegerType()), T.StructField("error", T.StringType()),
                      T.StructField("state", T.ShortType())])
