"""Frontier tables as DataFrames: queue building and host partitioning (F1-F3),
seen filter (J1), next batch (F4, F5), consuming a batch (F6), per-host caps
(F7), revisit due (F8), score updates (F9), peeks (F10), links grouped per
target host (A1), offsets (A3), domain metadata (A5), metadata and state
updates from events (J5, J6) and resetting the frontier database (K3).

Top-N per group is written as ``row_number() <= n`` so Catalyst inserts a
partial ``WindowGroupLimit`` below the shuffle: each map task keeps at most
n rows per group, so even a host or partition holding a third of the queue
ships only n rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import host_crc32, host_partition, url_fingerprint, url_host

# Configured frontier sizes.
QUEUE_PARTITIONS = 2
BATCH_SIZE = 2048
PAGES_PER_HOST = 10
REVISIT_INTERVAL = "3 days"

# URL states (SMALLINT in the states table).
NOT_CRAWLED, QUEUED, CRAWLED, ERROR = 0, 1, 2, 3

# Named batch orders: best score first, or breadth-first (shallow first, FIFO).
ORDERS = {
    "score": [("score", "desc"), ("created_at", "asc"), ("fingerprint", "asc")],
    "bfs": [("depth", "asc"), ("created_at", "asc"), ("fingerprint", "asc")],
}


def _order(order) -> list:
    if not isinstance(order, str):
        return list(order)
    return [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in ORDERS[order]]


def to_queue(requests: DataFrame, partitions: int = QUEUE_PARTITIONS) -> DataFrame:
    """Queue rows from requests (url, score, created_at, depth, ...):
    fingerprint (F1), host CRC-32 and the host's partition (F3)."""
    extra = [c for c in ("method", "meta", "headers", "cookies") if c in requests.columns]
    return requests.select(
        host_partition(F.col("url"), partitions).alias("partition_id"),
        F.col("score").cast("double").alias("score"),
        F.col("url"),
        url_fingerprint(F.col("url")).alias("fingerprint"),
        host_crc32(F.col("url")).alias("host_crc32"),
        F.col("created_at"),
        F.col("depth").cast("smallint").alias("depth"),
        *extra)


def assign_partition(df: DataFrame, n: int = QUEUE_PARTITIONS, url_col: str = "url") -> DataFrame:
    """partition id by host; every URL of a host lands in one partition."""
    return df.withColumn("partition_id", host_partition(F.col(url_col), n))

SALTS = 32  # parts of one queue partition in the first step of a batch's top-n


def write_queue(queue: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the queue partitioned by ``partition_id`` so a batch read prunes to its partitions.

    The rebalance keeps files few and lets Spark split a partition that is too
    large for one task.
    """
    queue.hint("rebalance", "partition_id").write.mode(mode).partitionBy("partition_id").parquet(path)


def filter_unseen(candidates: DataFrame, seen: DataFrame, key: str = "fingerprint",
                  order=("created_at", "url")) -> DataFrame:
    """Candidates never requested before, one per fingerprint (the earliest).

    The per-key pick is a group-by (partial aggregate map-side, so a hot key
    costs one row per task); the seen set is an anti-join, broadcast by AQE
    only when it is measured small, sort-merge otherwise. Only ``order`` is
    compared, so the other columns may be of any type (headers and cookies are
    maps); rows that agree in all of it are interchangeable.
    """
    cols = [c for c in candidates.columns if c != key]
    firsts = candidates.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_f"))
    firsts = firsts.select(key, *[F.col(f"_f.{c}").alias(c) for c in cols])
    return firsts.join(seen.select(key).distinct(), key, "left_anti")


def check_partitions(partitions, n_partitions: int = QUEUE_PARTITIONS) -> list[int]:
    parts = list(partitions)
    for p in parts:
        if p < 0 or p >= n_partitions:
            raise ValueError(f"partition id {p} is outside 0 to {n_partitions - 1}")
    return parts


def next_batch(queue: DataFrame, partitions, n: int = BATCH_SIZE, order: str | list = "score",
               n_partitions: int = QUEUE_PARTITIONS) -> DataFrame:
    """up to ``n`` best rows of each requested partition, concatenated.

    The partition filter is pushed to a ``partitionBy('partition_id')`` layout
    (partition pruning). The top-n is taken in two steps, first of (partition,
    salt) and then of partition, each with a partial ``WindowGroupLimit`` before
    its shuffle: the last task gets at most ``n`` rows per salt, however many
    tasks read the queue.
    """
    parts = check_partitions(partitions, n_partitions)
    ords = _order(order)
    salted = Window.partitionBy("partition_id", "_salt").orderBy(*ords)
    w = Window.partitionBy("partition_id").orderBy(*ords)
    return (queue.where(F.col("partition_id").isin(parts))
            .withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)))
            .withColumn("_rn", F.row_number().over(salted)).where(F.col("_rn") <= n).drop("_rn")
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_salt"))


def consume_batch(queue: DataFrame, batch: DataFrame, states: DataFrame | None = None):
    """remaining queue (every row of the batch's fingerprints removed) and
    the states table with the batch marked queued (upsert: new state wins)."""
    remaining = queue.join(batch.select("fingerprint").distinct(), "fingerprint", "left_anti")
    marked = batch.select("fingerprint", F.lit(QUEUED).cast("smallint").alias("state")).distinct()
    if states is None:
        return remaining, marked
    kept = states.join(marked.select("fingerprint"), "fingerprint", "left_anti")
    return remaining, kept.unionByName(marked)


def cap_per_host(df: DataFrame, n: int = PAGES_PER_HOST, host_col: str = "host",
                 order: str | list = "score") -> DataFrame:
    """at most ``n`` rows per host, best first (partial group limit before the shuffle)."""
    if host_col not in df.columns:
        df = df.withColumn(host_col, url_host(F.col("url")))
    ords = _order(order)
    w = Window.partitionBy(host_col).orderBy(*ords)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def fair_batch(queue: DataFrame, partitions, n: int = BATCH_SIZE, per_host: int = PAGES_PER_HOST, order: str | list = "score",
               n_partitions: int = QUEUE_PARTITIONS, host_col: str = "host_crc32") -> DataFrame:
    """F7 buffer limits: up to ``n`` rows of each partition, at most ``per_host`` of a host, and no host's second-best row
    before every host's best (rank inside the host first, then ``order``).

    Every limit is taken in two steps, over salted parts and then over the whole, each with a partial group limit before
    its shuffle: of a host that holds most of the queue, each task hands on at most ``per_host`` rows per salt.
    """
    parts = check_partitions(partitions, n_partitions)
    ords = _order(order)

    def limited(df: DataFrame, keys: list[str], by: list, most: int, rank: str) -> DataFrame:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(rank) <= most)

    q = queue.where(F.col("partition_id").isin(parts)).withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)))
    q = limited(q, [host_col, "_salt"], ords, per_host, "_rank").drop("_rank")
    q = limited(q, [host_col], ords, per_host, "_rank")
    fair = [F.col("_rank").asc(), *ords]
    q = limited(q, ["partition_id", "_salt"], fair, n, "_rn").drop("_rn")
    return limited(q, ["partition_id"], fair, n, "_rn").drop("_rn", "_salt", "_rank")


def due_for_revisit(metadata: DataFrame, now, interval: str = REVISIT_INTERVAL) -> DataFrame:
    """F8: never fetched, or fetched at least ``interval`` before ``now`` (a parameter)."""
    now_c = now if isinstance(now, Column) else F.lit(now)
    limit = now_c - F.expr(f"INTERVAL {interval}")
    return metadata.where(F.col("fetched_at").isNull() | (F.col("fetched_at") <= limit))


def latest_by_key(df: DataFrame, key: str, ts_col: str, cols: list[str], tie: str | None = None) -> DataFrame:
    """Last write per key: ``max_by`` over a struct, a partial/final aggregate."""
    order = F.struct(F.col(ts_col), *([F.col(tie)] if tie else []))
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_v")).select(
        key, *[F.col(f"_v.{c}").alias(c) for c in cols])


def apply_scores(metadata: DataFrame, queue: DataFrame, updates: DataFrame, partitions: int = QUEUE_PARTITIONS):
    """the latest score of a fingerprint becomes the metadata score (a URL
    that metadata does not know yet gets a row); updates with ``schedule`` true
    are appended to the queue (one row per fingerprint, at the update's depth).

    updates: (fingerprint, url, score, schedule, ts[, depth][, offset]); of
    equal times the larger message offset wins, without offsets the larger
    (score, url). Returns (metadata, queue).
    """
    depth = F.col("depth") if "depth" in updates.columns else F.lit(0)
    tie = ["offset"] if "offset" in updates.columns else ["score", "url"]
    last = (updates.withColumn("_depth", depth.cast("int")).groupBy("fingerprint")
            .agg(F.max_by(F.struct("url", "score", "schedule", "ts", "_depth"), F.struct("ts", *tie)).alias("_u")))
    known = {"url": "_u.url", "created_at": "_u.ts", "depth": "_u._depth"}
    joined = metadata.join(last, "fingerprint", "full_outer")
    md = joined.select(*[
        F.coalesce("_u.score", c).alias(c) if c == "score"
        else F.coalesce(F.col(c), F.col(known[c]).cast(metadata.schema[c].dataType)).alias(c) if c in known
        else F.col(c) for c in metadata.columns])
    sched = last.where("_u.schedule").select("_u.url", "_u.score", F.col("_u.ts").alias("created_at"), F.col("_u._depth").alias("depth"))
    return md, queue.unionByName(to_queue(sched, partitions), allowMissingColumns=True)


def peek(df: DataFrame, n: int, order: list) -> DataFrame:
    """first ``n`` rows in key order (a global top-n: each task keeps n)."""
    return df.orderBy(*order).limit(n)


def links_per_host(links: DataFrame, source_col: str | list[str], fp_col: str = "host_fp",
                   pos_col: str = "pos", url_col: str = "url") -> DataFrame:
    """A1: links of each source request grouped by target-host fingerprint, in
    link order; links without a fingerprint are dropped. One row per
    (source, host) -- the unit of one outgoing message keyed by host.

    ``source_col`` must identify one fetch (the message's partition and offset,
    not a URL that is crawled again and again), so a row holds one page's links.
    """
    source_col = [source_col] if isinstance(source_col, str) else list(source_col)
    return (links.where(F.col(fp_col).isNotNull())
            .groupBy(*source_col, fp_col)
            .agg(F.count(F.lit(1)).alias("n_links"),
                 F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("pos"), F.col(url_col).alias("url"))))
                 .alias("links")))


def latest_offsets(offsets: DataFrame) -> DataFrame:
    """A3: last reported offset per partition (by event time, then offset)."""
    return offsets.groupBy("partition_id").agg(
        F.max_by(F.col("offset"), F.struct(F.col("ts"), F.col("offset"))).alias("offset"),
        F.max("ts").alias("ts"))


def domain_metadata(rows: DataFrame, key_col: str = "key", value_cols=("value",), ts_col: str = "ts") -> DataFrame:
    """A5: key -> value, last write wins."""
    return latest_by_key(rows, key_col, ts_col, list(value_cols))


def apply_events(metadata: DataFrame | None, crawled: DataFrame, errors: DataFrame, links: DataFrame) -> DataFrame:
    """Bring the metadata table up to date from one batch of events.

    links (fingerprint, url, depth, ts) insert rows not yet known; crawled
    (fingerprint, url, status_code, ts) set status and fetched_at; errors
    (fingerprint, url, error, ts) set the error. Later events win.
    """
    n = lambda t: F.lit(None).cast(t)
    facts = (links.select("fingerprint", F.lit("link").alias("kind"), "url", F.col("depth").cast("int").alias("depth"),
                          n("int").alias("status_code"), n("string").alias("error"), "ts")
             .unionByName(crawled.select("fingerprint", F.lit("crawl").alias("kind"), "url", n("int").alias("depth"),
                                         F.col("status_code").cast("int").alias("status_code"),
                                         n("string").alias("error"), "ts"))
             .unionByName(errors.select("fingerprint", F.lit("error").alias("kind"), "url", n("int").alias("depth"),
                                        n("int").alias("status_code"), "error", "ts")))
    return apply_event_facts(metadata, facts)


def apply_event_facts(metadata: DataFrame | None, facts: DataFrame) -> DataFrame:
    """J5 core: facts (fingerprint, kind in link/crawl/error, url, depth,
    status_code, error, ts) reduced in ONE group-by per fingerprint
    (conditional min_by/max_by, partial aggregation map-side), then merged
    with the old table by a single full outer join.

    Batches may come in any order and more than once: a stored fetch or error
    is replaced by a later one only (of equal times the larger status, error
    and URL), and an error stands only if it is not older than the last fetch.
    Every other metadata column (score, method, headers, ...) is kept; rows the
    table did not know get nulls there. The result has ``error_at``, the time
    of the error; for stored errors without one the row's creation counts.
    """
    k = F.col("kind")
    of = lambda kind, c: F.when(k == kind, c)
    ev = facts.groupBy("fingerprint").agg(
        F.min_by(F.struct("url", "depth", "ts"), of("link", F.struct("ts", "url", "depth"))).alias("_l"),
        F.max(of("crawl", F.struct("ts", "status_code", "url"))).alias("_c"),
        F.max(of("error", F.struct("ts", "error", "url"))).alias("_e"),
        F.max(of("link", F.lit(1))).alias("_has_l"))
    ev = ev.withColumn("_l", F.when(F.col("_has_l") == 1, F.col("_l"))).drop("_has_l")
    own = [("url", "string"), ("depth", "int"), ("created_at", "timestamp_ntz"), ("fetched_at", "timestamp_ntz"),
           ("status_code", "int"), ("error", "string"), ("error_at", "timestamp_ntz")]
    if metadata is None:
        j = ev.select("*", *[F.lit(None).cast(t).alias(c) for c, t in own])
        extra = []
    else:
        md = metadata if "error_at" in metadata.columns else metadata.withColumn(
            "error_at", F.when(F.col("error").isNotNull(), F.col("created_at")))
        extra = [c for c in metadata.columns if c not in {"fingerprint", *[c for c, _ in own]}]
        j = md.join(ev, "fingerprint", "full_outer")
    newer = lambda new, old: F.col(new).isNotNull() & (F.col(old).isNull() | (F.col(new) >= F.col(old)))
    fetch = newer("_c.ts", "fetched_at") & ~(F.col("_c.ts").eqNullSafe(F.col("fetched_at"))
                                             & F.coalesce(F.col("status_code") > F.col("_c.status_code"), F.lit(False)))
    fail = newer("_e.ts", "error_at") & ~(F.col("_e.ts").eqNullSafe(F.col("error_at"))
                                          & F.coalesce(F.col("error") > F.col("_e.error"), F.lit(False)))
    j = j.select("*", F.when(fetch, F.col("_c.ts")).otherwise(F.col("fetched_at")).alias("_fetched"),
                 F.when(fetch, F.col("_c.status_code")).otherwise(F.col("status_code")).alias("_status"),
                 F.when(fail, F.col("_e.ts")).otherwise(F.col("error_at")).alias("_failed"),
                 F.when(fail, F.col("_e.error")).otherwise(F.col("error")).alias("_error"))
    stands = F.col("_failed").isNotNull() & (F.col("_fetched").isNull() | (F.col("_failed") >= F.col("_fetched")))
    return j.select(
        "fingerprint",
        F.coalesce(F.col("url"), F.col("_l.url"), F.col("_c.url"), F.col("_e.url")).alias("url"),
        F.coalesce(F.col("depth"), F.col("_l.depth"), F.lit(0)).cast("int").alias("depth"),
        F.coalesce(F.col("created_at"), F.col("_l.ts"), F.col("_c.ts"), F.col("_e.ts")).alias("created_at"),
        F.col("_fetched").alias("fetched_at"), F.col("_status").cast("int").alias("status_code"),
        F.when(stands, F.col("_error")).alias("error"), F.when(stands, F.col("_failed")).alias("error_at"), *extra)


def url_states(transitions: DataFrame) -> DataFrame:
    """Current state per fingerprint from (fingerprint, state, ts) transitions:
    the latest transition wins; on equal times the further state wins."""
    return transitions.groupBy("fingerprint").agg(
        F.max_by(F.col("state"), F.struct(F.col("ts"), F.col("state"))).cast("smallint").alias("state"))


def reset_frontier(spark: SparkSession, db: str, tables: dict[str, DataFrame] | None = None) -> None:
    """K3: drop the frontier database with its tables and create it empty
    (optionally saving initial tables)."""
    spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").saveAsTable(f"{db}.{name}")
