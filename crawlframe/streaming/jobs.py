"""Continuous jobs over the spider log (E7): crawl stats, URL states and the
seen filter, as Structured Streaming queries (built-in stateful operators only).

Every query has a checkpoint folder, so a lost executor or a restarted
driver resumes from the last committed micro-batch. Sinks are idempotent:
micro-batch outputs are written under their batch id and replaced on retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def _start(df_writer, trigger: dict | None):
    q = df_writer.trigger(**(trigger or {"availableNow": True})).start()
    return q


def _batch_writer(path: str):
    """foreachBatch sink: each micro-batch lands in ``batch_id=N`` (overwritten on retry)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def stream_crawl_stats(decoded: DataFrame, out_path: str, checkpoint: str, interval: str = "10 seconds",
                       late_after: str = "1 hour", trigger: dict | None = None):
    """A4 continuously: events per type per tumbling window.

    Each micro-batch writes the counts of its own events under its batch id and
    readers add them up, so there is no state to bound and no event is ever
    dropped, however late it comes. ``n_late`` counts the events that were more
    than ``late_after`` older than the newest event of earlier micro-batches.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.parquet(f"{out_path}-newest/batch_id={batch_id - 1}").first()[0]
        ts = F.col("ts").cast("timestamp")
        limit = F.lit(earlier).cast("timestamp") - F.expr(f"INTERVAL {late_after}")
        counts = batch.groupBy(F.window(ts, interval).alias("w"), "type").agg(
            F.count(F.lit(1)).alias("n_events"), F.count_if(F.coalesce(ts < limit, F.lit(False))).alias("n_late"), F.max(ts).alias("max_ts"))
        counts.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        newest = spark.read.parquet(f"{out_path}/batch_id={batch_id}").agg(F.max("max_ts").alias("ts"))
        newest.select(F.greatest("ts", F.lit(earlier).cast("timestamp")).alias("ts")).write.mode("overwrite").parquet(f"{out_path}-newest/batch_id={batch_id}")

    decoded.sparkSession.createDataFrame([(None,)], "ts timestamp").write.mode("ignore").parquet(f"{out_path}-newest/batch_id=-1")
    _empty(decoded.sparkSession, out_path,
           "w struct<start:timestamp,end:timestamp>, type string, n_events bigint, n_late bigint, max_ts timestamp")
    # a micro-batch computes all columns it is handed, so it is handed no others
    return _start(decoded.select("ts", "type").writeStream.option("checkpointLocation", checkpoint).foreachBatch(step), trigger)


def _empty(spark: SparkSession, path: str, schema: str) -> None:
    """An empty first batch, so that the folder can always be read and any read error is a real one."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch_id=-1")


def read_stats(spark: SparkSession, out_path: str) -> DataFrame:
    """Window counts of a stats sink: window_start, window_end, type, n_events, n_late."""
    df = _snapshot_and_later(spark, out_path)
    return df.groupBy("w", "type").agg(F.sum("n_events").alias("n_events"), F.sum("n_late").alias("n_late")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "type", "n_events", "n_late")


def _snapshot_and_later(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest snapshot, if any, and the batches after it."""
    batches = spark.read.parquet(out_path)
    _empty(spark, f"{out_path}-snapshots", batches.drop("batch_id").schema)
    snapshots = spark.read.option("basePath", f"{out_path}-snapshots").parquet(f"{out_path}-snapshots/*")
    upto = snapshots.agg(F.max("batch_id")).first()[0]
    if upto is None:
        return batches
    return snapshots.where(F.col("batch_id") == upto).unionByName(batches.where(F.col("batch_id") > upto))


def compact(spark: SparkSession, out_path: str, kind: str) -> None:
    """Fold all batches of a ``stats`` or ``states`` sink into a snapshot, so that readers scan it and newer batches only."""
    df = _snapshot_and_later(spark, out_path)
    last = spark.read.parquet(out_path).agg(F.max("batch_id")).first()[0]
    if last is None or last < 0:
        return
    if kind == "stats":
        folded = df.groupBy("w", "type").agg(F.sum("n_events").alias("n_events"), F.sum("n_late").alias("n_late"), F.max("max_ts").alias("max_ts"))
    else:
        folded = df.groupBy("fingerprint").agg(F.max_by("state", "batch_id").alias("state"))
    folded.write.mode("overwrite").parquet(f"{out_path}-snapshots/batch_id={last}")


def stream_url_states(transitions: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """J6 continuously: (fingerprint, state, ts) transitions folded per
    fingerprint. The rule -- latest transition wins, the further state on equal
    times -- is a built-in ``max_by``, so this is a native streaming
    aggregation: one small state row per URL in the state store, no Python.
    Update mode: each micro-batch writes the URLs it changed."""
    t = transitions.withColumn("state", F.col("state").cast("smallint"))
    out = t.groupBy("fingerprint").agg(
        F.max_by(F.col("state"), F.struct(F.col("ts"), F.col("state"))).alias("state"))
    w = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(_batch_writer(out_path))
    spark, provider = transitions.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query takes the setting when it starts: state on local disk, not in the executors' heap
        return _start(w, trigger)
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def read_states(spark: SparkSession, out_path: str) -> DataFrame:
    df = _snapshot_and_later(spark, out_path)
    return df.groupBy("fingerprint").agg(F.max_by("state", "batch_id").cast("smallint").alias("state"))


PUSHED_KEYS = 1000  # keys of a micro-batch that may be looked up by value, so that Bloom filters and sorted files prune


def seen_store(spark: SparkSession, root: str, key_type: str = "string", key: str = "fingerprint", groups: int = 16, spread: int = 1):
    """The seen keys: buckets with few sorted files each, newer ones in small generations, older ones compacted."""
    from ..sinks.store import BucketStore

    return BucketStore(spark, root, {"seen": f"{key} {key_type}"}, key, groups, spread, bloom=True)


def read_seen(store, candidates: DataFrame, manifest=None) -> DataFrame:
    """Of the seen keys, at least those among the (distinct) ``candidates``: their buckets only, and of few
    candidates only the row groups that may hold them."""
    known = store.read("seen", store.touched(candidates), manifest)
    few = candidates.select(store.key).limit(PUSHED_KEYS + 1).collect()
    if len(few) > PUSHED_KEYS:
        return known
    return known.where(F.col(store.key).isin([r[0] for r in few]))


def stream_unseen(candidates: DataFrame, seen: DataFrame | None, added_path: str, out_path: str, checkpoint: str,
                  key: str = "fingerprint", order=("created_at", "url"), trigger: dict | None = None, groups: int = 16, spread: int = 1):
    """J1 continuously: each micro-batch keeps its first row per key and drops keys already seen -- the ``seen`` table
    the store at ``added_path`` was begun with, plus every key an earlier batch let through. The seen set is unbounded,
    so it is a bucketed store: a micro-batch reads the buckets of its own keys and writes its keys beside them.
    Survivors are written under ``batch_id=N`` before their keys are published; a retried batch overwrites its output
    if its keys are not in yet, and leaves it if they are, so retries are exact."""
    from ..operators.frontier import filter_unseen

    spark = candidates.sparkSession
    store = seen_store(spark, added_path, candidates.schema[key].dataType.simpleString(), key, groups, spread)
    begun = seen if seen is not None else spark.createDataFrame([], store.tables["seen"])
    store.update("begun", 0, lambda m: {"seen": store.appended("seen", begun.select(key).distinct(), m)})

    def step(batch: DataFrame, batch_id: int) -> None:
        out = f"{out_path}/batch_id={batch_id}"

        def work(m):
            staged = scratch_path(spark, "unseen-candidates")
            filter_unseen(batch, batch.select(key).limit(0), key, order).write.parquet(staged)
            firsts = spark.read.parquet(staged)
            firsts.join(read_seen(store, firsts, m), key, "left_anti").write.mode("overwrite").parquet(out)
            return {"seen": store.appended("seen", spark.read.parquet(out).select(key), m)}

        before = spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", PUSHED_KEYS)
        try:
            store.update("stream", batch_id, work)
        finally:
            spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", before)

    w = candidates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return _start(w, trigger)


def read_batches(spark: SparkSession, out_path: str) -> DataFrame:
    """All rows a foreachBatch sink wrote, without the batch id."""
    return spark.read.parquet(out_path).drop("batch_id")
