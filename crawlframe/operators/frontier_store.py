"""The frontier's tables as one store: metadata (J5), states (J6) and queue (F9, F6) change together, batch by batch.

Every function takes the batch's id and is applied once: of a batch that is in already nothing changes. Only buckets
that hold keys of the batch are read and written (see ``sinks.store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sinks.store import GROUPS, SPREAD, BucketStore, Manifest
from . import frontier as Q

TABLES = {
    "metadata": "fingerprint string, url string, depth int, score double, created_at timestamp_ntz, fetched_at timestamp_ntz, "
                "status_code int, error string, error_at timestamp_ntz",
    "states": "fingerprint string, state smallint, ts timestamp_ntz",
    "queue": "partition_id int, score double, url string, fingerprint string, host_crc32 bigint, created_at timestamp_ntz, depth smallint",
}


def open_store(spark: SparkSession, root: str, groups: int = GROUPS, spread: int = SPREAD) -> BucketStore:
    return BucketStore(spark, root, TABLES, "fingerprint", groups, spread)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Batches are read several times (their buckets, each table's merge), so they are computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _with_states(store: BucketStore, m: Manifest, changes: DataFrame) -> dict:
    """States after (fingerprint, state, ts) changes: the latest stands, of equal times the further state."""
    buckets = store.touched(changes)
    rows = store.read("states", buckets, m).unionByName(changes.select("fingerprint", F.col("state").cast("smallint").alias("state"), "ts"))
    latest = rows.groupBy("fingerprint").agg(F.max(F.struct("ts", "state")).alias("_s"))
    return store.replaced("states", latest.select("fingerprint", "_s.state", "_s.ts"), buckets)


def load_metadata(store: BucketStore, metadata: DataFrame, source: str = "load", batch_id: int = 0) -> bool:
    """Fill the metadata table of a new store; columns the store doesn't know are left out, missing ones are null."""
    have = [c for c in store.spark.createDataFrame([], TABLES["metadata"]).columns]
    rows = metadata.select(*[F.col(c) if c in metadata.columns else F.lit(None).alias(c) for c in have])
    return store.update(source, batch_id, lambda m: {"metadata": store.appended("metadata", rows, m)})


def apply_events(store: BucketStore, facts: DataFrame, batch_id: int, source: str = "events") -> bool:
    """Bring metadata and states up to date from one batch of facts (``streaming.spiderlog.event_facts``)."""
    def work(m: Manifest) -> dict:
        batch = _written(facts, "store-events")
        own = batch.where("kind != 'queued'")
        buckets = store.touched(own)
        merged = Q.apply_event_facts(store.read("metadata", buckets, m), own)
        return {"metadata": store.replaced("metadata", merged, buckets), "states": _with_states(store, m, batch)}

    return store.update(source, batch_id, work)


def apply_scores(store: BucketStore, updates: DataFrame, batch_id: int, source: str = "scores", partitions: int = Q.QUEUE_PARTITIONS) -> bool:
    """the latest score per URL goes to the metadata, scheduled ones are appended to the queue."""
    def work(m: Manifest) -> dict:
        batch = _written(updates, "store-scores")
        buckets = store.touched(batch)
        empty = store.spark.createDataFrame([], TABLES["queue"])
        metadata, queued = Q.apply_scores(store.read("metadata", buckets, m), empty, batch, partitions)
        return {"metadata": store.replaced("metadata", metadata, buckets), "queue": store.appended("queue", queued, m)}

    return store.update(source, batch_id, work)


def take_batch(store: BucketStore, partitions, batch_id: int, now, n: int = Q.BATCH_SIZE, order: str | list = "score",
               n_partitions: int = Q.QUEUE_PARTITIONS, source: str = "batches") -> DataFrame:
    """The next batch of some partitions leaves the queue, and its URLs become queued in the states, at one stroke.

    Only buckets of the asked partitions are read. A repeated call with one ``batch_id`` returns the same batch again.
    """
    path = f"{store.root}/batches/{source}/{batch_id}"

    def work(m: Manifest) -> dict:
        queue = store.read("queue", store.buckets_of_partition(Q.check_partitions(partitions, n_partitions), n_partitions), m)
        Q.next_batch(queue, partitions, n, order, n_partitions).write.mode("overwrite").parquet(path)
        batch = store.spark.read.parquet(path)
        buckets = store.touched(batch)
        rest, marked = Q.consume_batch(store.read("queue", buckets, m), batch)
        at = now if not isinstance(now, str) else F.lit(now).cast("timestamp_ntz")
        return {"queue": store.replaced("queue", rest, buckets), "states": _with_states(store, m, marked.withColumn("ts", at))}

    store.update(source, batch_id, work)
    return store.spark.read.parquet(path)
