"""F8 continuously: URLs due for a revisit, by event-time timers.

Every fetch of a URL sets a timer ``interval`` after it; a later fetch replaces the timer, and a fetch that is older than
the one known changes nothing. When the watermark passes the timer, the URL is due. State is one small row per URL in
RocksDB, so it may exceed an executor's memory, and it is in the checkpoint, so a lost executor or a restart loses no
timer.

The output is a log of changes: a row with ``due`` false for each new fetch, and one with ``due`` true when its timer
ends. ``read_due`` gives the URLs that are due after all batches so far. Rows without a fetch time are due at once, until
a fetch comes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.frontier import REVISIT_INTERVAL
from .jobs import _batch_writer, _empty, _start

CHANGES = "fingerprint string, url string, fetched_at timestamp, due boolean"


class RevisitTimers(StatefulProcessor):
    """One timer per URL (key: fingerprint; rows: url, fetched_us)."""

    def __init__(self, interval_us: int):
        self.interval_us = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "url string, fetched_us long")

    def _timer(self, fetched_us: int) -> int:
        return -(-(fetched_us + self.interval_us) // 1000)  # whole milliseconds, never early

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fetched_us, url = max((r.fetched_us, r.url) for r in rows)
        known = self.latest.get() if self.latest.exists() else None
        if known is not None:
            if known[1] >= fetched_us:
                return
            self.handle.deleteTimer(self._timer(known[1]))
        self.latest.update((url, fetched_us))
        self.handle.registerTimer(self._timer(fetched_us))
        yield self._change(key, url, fetched_us, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        url, fetched_us = self.latest.get()
        yield self._change(key, url, fetched_us, True)

    @staticmethod
    def _change(key, url: str, fetched_us: int, due: bool) -> Row:
        return Row(fingerprint=key[0], url=url, fetched_us=fetched_us, due=due)

    def close(self) -> None:
        pass


def stream_due(fetches: DataFrame, out_path: str, checkpoint: str, interval: str = REVISIT_INTERVAL, late_after: str = "1 hour",
               trigger: dict | None = None):
    """Start the query over fetches (fingerprint, url, fetched_at timestamp). Fetches that come more than ``late_after``
    behind the newest one are not counted."""
    spark = fetches.sparkSession
    span = spark.sql(f"SELECT TIMESTAMP'1970-01-01 00:00:00' + INTERVAL {interval} - TIMESTAMP'1970-01-01 00:00:00' AS d").first()[0]
    interval_us = span // dt.timedelta(microseconds=1)
    fetched = fetches.select("fingerprint", "url", F.col("fetched_at").cast("timestamp").alias("at"))
    known = fetched.where("fingerprint is not null and at is not null").withWatermark("at", late_after)
    known = known.select("fingerprint", "url", "at", F.unix_micros("at").alias("fetched_us"))
    changes = known.groupBy("fingerprint").transformWithState(
        RevisitTimers(interval_us), "fingerprint string, url string, fetched_us long, due boolean", "append", "eventTime")
    changes = changes.select("fingerprint", "url", F.timestamp_micros("fetched_us").alias("fetched_at"), "due")
    never = fetched.where("fingerprint is not null and at is null").select("fingerprint", "url", F.col("at").alias("fetched_at"), F.lit(True).alias("due"))
    _empty(spark, out_path, CHANGES)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query takes the setting when it starts
        w = changes.unionByName(never).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        return _start(w.foreachBatch(_batch_writer(out_path)), trigger)
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def read_due(spark: SparkSession, out_path: str) -> DataFrame:
    """(fingerprint, url, fetched_at) of the URLs whose last change made them due."""
    last = spark.read.parquet(out_path).groupBy("fingerprint").agg(
        F.max(F.struct(F.col("fetched_at").isNotNull().alias("known"), "fetched_at", "due", "url")).alias("_c"))
    return last.where("_c.due").select("fingerprint", "_c.url", "_c.fetched_at")
