"""File sinks: the daily-rolled crawl log (K1) and the items feed as JSON
lines (K2). Both write through Spark's committers, so a lost task is simply
re-run and a finished write is all-or-nothing per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonfmt import json_number, json_object, json_string
from ..functions.timefmt import format_log_ts
from ..operators.crawllog import h3_line

ITEM_FIELDS = ["timestamp", "status_code", "content_length", "url", "hop_path", "via", "mimetype", "thread",
               "start_time_plus_duration", "content_digest", "seed", "annotations"]


def crawl_log_partitions(log: DataFrame) -> DataFrame:
    """(log_date, line): lines rolled at UTC midnight of the log timestamp."""
    return log.select(F.to_date(F.col("timestamp")).alias("log_date"), h3_line(log).alias("line"))


def write_crawl_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """K1: one text line per outcome under ``log_date=YYYY-MM-DD/`` folders.

    The rebalance gathers a day's lines, and splits days too large for one task."""
    (crawl_log_partitions(log).hint("rebalance", "log_date")
     .write.mode(mode).partitionBy("log_date").text(path))


def write_crawl_log_stream(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """K1 on a stream: same layout, exactly-once through the stream checkpoint."""
    w = (crawl_log_partitions(log).writeStream.format("text").option("path", path)
         .option("checkpointLocation", checkpoint).partitionBy("log_date").outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


# Item fields in the order the original filled them (the order of its lines).
ITEM_LINE_ORDER = ["url", "timestamp", "status_code", "content_length", "mimetype", "hop_path", "seed", "via",
                   "thread", "start_time_plus_duration", "content_digest", "annotations"]
NUMERIC_FIELDS = {"status_code", "content_length"}


def items_json(items: DataFrame) -> Column:
    """K2: one JSON object per item, as the original's JSON-lines exporter wrote
    it: fields in fill order, ``", "`` / ``": "`` separators, ASCII escapes,
    the timestamp as ISO text and the content type whole."""
    def value(name):
        if name == "timestamp":
            return json_string(format_log_ts(F.col("timestamp")))
        if name in NUMERIC_FIELDS:
            return json_number(F.col(name))
        return json_string(F.col(name))
    return json_object([(n, value(n)) for n in ITEM_LINE_ORDER])


def write_items_jsonl(items: DataFrame, path: str, mode: str = "append") -> None:
    """K2: the items feed as JSON lines."""
    items.select(items_json(items).alias("value")).write.mode(mode).text(path)
