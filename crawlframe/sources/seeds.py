"""Seed lists (S1-S3) and responses."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED_SCHEMA = "url string, source_page string"


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SEED_SCHEMA)


def read_seeds_text(spark: SparkSession, path: str | None) -> DataFrame:
    """One URL per line, trailing whitespace stripped, blank lines dropped
    (deviation: the original requested the empty URL). S3: no path -> no rows."""
    if not path:
        return _empty(spark)
    lines = spark.read.text(path)
    url = F.regexp_replace(F.col("value"), r"\s+$", "")
    return lines.select(url.alias("url"), F.lit(None).cast("string").alias("source_page")).where(F.col("url") != "")


def read_seeds_csv(spark: SparkSession, path: str | None) -> DataFrame:
    """Tab-delimited, no header; URL in column 1, the landing page in column 0.
    Rows without a URL are skipped."""
    if not path:
        return _empty(spark)
    df = (spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').option("header", "false")
          .schema("source_page string, url string").csv(path))
    return df.where(F.col("url").isNotNull() & (F.col("url") != "")).select("url", "source_page")


def read_seeds(spark: SparkSession, path: str | None) -> DataFrame:
    """Pick the reader by name: ``*.csv`` (case-sensitive) is CSV, anything else text."""
    if not path:
        return _empty(spark)
    base = os.path.basename(path.rstrip("/"))
    return read_seeds_csv(spark, path) if base.endswith(".csv") else read_seeds_text(spark, path)


def read_responses(pages: DataFrame, status_code: int = 200, content_type: str = "text/html") -> DataFrame:
    """Responses from a pages table (page_id, url, html): body as UTF-8
    bytes, with a default status and content type where none are stored."""
    cols = pages.columns
    status = F.col("status_code") if "status_code" in cols else F.lit(status_code)
    ct = F.col("content_type") if "content_type" in cols else F.lit(content_type)
    return pages.select(*[c for c in cols if c not in ("status_code", "content_type")],
                        status.cast("int").alias("status_code"), ct.alias("content_type"),
                        F.encode(F.col("html"), "UTF-8").alias("body"))
