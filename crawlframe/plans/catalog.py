"""Registered queries: one per operator of the blueprint, each with its DuckDB
oracle (or none where the operator is not SQL-expressible).

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables (or data
Spark derives from them); every computed column is aliased so the oracle can
use the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs as I
from . import sqlgen as sg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# The catalog modules register themselves on import.
from . import q_links, q_crawllog, q_discovery, q_frontier, q_events, q_captures, q_store  # noqa: E402,F401
