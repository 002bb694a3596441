"""Vectorised text helpers that run inside Arrow tasks.

All of them take whole Arrow columns and work slice by slice, so a task never
holds more than one slice of intermediate arrays, however long its texts are
in total.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let Spark hand over texts in Arrow batches of at most ``limit`` bytes (a smaller setting of the session stays).

    Spark's own bound is 64 MB, which long texts reach; both sides hold a batch more than once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key).lower()).groups()
    now = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit]
    if now <= 0 or now > limit:
        spark.conf.set(key, str(limit))


def release() -> None:
    """Give freed memory back to the system: Spark keeps a task's Python process for the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
    if trim:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to clash with no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


_shared: list = []


def share(spark: SparkSession, value):
    """Broadcast ``value``; ``unshare`` frees the executors' copies."""
    _shared.append(spark.sparkContext.broadcast(value))
    return _shared[-1]


def unshare() -> None:
    """Free what executors hold of all shared values, once results have been written. A plan that still needs one gets it again."""
    while _shared:
        _shared.pop().unpersist()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // limit
    starts = np.r_[0, np.flatnonzero(np.diff(run)) + 1] if len(run) else np.array([], dtype=np.int64)
    for start, end in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield batch.slice(int(start), int(end - start))


def plain(column: pa.Array) -> pa.Array:
    """Text with nulls as the empty string."""
    return pc.fill_null(column.cast(pa.string()), "")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z lower-cased texts.

    Returns the row number of each word (ascending), its code, and the distinct words by code.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(plain(texts)))
    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(split).dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # edges of a text split off empty strings
    if not full.all():
        keep = full[code]
        row, code = row[keep], (np.cumsum(full) - 1).astype(np.int32)[code[keep]]
        words = words.filter(pa.array(full))
    return row.astype(np.int64), code, words


def hash_words(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
