"""A partitioned message log in a shared folder, as a Spark data source (S5 reads it, K4 writes it).

A log has numbered partitions. Each is a folder of immutable segments, Parquet files named by the first and last offset
they hold (``partition=3/<first>-<last>.parquet``): how far a partition goes is seen from names alone, and the offset of
a message is the segment's first offset plus its row.

Reading: ``spark.readStream.format("message_log")`` with ``path`` and

* ``partitions``: numbers of the partitions to read (default: all);
* ``maxMessages``: at most so many messages per micro-batch, dealt fairly over the partitions (default: no bound);
* ``startingOffsets``: ``earliest`` (default), ``latest``, or JSON of partition to offset.

Offsets per partition are in the checkpoint, so a restarted query goes on exactly where the last committed batch ended.
With ``availableNow`` a run is one poll of at most ``maxMessages``; with a processing-time trigger it polls on and on.
``spark.read.format("message_log")`` reads everything at once.

Writing: ``df.writeStream.format("message_log")`` with columns ``key``, ``value``, ``partition`` and optionally
``timestamp``, ``sequence`` (the order of messages within a micro-batch; else they keep the order they come in). A task
holds all its messages to sort them by ``sequence``, unless Spark has: with ``inOrder`` (messages come sorted by partition
and sequence) it writes them as they come. A stream cannot be sorted, a micro-batch can: written in ``foreachBatch``, as
``write_spider_log`` does, it takes the option ``batch``, the micro-batch's number. Either way it is a
commit in two phases. Tasks write whole files under names that no reader looks at. When all have ended, the driver
records which file becomes which segment, then renames them. A lost task leaves no part of a segment, a failed batch
none at all; a batch that is repeated after its record was written only finishes the renames. One query at a time may
write a log (or several with different ``writer`` names, one after the other).

Paths may be any URI that Arrow's file systems know (``file:``, ``hdfs:``, ``s3:`` and so on) or a plain path of a
shared folder.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition,
    WriterCommitMessage)

SCHEMA = "key binary, value binary, partition int, offset bigint, timestamp timestamp"
_STORED = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC"))])
_SEGMENT = re.compile(r"(\d{20})-(\d{20})\.parquet")
READ_ROWS = 1 << 14
GROUP_ROWS = 1 << 16


@dataclass
class Segment(InputPartition):
    """Messages ``first`` to ``end`` (exclusive) of one file whose first message has offset ``begin``."""

    path: str
    partition: int
    begin: int
    first: int
    end: int

    def __post_init__(self):
        self.value = None


class Log:
    """The files of one log."""

    def __init__(self, path: str):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        self.fs, self.root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), os.path.abspath(path))
        self.root = self.root.rstrip("/")

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True))
        return [f.base_name for f in found]

    def partitions(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.names("") if re.fullmatch(r"partition=\d+", n))

    def segments(self, partition: int) -> list[tuple[int, int, str]]:
        """(first offset, end, path) in order."""
        found = ((_SEGMENT.fullmatch(n), n) for n in self.names(f"partition={partition}"))
        return sorted((int(m[1]), int(m[2]) + 1, f"{self.root}/partition={partition}/{n}") for m, n in found if m)

    def bounds(self, partition: int) -> tuple[int, int]:
        """First offset and the one after the last."""
        found = self.segments(partition)
        return (found[0][0], found[-1][1]) if found else (0, 0)

    def plan(self, start: dict[int, int], end: dict[int, int]) -> list[Segment]:
        out = []
        for p, stop in sorted(end.items()):
            at = start.get(p, 0)
            for first, last, path in self.segments(p):
                lo, hi = max(first, at), min(last, stop)
                if lo < hi:
                    if lo > at:
                        raise ValueError(f"messages {at} to {lo - 1} of partition {p} are gone from {self.root}")
                    out.append(Segment(path, p, first, lo, hi))
                    at = hi
            if at < stop:
                raise ValueError(f"messages {at} to {stop - 1} of partition {p} are gone from {self.root}")
        return out

    def read(self, s: Segment) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(s.path) as f:
            at = s.begin
            for batch in pq.ParquetFile(f).iter_batches(READ_ROWS):
                lo, hi = max(s.first - at, 0), min(s.end - at, batch.num_rows)
                if lo < hi:
                    n, own = hi - lo, batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [own.column("key"), own.column("value"), pa.array([s.partition] * n, pa.int32()),
                         pa.array(range(at + lo, at + hi), pa.int64()), own.column("timestamp")],
                        names=["key", "value", "partition", "offset", "timestamp"])
                at += batch.num_rows
                if at >= s.end:
                    return

    def put(self, name: str, content: bytes) -> None:
        """A small file, whole or not at all."""
        hidden = f"{self.root}/{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        self.fs.create_dir(os.path.dirname(hidden))
        with self.fs.open_output_stream(hidden) as f:
            f.write(content)
        self.fs.move(hidden, f"{self.root}/{name}")

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type == fs.FileType.File


def fair_shares(waiting: dict[int, int], most: int) -> dict[int, int]:
    """How many of each partition's waiting messages to take, ``most`` in all: no partition gets less than another
    unless it has no more."""
    out, left = {}, most
    for k, p in enumerate(sorted(waiting, key=lambda p: (waiting[p], p))):
        out[p] = min(waiting[p], left // (len(waiting) - k))
        left -= out[p]
    return out


class MessageLogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = Log(options["path"])
        chosen = options.get("partitions")
        self.chosen = None if chosen is None else {int(p) for p in str(chosen).split(",")}
        self.most = int(options.get("maxmessages", 0)) or None
        self.starting = options.get("startingoffsets", "earliest")
        self.position: dict[int, int] | None = None  # where the last planned micro-batch ended

    def _bounds(self) -> dict[int, tuple[int, int]]:
        return {p: self.log.bounds(p) for p in self.log.partitions() if self.chosen is None or p in self.chosen}

    def initialOffset(self) -> dict:
        bounds = self._bounds()
        if self.starting in ("earliest", "latest"):
            self.position = {p: b[self.starting == "latest"] for p, b in bounds.items()}
        else:
            given = {int(p): int(o) for p, o in json.loads(self.starting).items()}
            self.position = {p: given.get(p, b[0]) for p, b in bounds.items()}
        return _said(self.position)

    def latestOffset(self) -> dict:
        if self.position is None:
            self.initialOffset()
        at = {p: self.position.get(p, first) for p, (first, _) in self._bounds().items()}
        waiting = {p: max(self.log.bounds(p)[1] - o, 0) for p, o in at.items()}
        take = waiting if self.most is None else fair_shares(waiting, self.most)
        return _said({**self.position, **{p: o + take[p] for p, o in at.items()}})

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        # also called with the last offsets of the checkpoint when a query restarts
        self.position = _numbers(end)
        return self.log.plan(_numbers(start), self.position)

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        pass


def _said(offsets: dict[int, int]) -> dict:
    return {str(p): o for p, o in sorted(offsets.items())}


def _numbers(offsets: dict) -> dict[int, int]:
    return {int(p): o for p, o in offsets.items()}


class MessageLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.stream = MessageLogStreamReader(options)

    def partitions(self) -> list[Segment]:
        bounds = self.stream._bounds()
        return self.stream.log.plan({p: b[0] for p, b in bounds.items()}, {p: b[1] for p, b in bounds.items()})

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return self.stream.log.read(partition) if partition else iter(())


@dataclass
class Staged(WriterCommitMessage):
    files: list  # (partition, path, messages)


class MessageLogWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path, self.writer = options["path"], options.get("writer", "writer")
        self.in_order = options.get("inorder", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """The messages of one task, a file for each partition. A task holds one record batch at a time; only messages with
        a ``sequence`` that do not come in order are held together, to sort them."""
        log, open_files = Log(self.path), {}
        with contextlib.ExitStack() as opened:
            for batch in iterator if self.in_order else self._sorted(iterator):
                if not batch.num_rows:
                    continue
                stamps = batch.column("timestamp") if "timestamp" in batch.schema.names else pa.nulls(batch.num_rows)
                stored = pa.table([batch.column("key"), batch.column("value"), stamps], names=_STORED.names).cast(_STORED)
                number = batch.column("partition")
                for p in sorted(number.unique().to_pylist()):
                    if p not in open_files:
                        log.fs.create_dir(f"{log.root}/_staged")
                        path = f"{log.root}/_staged/{uuid.uuid4().hex}.parquet"
                        f = opened.enter_context(log.fs.open_output_stream(path))
                        open_files[p] = [path, opened.enter_context(pq.ParquetWriter(f, _STORED, compression="zstd")), 0]
                    own = stored.filter(pc.equal(number, p))
                    open_files[p][1].write_table(own, row_group_size=GROUP_ROWS)
                    open_files[p][2] += own.num_rows
        return Staged([(p, path, n) for p, (path, _, n) in sorted(open_files.items())])

    def _sorted(self, iterator: Iterator[pa.RecordBatch]) -> Iterator:
        first = next(iterator, None)
        if first is None or "sequence" not in first.schema.names:
            return iterator if first is None else itertools.chain([first], iterator)
        table = pa.Table.from_batches([first, *iterator])
        return iter([table.sort_by([("partition", "ascending"), ("sequence", "ascending")])])

    def commit(self, messages: list, batchId: int) -> None:
        log, record = Log(self.path), f"_commits/{self.writer}-{batchId}.json"
        files = [f for m in messages if m for f in m.files]
        if log.exists(f"{log.root}/{record}"):  # this batch again: its segments are settled
            with log.fs.open_input_stream(f"{log.root}/{record}") as f:
                moves = json.loads(f.read())
            settled = {source for source, _ in moves}
            _delete(log, [path for _, path, _ in files if path not in settled])
        else:
            ends: dict[int, int] = {}
            moves = []
            for p, path, n in files:  # of one partition in the order of the tasks
                first = ends.get(p, log.bounds(p)[1])
                ends[p] = first + n
                moves.append((path, f"{log.root}/partition={p}/{first:020d}-{first + n - 1:020d}.parquet"))
            log.put(record, json.dumps(moves).encode())
        for source, target in moves:
            if log.exists(source):
                log.fs.create_dir(os.path.dirname(target))
                log.fs.move(source, target)
        _delete(log, [f"{log.root}/_commits/{self.writer}-{batchId - 2}.json"])

    def abort(self, messages: list, batchId: int) -> None:
        _delete(Log(self.path), [path for m in messages if m for _, path, _ in m.files])


def _delete(log: Log, paths: list[str]) -> None:
    for path in paths:
        if log.exists(path):
            log.fs.delete_file(path)


class MessageLogBatchWriter(DataSourceArrowWriter):
    """The same commit for one micro-batch that is written as a batch; its number is an option."""

    def __init__(self, options: dict):
        self.batch, self.to = int(options["batch"]), MessageLogWriter(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.to.write(iterator)

    def commit(self, messages: list) -> None:
        self.to.commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.to.abort(messages, self.batch)


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MessageLogStreamReader:
        return MessageLogStreamReader(_lower(self.options))

    def reader(self, schema) -> MessageLogReader:
        return MessageLogReader(_lower(self.options))

    def streamWriter(self, schema, overwrite: bool) -> MessageLogWriter:
        _check(schema)
        return MessageLogWriter(_lower(self.options))

    def writer(self, schema, overwrite: bool) -> MessageLogBatchWriter:
        _check(schema)
        if overwrite or "batch" not in _lower(self.options):
            raise ValueError("a message log is appended to, with the number of the micro-batch as the option batch")
        return MessageLogBatchWriter(_lower(self.options))


def _check(schema) -> None:
    missing = {"key", "value", "partition"} - set(schema.fieldNames())
    if missing:
        raise ValueError(f"a message log needs the columns {sorted(missing)}")


def _lower(options) -> dict:
    return {k.lower(): v for k, v in options.items()}
