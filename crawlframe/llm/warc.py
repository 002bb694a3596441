"""WARC (6): writer and sequential reader of archives with one gzip member per record.

Writer: every task writes its rows to files of its own under a temporary name
and renames them when complete, so a lost or repeated task leaves at most files
that no manifest names. Of records with equal payloads the one with the
smallest id is a ``response``, the others are ``revisit`` records without
payload that refer to it.

Reader: one pass over each file of the manifest: incremental decompression of
one member at a time, header lines, exactly ``Content-Length`` bytes, two line
ends and the end of the member, then the block and payload digests. At most one
record and one read buffer are held.

Paths may be any URI that Arrow's file systems know (``file:``, ``hdfs:``,
``s3:`` and so on), or plain paths of a shared folder.

Defined results: a null payload is empty, null or empty urls get no target
header, line ends in them are percent-encoded; rows with a null id are
responses if no row with an id has their payload, else revisits; rows that
repeat the smallest id with its payload are all responses. A damaged record
fails the read, or, if not ``strict``, gives a row with ``error`` and ends its
file. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.components import _written
from crawlframe.llm.text import bound_batches
from crawlframe.plans.sqlgen import base32_sha1 as base32_sha1_sql
from crawlframe.session import scratch_path

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20

_MANIFEST = "path string, records long, bytes long"
_RECORD = ("path string, position long, record_type string, record_id string, target_uri string, refers_to string, "
           "headers map<string,string>, payload binary, payload_bytes long, payload_digest string, error string")


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One gzip member that holds one record."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _page_record(page, url, payload: bytes, sha1: str, first, revisit: bool, level: int) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
              ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response")]
    return record(fields, block, level)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row under ``folder``; returns the manifest (path, records, bytes) as a written table.

    Payloads of fewer than ``min_bytes`` bytes are always responses. Only digests are shuffled; the table of those that
    repeat is broadcast by Spark if it is small and joined with skewed keys split if not.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    first = _written(rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
                     .agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-first")
    rows = rows.join(first, "sha1", "left").withColumn(
        "revisit", F.coalesce(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
                              & (F.octet_length("payload") >= min_bytes), F.lit(False)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open_fs(folder)
        files.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        out = name = None
        records = size = 0

        def close() -> pa.RecordBatch:
            out.close()
            files.move(f"{name}.tmp", name)
            return pa.record_batch([[f"{folder}/{os.path.basename(name)}"], [records], [size]], names=["path", "records", "bytes"])

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                data = _page_record(r["page"], r["url"], r["payload"], r["sha1"], r["first"], r["revisit"], level)
                if out is not None and size + len(data) > file_bytes:
                    yield close()
                    out = None
                if out is None:
                    name, records, size = f"{base}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{name}.tmp", compression=None)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            yield close()

    return _written(rows.select("page", "url", "payload", "sha1", "first", "revisit").mapInArrow(write, _MANIFEST), "warc-manifest")


class Damaged(ValueError):
    """The bytes are no well-formed record."""


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(position, content) of each gzip member, read and decompressed piece by piece."""
    position, held = 0, b""
    while True:
        held = held or stream.read(READ_BYTES)
        if not held:
            return
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            held = held or stream.read(READ_BYTES)
            if not held:
                raise Damaged(f"member at {position} is cut short")
            try:
                parts.append(unpack.decompress(held))
            except zlib.error as e:
                raise Damaged(f"member at {position}: {e}") from e
            used += len(held)
            held = b""
        held = unpack.unused_data
        yield position, b"".join(parts)
        position += used - len(held)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record, with framing and block digest verified."""
    end = content.find(b"\r\n\r\n")
    lines = content[:end].split(b"\r\n")
    if end < 0 or not lines[0].startswith(b"WARC/"):
        raise Damaged("no record header")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in b" \t" and last and line:  # continued value
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        last = name.strip().lower().decode("utf-8", "replace")
        fields[last] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no valid content-length")
    block, rest = content[end + 4:end + 4 + int(length)], content[end + 4 + int(length):]
    if len(block) != int(length) or rest != b"\r\n\r\n":
        raise Damaged("content-length does not match the member")
    _verify(fields, "warc-block-digest", block)
    return fields, block


def _verify(fields: dict[str, str], name: str, data: bytes) -> None:
    kind, _, value = fields.get(name, "").partition(":")
    if kind.lower() == "sha1" and value.upper() != base32_sha1(data):
        raise Damaged(f"{name} does not match")


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The HTTP body of a response, the whole block of other records, none of a revisit; the digest is verified."""
    if fields.get("warc-type") == "revisit":
        return None
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4:] if cut >= 0 else b""
    _verify(fields, "warc-payload-digest", payload)
    return payload


def _full_size(fields: dict[str, str], block: bytes) -> int | None:
    """Size of the full payload that a revisit's HTTP header states."""
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True, strict: bool = True,
                  batch_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the files named in column ``path``, each file read in one pass by one task.

    ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) are computed from the payload; of a revisit they are what
    its header states of the full payload. ``with_payload=False`` verifies payloads but leaves them out.
    """
    def rows_of(path: str) -> Iterator[dict]:
        system, name = _open_fs(path)
        with system.open_input_stream(name, compression=None) as stream:
            try:
                for position, content in members(stream):
                    fields, block = parse(content)
                    payload = payload_of(fields, block)
                    if payload is None:
                        size, digest = _full_size(fields, block), fields.get("warc-payload-digest", "").rpartition(":")[2].upper() or None
                    else:
                        size, digest = len(payload), base32_sha1(payload)
                    yield {"path": path, "position": position, "record_type": fields.get("warc-type"),
                           "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
                           "refers_to": fields.get("warc-refers-to"), "headers": list(fields.items()),
                           "payload": payload if with_payload else None, "payload_bytes": size, "payload_digest": digest,
                           "error": None}
            except Damaged as e:
                if strict:
                    raise
                yield dict.fromkeys(_SCHEMA.names) | {"path": path, "error": str(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for r in rows_of(path):
                    held.append(r)
                    size += 1000 + len(r["payload"] or b"")
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    paths = files.select("path").where("path is not null")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, _RECORD)


_SCHEMA = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                     ("target_uri", pa.string()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
                     ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return scratch_path(spark, "warc")


def oracle_sql() -> str:
    """What the archives of ``pages`` must hold, in DuckDB."""
    payload = "coalesce(html, '')"
    return f"""
SELECT page_id, CAST(strlen({payload}) AS BIGINT) AS payload_bytes, {base32_sha1_sql(payload)} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY {payload}) AS first FROM pages)"""
