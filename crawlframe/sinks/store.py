"""Keyed tables that are brought up to date without being rewritten.

A store is a folder of tables, each cut into buckets by its key. Data files are never changed: an update writes new
files for the buckets its keys fall in, as a *generation*, and then publishes a new version, a small manifest that
names the generations of every bucket of every table. Buckets that an update does not touch keep their files.

Publishing is one rename that fails if the version exists, so readers see all of an update or nothing, and of two
writers one fails and starts again. The manifest also names the last batch of each source, so a repeated batch changes
nothing. A lost executor or driver leaves at most files that no manifest names; ``expire`` deletes them.

A bucket is the key's first eight hex digits (the host's CRC-32 in URL fingerprints, so that a batch of few hosts
touches few buckets, and each queue partition has buckets of its own) modulo ``groups``, cut into ``spread`` parts by
the hash of the whole key, so that a host with most of the keys is still spread. With ``by_hash``, for keys that are no
fingerprints, the hash alone decides. What passes through the driver is bounded by the number of buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS, SPREAD = 16, 4  # 64 buckets; a table of billions of keys wants thousands
FAN = 4  # generations of one level that a bucket collects before they become one of the next level
ROW_GROUP_BYTES = 8 << 20
Buckets = dict[int, list[str]]  # generations of each bucket


class VersionConflict(RuntimeError):
    """Another writer published first; nothing of this update is visible."""


@dataclass
class Manifest:
    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # last batch of each source
    tables: dict[str, Buckets] = field(default_factory=dict)


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str], key: str = "fingerprint",
                 groups: int = GROUPS, spread: int = SPREAD, bloom: bool = False, by_hash: bool = False):
        """``tables``: schema of each table (DDL); key and numbers of buckets must be the same at each opening.
        ``bloom``: files get Bloom filters on the key, for readers that look up few keys."""
        self.spark, self.root, self.tables, self.key = spark, root.rstrip("/"), tables, key
        self.groups, self.spread, self.bloom, self.by_hash = groups, spread, bloom, by_hash
        jvm = spark._jvm.org.apache.hadoop.fs
        self._jvm, self._conf = jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    # ---------------------------------------------------------------- versions
    def _path(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or a given one; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest()
        stream = self._fs.open(self._path(f"versions/{version}"))
        try:
            stored = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(version, stored["batches"], {t: {int(b): g for b, g in x.items()} for t, x in stored["tables"].items()})

    def _publish(self, m: Manifest) -> None:
        hidden = self._path(f"versions/.{m.version}-{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps({"batches": m.batches, "tables": m.tables}).encode()))
        out.close()
        context = self._jvm.FileContext.getFileContext(hidden.toUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(hidden), context.makeQualified(self._path(f"versions/{m.version}")), no_overwrite)
        except Exception as e:
            self._fs.delete(hidden, False)
            raise VersionConflict(f"version {m.version} of {self.root} was published by another writer") from e

    # ---------------------------------------------------------------- buckets
    def bucket_of(self, key: Column) -> Column:
        if self.by_hash:
            return F.pmod(F.xxhash64(key), F.lit(self.groups * self.spread)).cast("int")
        group = F.coalesce(F.conv(F.substring(key, 1, 8), 16, 10).try_cast("long"), F.lit(0)) % self.groups
        return (group * self.spread + F.pmod(F.xxhash64(key), F.lit(self.spread))).cast("int")

    def buckets_of_partition(self, partitions: list[int], n_partitions: int) -> list[int]:
        """Buckets of the hosts whose CRC-32 modulo ``n_partitions`` is one of ``partitions``."""
        if self.groups % n_partitions:
            raise ValueError("the number of bucket groups must be a multiple of the number of partitions")
        return [g * self.spread + k for g in range(self.groups) if g % n_partitions in set(partitions) for k in range(self.spread)]

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys of a table (at most as many numbers as there are buckets)."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.key))).distinct().collect())

    def paths(self, table: str, buckets: list[int] | None = None, manifest: Manifest | None = None) -> list[str]:
        of = (manifest or self.manifest()).tables.get(table, {})
        wanted = of if buckets is None else [b for b in buckets if b in of]
        return [f"{self.root}/data/{table}/{g}/bucket={b}" for b in wanted for g in of[b]]

    def read(self, table: str, buckets: list[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets, of the newest or a given version."""
        paths = self.paths(table, buckets, manifest)
        if not paths:
            return self.spark.createDataFrame([], self.tables[table])
        return self.spark.read.schema(self.tables[table]).parquet(*paths)

    # ---------------------------------------------------------------- updates
    def stage(self, table: str, rows: DataFrame, level: int = 0) -> Buckets:
        """Write ``rows`` as a new generation that no version names yet: {bucket: [generation]}.

        Files are sorted by key; a bucket too large for one task becomes several files.
        """
        generation = f"{level}-{uuid.uuid4().hex}"
        path, schema = f"{self.root}/data/{table}/{generation}", self.spark.createDataFrame([], self.tables[table]).schema
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
        (rows.select(*columns, self.bucket_of(F.col(self.key)).alias("bucket")).hint("rebalance", "bucket")
         .sortWithinPartitions("bucket", self.key).write.partitionBy("bucket")
         .option(f"parquet.bloom.filter.enabled#{self.key}", str(self.bloom).lower()).option("parquet.bloom.filter.adaptive.enabled", str(self.bloom).lower())
         .option("parquet.block.size", ROW_GROUP_BYTES).parquet(path))
        folder = f"data/{table}/{generation}"
        return {int(n[len("bucket="):]): [generation] for n in self._names(folder) if n.startswith("bucket=")}

    def replaced(self, table: str, rows: DataFrame, buckets: list[int]) -> Buckets:
        """``rows`` in place of all that ``buckets`` hold."""
        staged = self.stage(table, rows)
        if not set(staged) <= set(buckets):
            raise ValueError("rows of other buckets than those that are replaced")
        return {b: staged.get(b, []) for b in buckets}

    def appended(self, table: str, rows: DataFrame, manifest: Manifest, distinct: bool = False) -> Buckets:
        """``rows`` beside what their buckets hold. Where ``FAN`` generations of a level have come together, they become
        one of the next level, so a bucket has few files and each row is rewritten a few times only."""
        of = manifest.tables.get(table, {})
        out = {b: of.get(b, []) + g for b, g in self.stage(table, rows).items()}
        level = 0
        while True:
            own = lambda gens: [g for g in gens if g.startswith(f"{level}-")]  # noqa: E731, B023
            full = {b: own(gens) for b, gens in out.items() if len(own(gens)) >= FAN}
            if not full:
                if not any(int(g.split("-")[0]) > level for gens in out.values() for g in gens):
                    return out
                level += 1
                continue
            paths = [f"{self.root}/data/{table}/{g}/bucket={b}" for b, gens in full.items() for g in gens]
            merged = self.spark.read.schema(self.tables[table]).parquet(*paths)
            merged = self.stage(table, merged.distinct() if distinct else merged, level + 1)
            out |= {b: [g for g in out[b] if g not in gens] + merged[b] for b, gens in full.items()}
            level += 1

    def update(self, source: str, batch_id: int, work: Callable[[Manifest], dict[str, Buckets]]) -> bool:
        """Publish what ``work`` staged for batch ``batch_id`` of ``source``; false if that batch is in already.

        ``work`` gets the version it builds on and returns, by table, the new generations of the buckets it changes.
        """
        m = self.manifest()
        if m.batches.get(source, -1) >= batch_id:
            return False
        changes = work(m)
        tables = {t: {b: g for b, g in {**m.tables.get(t, {}), **changes.get(t, {})}.items() if g} for t in self.tables}
        self._publish(Manifest(m.version + 1, {**m.batches, source: batch_id}, tables))
        return True

    def expire(self, keep: int = 1) -> list[str]:
        """Delete all versions but the newest ``keep``, and the bucket folders of generations that none of those names.
        Run it while no update runs. Returns the folders."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {(t, g, f"bucket={b}") for v in kept for t, buckets in self.manifest(v).tables.items() for b, gens in buckets.items() for g in gens}
        gone = []
        for t in self.tables:
            for g in self._names(f"data/{t}"):
                own = [n for n in self._names(f"data/{t}/{g}") if n.startswith("bucket=")]
                if not any((t, g, n) in named for n in own):
                    gone.append(f"data/{t}/{g}")
                else:
                    gone += [f"data/{t}/{g}/{n}" for n in own if (t, g, n) not in named]
        for name in [*(f"versions/{v}" for v in versions if v not in kept), *gone]:
            self._fs.delete(self._path(name), True)
        return gone
