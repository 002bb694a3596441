"""The bucketed store: what an update touches, retries, conflicts, compaction; the frontier and the seen keys in it."""

import datetime as dt
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from crawlframe.operators import frontier as Q
from crawlframe.operators import frontier_store as FS
from crawlframe.sinks import store as ST
from crawlframe.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
HOSTS = [f"{hashlib.md5(b'%d' % k).hexdigest()[:9]}.org" for k in range(40)]


def fp(host, k=0):
    return f"{zlib.crc32(host.encode()):08x}{k:032d}"


def files(root, table):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data/{table}") for f in names if f.endswith(".parquet")}


def live(store, table):
    return {os.path.join(p, f) for p in store.paths(table) for f in os.listdir(p) if f.endswith(".parquet")}


def facts(spark, rows):
    """rows (host, k, kind, day)"""
    made = [(fp(h, k), kind, f"http://{h}/{k}", 1 if kind == "link" else None, 200 if kind == "crawl" else None,
             "dns" if kind == "error" else None, {"link": 0, "queued": 1, "crawl": 2, "error": 3}[kind], T0 + dt.timedelta(days=d)) for h, k, kind, d in rows]
    return spark.createDataFrame(made, "fingerprint string, kind string, url string, depth int, status_code int, error string, state smallint, ts timestamp_ntz")


def test_untouched_buckets_keep_their_files_and_a_retry_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    store = FS.open_store(spark, root)
    first = facts(spark, [(h, k, "link", 0) for h in HOSTS for k in range(3)])
    second = facts(spark, [(HOSTS[0], 0, "crawl", 1), (HOSTS[0], 7, "link", 1), (HOSTS[1], 1, "error", 1)])
    assert FS.apply_events(store, first, 0)
    before, version = live(store, "metadata"), store.manifest().version
    assert FS.apply_events(store, second, 1)
    after = live(store, "metadata")
    touched = {f"bucket={b}" for b in store.touched(second)}
    assert {f for f in before if f.split("/")[-2] not in touched} == before & after and len(before & after) > len(before) / 2
    assert {f.split("/")[-2] for f in after - before} == touched
    # the same batch again: no version, no file
    on_disk = files(root, "metadata")
    assert not FS.apply_events(store, second, 1) and not FS.apply_events(store, first, 0)
    assert store.manifest().version == version + 1 and files(root, "metadata") == on_disk
    # a reader of the old version still sees it
    assert store.read("metadata", manifest=store.manifest(version)).where("fetched_at is not null").count() == 0
    # the same as applying the batches to the whole table
    want = Q.apply_event_facts(Q.apply_event_facts(None, first), second)
    got = store.read("metadata").drop("score")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {(r.fingerprint, r.state) for r in store.read("states").where("state > 0").collect()} == {(fp(HOSTS[0]), 2), (fp(HOSTS[1], 1), 3)}


def test_of_two_writers_one_fails_and_leaves_the_store_as_it_was(spark, tmp_path):
    store = FS.open_store(spark, str(tmp_path))
    FS.apply_events(store, facts(spark, [(HOSTS[0], 0, "link", 0)]), 0)

    def slow(manifest):
        FS.apply_events(store, facts(spark, [(HOSTS[0], 1, "link", 1)]), 1)  # another writer comes first
        return {"metadata": {}}

    with pytest.raises(ST.VersionConflict):
        store.update("other", 0, slow)
    assert store.read("metadata").count() == 2 and store.manifest().batches == {"events": 1}


def test_expired_versions_free_their_files_only(spark, tmp_path):
    store = FS.open_store(spark, str(tmp_path))
    for k in range(3):
        FS.apply_events(store, facts(spark, [(HOSTS[k], 0, "link", 0), (HOSTS[0], 0, "crawl", k)]), k)
    rows = sorted(map(tuple, store.read("metadata").collect()), key=repr)
    store.stage("metadata", store.read("metadata"))  # what a lost driver leaves
    assert store.expire(1) and store.versions() == [3] and files(str(tmp_path), "metadata") == live(store, "metadata")
    assert sorted(map(tuple, store.read("metadata").collect()), key=repr) == rows


def test_queue_partitions_have_buckets_of_their_own(spark, tmp_path):
    store = FS.open_store(spark, str(tmp_path))
    rows = [(fp(h, k), f"http://{h}/{k}", (7 * k % 10) / 10, True, T0) for h in HOSTS for k in range(4)]
    updates = spark.createDataFrame(rows, "fingerprint string, url string, score double, schedule boolean, ts timestamp_ntz")
    FS.apply_scores(store, updates, 0)
    buckets = [set(store.buckets_of_partition([p], 2)) for p in (0, 1)]
    assert not buckets[0] & buckets[1] and buckets[0] | buckets[1] == set(range(store.groups * store.spread))
    own = store.read("queue", sorted(buckets[1]))
    assert {r.partition_id for r in own.collect()} == {1} and own.count() == store.read("queue").where("partition_id = 1").count()
    taken = FS.take_batch(store, [1], 0, "2024-02-01", 5).collect()
    again = FS.take_batch(store, [1], 0, "2024-03-01", 5).collect()
    assert len(taken) == 5 and sorted(taken) == sorted(again)
    assert store.read("queue").count() == len(rows) - 5
    assert {(r.fingerprint, r.state, r.ts) for r in store.read("states").collect()} == {(r.fingerprint, 1, dt.datetime(2024, 2, 1)) for r in taken}
    with pytest.raises(ValueError):
        store.buckets_of_partition([0], 3)


def test_loaded_metadata_and_odd_keys(spark, tmp_path):
    store = FS.open_store(spark, str(tmp_path))
    table = spark.createDataFrame([("plain key", "u", 2.0), (None, "v", 1.0), (fp(HOSTS[3]), "w", 0.5)], "fingerprint string, url string, score double")
    assert FS.load_metadata(store, table) and not FS.load_metadata(store, table)
    assert {(r.fingerprint, r.score, r.depth) for r in store.read("metadata").collect()} == {("plain key", 2.0, None), (None, 1.0, None), (fp(HOSTS[3]), 0.5, None)}
    assert FS.open_store(spark, str(tmp_path / "new")).read("queue").collect() == []
    FS.apply_events(store, facts(spark, []), 0)
    assert store.read("metadata").count() == 3


def test_generations_of_a_bucket_are_compacted_in_levels(spark, tmp_path):
    store = jobs.seen_store(spark, str(tmp_path), groups=2)
    for k in range(ST.FAN ** 2 + 1):
        keys = spark.createDataFrame([(fp("one", k),), (fp("one", 0),)], "fingerprint string")
        store.update("s", k, lambda m, keys=keys: {"seen": store.appended("seen", keys.distinct(), m, distinct=True)})
        (gens,) = store.manifest().tables["seen"].values()
        assert len(gens) < 2 * ST.FAN
    assert sorted(g.split("-")[0] for g in gens) == ["0", "2"]
    assert store.read("seen").distinct().count() == ST.FAN ** 2 + 1 and store.read("seen").count() == ST.FAN ** 2 + 2


def test_a_micro_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    """Ten micro-batches of four hosts each, over a seen set of forty hosts."""
    rows = [(fp(h, k), f"http://{h}/{k}", T0) for h in HOSTS for k in range(50)]
    schema = "fingerprint string, url string, created_at timestamp_ntz"
    seen = spark.createDataFrame(rows[::2], schema).select("fingerprint")
    feed = tmp_path / "feed"
    for b in range(10):
        own = [r for r in rows if r[1].split("/")[2] in HOSTS[4 * b:4 * b + 4]]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(feed))
        for f in feed.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + b * 100 * (f.stat().st_mtime > 1_700_100_000),) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    out, added = str(tmp_path / "out"), str(tmp_path / "added")
    jobs.stream_unseen(stream, seen, added, out, str(tmp_path / "ckpt"), groups=64).awaitTermination()
    got = jobs.read_batches(spark, out)
    assert sorted(r.fingerprint for r in got.collect()) == sorted(r[0] for r in rows[1::2])
    store = jobs.seen_store(spark, added, groups=64)
    assert store.manifest().batches["stream"] == 9 and store.read("seen").count() == len(rows)
    for b in range(10):
        firsts = spark.createDataFrame([r for r in rows if r[1].split("/")[2] in HOSTS[4 * b:4 * b + 4]], schema)
        in_reach = store.read("seen", store.touched(firsts)).count()
        assert len(firsts.collect()) <= in_reach <= len(rows) / 4 and jobs.read_seen(store, firsts).count() == firsts.count()
