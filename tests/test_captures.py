"""Capture jobs against brute force on small fixtures, with one hot key
spread over several range slices (X1, X5), plus X2/X3/X8 goldens."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from crawlframe.operators import captures as X

T0 = dt.datetime(2024, 1, 1)


def _rows(seed=7, n=400):
    rnd = random.Random(seed)
    # key 1 holds about two thirds of all rows
    return [(1 if rnd.random() < 0.66 else rnd.randint(2, 6), T0 + dt.timedelta(minutes=rnd.randint(0, 5000)), i,
             rnd.randint(1, 500)) for i in range(n)]


def test_capture_lookup_hot_key(spark):
    rows = _rows()
    caps = spark.createDataFrame([(k, t, i) for k, t, i, _ in rows], "key long, ts timestamp_ntz, capture_id long")
    rnd = random.Random(3)
    reqs = [(rnd.choice([1, 1, 1, 2, 3, 9]), T0 + dt.timedelta(minutes=rnd.randint(-10, 5100))) for _ in range(120)]
    reqs = sorted(set(reqs))
    rdf = spark.createDataFrame(reqs, "key long, asked timestamp_ntz")
    got = {(r.key, r.asked): (r.capture_ts, r.capture_id, r.action)
           for r in X.capture_lookup(rdf, caps, n_parts=6).collect()}
    for k, a in reqs:
        later = sorted((t, i) for kk, t, i, _ in rows if kk == k and t >= a)
        want = (later[0][0], later[0][1], "reuse") if later else (None, None, "fetch")
        assert got[(k, a)] == want, (k, a)


def test_capture_lookup_reads_no_slice_again_for_every_row(spark, capsys):
    # two keys, all captures at few times, one slice: what a frame that ends at the last row makes quadratic
    caps = spark.range(3000).select((F.col("id") % 2).alias("key"), F.timestamp_add("DAY", (F.col("id") * 7 % 30).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("ts"),
                                    F.col("id").alias("capture_id"))
    reqs = [(k, T0 + dt.timedelta(days=d, hours=h)) for k in (0, 1, 2) for d in (-1, 0, 7, 29, 30) for h in (0, 5)]
    found = X.capture_lookup(spark.createDataFrame(reqs, "key long, asked timestamp_ntz"), caps, n_parts=1)
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    rows = [(r.key, r.ts, r.capture_id) for r in caps.collect()]
    for r in found.collect():
        later = min(((t, i) for k, t, i in rows if k == r.key and t >= r.asked), default=(None, None))
        assert (r.capture_ts, r.capture_id, r.action) == (*later, "reuse" if later[0] else "fetch")


def test_quota_hot_key(spark):
    rows = _rows(11)
    df = spark.createDataFrame([(f"h{k}", t, i, b) for k, t, i, b in rows],
                               "host string, ts timestamp_ntz, id long, content_length long")
    got = {r.id: r.running_bytes for r in X.quota_per_host(df, 20000, n_parts=6).collect()}
    want = {}
    for h in {f"h{k}" for k, *_ in rows}:
        run = 0
        for k, t, i, b in sorted(((f"h{k}", t, i, b) for k, t, i, b in rows if f"h{k}" == h), key=lambda x: (x[1], x[2])):
            run += b
            if run <= 20000:
                want[i] = run
    assert got == want
    # the hot host really was cut into several slices
    sl = X.range_slices(df, ["host", "ts", "id"], 6).where("host = 'h1'").select("_b").distinct().count()
    assert sl > 1


def test_scope_and_dedupe(spark):
    urls = spark.createDataFrame([("http://www.example.com/a",), ("http://sub.example.com/",), ("http://example.org/",),
                                  ("http://examples.com/",)], "url string")
    prefixes = spark.createDataFrame([("com,example)",), ("com,example,",)], "prefix string")
    ins, outs = X.scope_filter(urls, prefixes)
    assert sorted(r.url for r in ins.collect()) == ["http://sub.example.com/", "http://www.example.com/a"]
    assert sorted(r.url for r in outs.collect()) == ["http://example.org/", "http://examples.com/"]
    caps = spark.createDataFrame([("u", "d1", T0, 1), ("u", "d1", T0 + dt.timedelta(1), 2), ("u", "d2", T0, 3)],
                                 "url string, digest string, ts timestamp_ntz, capture_id long")
    got = {r.capture_id: (r.is_revisit, r.original_capture_id) for r in X.dedupe_digests(caps).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (False, 3)}


def test_surt_and_scan(spark):
    df = spark.createDataFrame([("http://www.Example.com/A?b#c", 200), ("http://example.com/humans.txt", 200),
                                ("http://x.org/", 404)], "url string, status_code int")
    assert df.select(X.surt_key("url")).first()[0] == "com,example)/a?b"
    rep = {r.host: (r.serving, r.well_known) for r in X.domain_scan_report(df).collect()}
    assert rep == {"www.example.com": (True, ""), "example.com": (True, "/humans.txt"), "x.org": (False, "")}


def test_index_lookup_reads_matching_files_only(spark, tmp_path):
    from crawlframe.operators.captures import lookup_captures, surt_key, write_capture_index
    rows = [(k, f"http://www.h{k % 50:02d}.org/p{k // 50 % 6}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, url string, ts long")
    path = str(tmp_path / "index")
    write_capture_index(df, path, 10, block_rows=64)
    assert len(spark.read.parquet(f"{path}/files").inputFiles()) == 10
    want = {r.id: r.k for r in df.select("id", surt_key("url").alias("k")).collect()}
    for key in ("org,h07)/p3", "org,h00)/p0", "org,h49)/p5"):
        found = lookup_captures(spark, path, key=key)
        assert len(found.inputFiles()) <= 2 and {r.id for r in found.collect()} == {i for i, k in want.items() if k == key} != set()
    for prefix in ("org,h07)", "org,h1", "org,h33)/p5", "org,"):
        found = lookup_captures(spark, path, prefix=prefix)
        assert {r.id for r in found.collect()} == {i for i, k in want.items() if k.startswith(prefix)} != set()
        assert len(found.inputFiles()) <= 2 or prefix in ("org,h1", "org,")
    assert lookup_captures(spark, path, key="com,none)/").collect() == [] and lookup_captures(spark, path, prefix="zz").columns == ["id", "url", "ts", "urlkey"]
    with pytest.raises(ValueError):
        lookup_captures(spark, path)
