"""Spider-log decoding goldens (E1-E6, A1, K4) and a streaming twin."""

import pytest
from pyspark.sql import functions as F

from crawlframe.operators import frontier as Q
from crawlframe.streaming import spiderlog as S

LINES = [
    '{"type":"page_crawled","r":{"url":"http://h.org/","status_code":200,"meta":{"domain":{"fingerprint":"ab"}},"body":"YWJj"}}',
    '{"type":"links_extracted","r":{"url":"http://h.org/","method":"GET","headers":{},"cookies":{},"meta":{}},'
    '"links":[{"url":"http://h.org/a","method":"GET","headers":{},"cookies":{},"meta":{"domain":{"fingerprint":"ab"}}},'
    '{"url":"http://x.org/b","method":"GET","headers":{},"cookies":{},"meta":{"domain":{}}}]}',
    '{"type":"request_error","r":{"url":"http://x/","method":"GET","headers":{},"cookies":{},"meta":{}},"error":"dns"}',
    '{"type":"update_score","r":{"url":"http://h.org/a","method":"GET","headers":{},"cookies":{},"meta":{}},"score":0.5,"schedule":true}',
    '{"type":"new_job_id","job_id":7}',
    '{"type":"offset","partition_id":1,"offset":5}',
    '{"type":"stats","stats":{"n":3}}',
    '{"type":"surprise"}',
    '{bad',
]


def _msgs(spark):
    return spark.createDataFrame([(i, s.encode()) for i, s in enumerate(LINES)], "offset long, value binary")


def test_decode(spark):
    good, bad = S.decode_spider_log(_msgs(spark))
    g = {r.type: r for r in good.collect()}
    assert sorted(g) == sorted(S.EVENT_TYPES)
    assert bytes(g["page_crawled"].body) == b"abc" and g["page_crawled"].meta.domain.fingerprint == "ab"
    assert g["new_job_id"].job_id == 7 and g["offset"].partition_id == 1 and g["offset"].event_offset == 5
    assert g["stats"].stats == {"n": "3"} and g["update_score"].schedule is True
    assert sorted((r.offset, r.reason) for r in bad.collect()) == [(7, "unknown type"), (8, "undecodable")]


def test_strict_unknown_type(spark):
    good, _ = S.decode_spider_log(_msgs(spark), strict=True)
    with pytest.raises(Exception):
        good.collect()


def test_links_and_per_host(spark):
    good, _ = S.decode_spider_log(_msgs(spark))
    links = S.links_of(good)
    assert [(r.pos, r.url, r.host_fp) for r in links.orderBy("pos").collect()] == [
        (0, "http://h.org/a", "ab"), (1, "http://x.org/b", None)]
    per_host = Q.links_per_host(links, "source_url")
    assert [(r.host_fp, r.n_links) for r in per_host.collect()] == [("ab", 1)]


def test_requests_feed(spark):
    feed = spark.createDataFrame([(0, b'{"url":"http://a/","method":"GET","headers":{},"cookies":{},"meta":{}}'),
                                  (1, b'{"url":')], "offset long, value binary")
    good, bad = S.decode_requests(feed)
    assert [r.url for r in good.collect()] == ["http://a/"] and bad.count() == 1


def test_encode_roundtrip(spark):
    df = spark.createDataFrame([("update_score", "http://h/a", "fp", 0.25, True)],
                               "type string, url string, fp string, score double, schedule boolean")
    v = df.select(S.encode_event(F.col("type"), F.col("url"), F.col("fp"), score=F.col("score"),
                                 schedule=F.col("schedule")).cast("binary").alias("value"),
                  S.spider_log_key(F.col("type"), F.col("fp")).alias("key"))
    good, bad = S.decode_spider_log(v)
    r = good.first()
    assert bad.count() == 0 and r.score == 0.25 and r.schedule and r.url == "http://h/a" and bytes(r.key) == b"fp"


def test_stream_matches_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    d = "/root/testdata/sf0.001"
    s = sorted(tuple(r) for r in q["e7_stream_stats"](spark, d).collect())
    b = sorted(tuple(r) for r in q["a4_crawl_stats"](spark, d).collect())
    assert s == b


def _feed(spark, tmp_path, batches, schema):
    """One parquet file per micro-batch, read one at a time in order."""
    import os
    path = str(tmp_path / "feed")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in (tmp_path / "feed").glob("*.parquet"):
            if not (tmp_path / f"seen-{f.name}").exists():
                os.utime(f, (1_700_000_000 + k * 100,) * 2)
                (tmp_path / f"seen-{f.name}").touch()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_stats_count_late_events_and_compact(spark, tmp_path):
    import datetime as dt
    from crawlframe.streaming import jobs
    t = lambda h: dt.datetime(2024, 1, 1, h)
    stream = _feed(spark, tmp_path, [[("a", t(9)), ("a", t(10))], [("a", t(9)), ("b", t(1)), ("a", t(11))], [("b", t(1))]],
                   "type string, ts timestamp_ntz")
    out = str(tmp_path / "out")
    jobs.stream_crawl_stats(stream, out, str(tmp_path / "ckpt"), "1 hour", "1 hour").awaitTermination()
    want = {(9, "a"): (2, 0), (10, "a"): (1, 0), (11, "a"): (1, 0), (1, "b"): (2, 2)}
    read = lambda: {(r.window_start.hour, r.type): (r.n_events, r.n_late) for r in jobs.read_stats(spark, out).collect()}
    assert read() == want
    jobs.compact(spark, out, "stats")
    assert read() == want
    jobs._empty(spark, str(tmp_path / "other"), "x int")  # a snapshot and a later batch add up
    spark.read.parquet(out).where("batch_id = 0").drop("batch_id").write.parquet(f"{out}/batch_id=99")
    assert read()[(9, "a")] == (3, 0)


def test_stream_stats_compute_the_time_and_the_type_only(spark, tmp_path):
    import datetime as dt
    from crawlframe.streaming import jobs
    stream = _feed(spark, tmp_path, [[("a", dt.datetime(2024, 1, 1))]], "type string, ts timestamp_ntz")
    stream = stream.withColumn("body", F.raise_error(F.concat(F.lit("computed for "), "type")))
    out = str(tmp_path / "out")
    jobs.stream_crawl_stats(stream, out, str(tmp_path / "ckpt"), "1 hour").awaitTermination()
    assert [(r.type, r.n_events) for r in jobs.read_stats(spark, out).collect()] == [("a", 1)]


def test_unseen_stream_survives_a_retry_and_fails_on_an_unreadable_seen_set(spark, tmp_path):
    import pytest
    from crawlframe.streaming import jobs
    schema = "fingerprint string, url string, created_at timestamp_ntz"
    import datetime as dt
    d = dt.datetime(2024, 1, 1)
    stream = _feed(spark, tmp_path, [[("f1", "u1", d), ("f2", "u2", d)], [("f1", "u1", d), ("f3", "u3", d)]], schema)
    added, out = str(tmp_path / "added"), str(tmp_path / "out")
    seen = spark.createDataFrame([("f2",)], "fingerprint string")
    jobs.stream_unseen(stream, seen, added, out, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r.fingerprint for r in jobs.read_batches(spark, out).collect()) == ["f1", "f3"]
    # the last batch again, as after a crash before its commit
    commits = sorted((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "ckpt" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    jobs.stream_unseen(stream, seen, added, out, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r.fingerprint for r in jobs.read_batches(spark, out).collect()) == ["f1", "f3"]
    for f in (tmp_path / "added").rglob("*.parquet"):
        f.write_bytes(b"damaged")
    spark.createDataFrame([("f4", "u4", d), ("f1", "u1", d)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    with pytest.raises(Exception):
        jobs.stream_unseen(stream, seen, added, out, str(tmp_path / "ckpt")).awaitTermination()


def test_views_straight_from_messages_equal_the_decoded_ones(spark):
    import datetime as dt
    from crawlframe.plans import inputs as I
    from crawlframe.plans.q_events import odd_messages
    t0 = dt.datetime(2024, 1, 1)
    cut = spark.createDataFrame([(-1, b'{"type":"offset","partition_id":1', t0), (-2, None, t0), (-3, b' {\n"type" : "offset","partition_id":2,"offset":"7"}', t0),
                                 (-4, b'{"offset":5,"partition_id":"1","type":"offset"}', t0), (-5, b'{"partition_id":"1"}', t0)], "offset long, value binary, ts timestamp_ntz")
    d = "/root/testdata/sf0.001"
    for messages in (odd_messages(spark, d).select("offset", "value", "ts").unionByName(cut), I.messages(spark, d).select("offset", "value", "ts")):
        good, bad = S.decode_spider_log(messages)
        n = 0
        for t in S.EVENT_TYPES:
            plain = [c for c in S.events_of(good, t).columns if not c.endswith("_all")]
            one, two = S.events_of(good, t).select(plain).collect(), S.decode_events(messages, t).select(plain).collect()
            assert sorted(map(repr, one)) == sorted(map(repr, two))
            n += len(one)
        assert n + bad.count() == messages.count()
    reasons = {r.offset: r.reason for r in S.decode_spider_log(cut)[1].collect()}
    assert reasons == {-1: "undecodable", -2: "undecodable", -5: "unknown type"}
    with pytest.raises(ValueError):
        S.decode_events(cut, "surprise")


def test_offsets_parse_no_link_list_and_decode_no_body(spark, capsys):
    import __spark_entry__ as E
    E.queries()["e4_offsets"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out.split("from_json", 1)[1]
    # the encoder of the query's input names links and bodies too; the decoder stands above it
    parsed = "from_json" + plan.split("Generate", 1)[0]
    assert "partition_id" in parsed and "links" not in parsed and "headers" not in parsed and "unbase64" not in parsed.lower()
