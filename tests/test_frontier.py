"""Frontier goldens."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlframe.operators import frontier as Q

T0 = dt.datetime(2024, 1, 1)


def _q(spark, rows):
    return spark.createDataFrame(rows, "partition_id int, score double, url string, fingerprint string, "
                                       "created_at timestamp_ntz, depth smallint")


def test_bad_partitions(spark):
    q = _q(spark, [(0, 0.5, "u", "f", T0, 0)])
    for parts in ([2], [-1]):
        with pytest.raises(ValueError):
            Q.next_batch(q, parts, 10)


def test_batch_order(spark):
    q = _q(spark, [(0, 0.9, "a", "fa", T0, 0), (0, 0.5, "b", "fb", T0 + dt.timedelta(seconds=2), 0),
                   (0, 0.5, "c", "fc", T0 + dt.timedelta(seconds=1), 0), (1, 0.1, "d", "fd", T0, 0)])
    got = [r.url for r in Q.next_batch(q, [0], 2).orderBy(F.col("score").desc(), "created_at").collect()]
    assert got == ["a", "c"]


def test_cap_per_host(spark):
    rows = [(f"http://h/{i}", float(i), T0) for i in range(12)]
    df = spark.createDataFrame(rows, "url string, score double, created_at timestamp_ntz") \
        .withColumn("fingerprint", F.col("url"))
    assert Q.cap_per_host(df, 10).count() == 10


def test_revisit(spark):
    now = dt.datetime(2024, 1, 10)
    df = spark.createDataFrame([(now - dt.timedelta(days=3),), (now - dt.timedelta(days=3) + dt.timedelta(seconds=1),),
                                (None,)], "fetched_at timestamp_ntz")
    got = [r.fetched_at for r in Q.due_for_revisit(df, F.lit(now).cast("timestamp_ntz")).collect()]
    assert got == [now - dt.timedelta(days=3), None]


def test_scores_no_schedule(spark):
    md = spark.createDataFrame([("f1", None)], "fingerprint string, score double")
    q = _q(spark, []).drop("host")
    upd = spark.createDataFrame([("f1", "http://h/a", 0.5, False, T0)],
                                "fingerprint string, url string, score double, schedule boolean, ts timestamp_ntz")
    md2, q2 = Q.apply_scores(md, Q.to_queue(q.select("url", "score", "created_at", "depth")), upd)
    assert md2.first().score == 0.5 and q2.count() == 0


def test_consume_batch(spark):
    q = _q(spark, [(0, 0.1 * i, f"u{i}", f"f{i}", T0, 0) for i in range(10)])
    batch = Q.next_batch(q, [0], 4)
    rest, states = Q.consume_batch(q, batch)
    assert rest.count() + batch.count() == q.count()
    assert rest.join(batch, "fingerprint").count() == 0
    assert {r.state for r in states.collect()} == {Q.QUEUED}


def test_seen_filter(spark):
    c = spark.createDataFrame([("f1", "http://a/", T0), ("f1", "https://a/", T0 + dt.timedelta(days=1)),
                               ("f2", "http://b/", T0)], "fingerprint string, url string, created_at timestamp_ntz")
    seen = spark.createDataFrame([("f2",)], "fingerprint string")
    assert [(r.fingerprint, r.url) for r in Q.filter_unseen(c, seen).collect()] == [("f1", "http://a/")]


def test_states_and_partition_invariant(spark):
    t = spark.createDataFrame([("f", 0, T0), ("f", 2, T0 + dt.timedelta(1)), ("f", 1, T0 + dt.timedelta(1)),
                               ("g", 3, T0)], "fingerprint string, state int, ts timestamp_ntz")
    assert {r.fingerprint: r.state for r in Q.url_states(t).collect()} == {"f": 2, "g": 3}
    urls = spark.createDataFrame([(f"http://h{i % 5}.org/{i}",) for i in range(50)], "url string")
    p = Q.assign_partition(urls).withColumn("h", F.regexp_extract("url", "//([^/]+)", 1))
    assert p.groupBy("h").agg(F.countDistinct("partition_id").alias("n")).where("n > 1").count() == 0


def test_reset_frontier(spark):
    Q.reset_frontier(spark, "frontier_test", {"states": spark.createDataFrame([("f", 1)], "fingerprint string, state smallint")})
    assert spark.table("frontier_test.states").count() == 1
    Q.reset_frontier(spark, "frontier_test")
    assert spark.sql("SHOW TABLES IN frontier_test").count() == 0


def test_next_batch_prunes_stored_partitions(spark):
    from crawlframe.session import scratch_path
    rows = [(f"http://h{i % 7}.org/{i}", 0.01 * i, T0 + dt.timedelta(seconds=i), i % 3) for i in range(200)]
    req = spark.createDataFrame(rows, "url string, score double, created_at timestamp_ntz, depth int")
    path = scratch_path(spark, "queue")
    Q.write_queue(Q.to_queue(req), path)
    stored = spark.read.parquet(path)
    batch = Q.next_batch(stored, [1], 5)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_id" in plan and "WindowGroupLimit" in plan
    assert {r.partition_id for r in batch.collect()} == {1} and batch.count() == 5


def test_event_merge_is_ordered_by_time_and_keeps_other_columns(spark):
    from datetime import datetime as D
    md = spark.createDataFrame([("f", "u", 2, D(2024, 1, 1), D(2024, 1, 20), 200, None, 7.5, {"h": ["v"]})],
                               "fingerprint string, url string, depth int, created_at timestamp_ntz, fetched_at timestamp_ntz, "
                               "status_code int, error string, score double, headers map<string,array<string>>")
    fact = "fingerprint string, kind string, url string, depth int, status_code int, error string, ts timestamp_ntz"
    old = spark.createDataFrame([("f", "crawl", "u", None, 500, None, D(2024, 1, 5)), ("f", "error", "u", None, None, "late", D(2024, 1, 6)),
                                 ("g", "crawl", "v", None, 301, None, D(2024, 1, 2))], fact)
    new = spark.createDataFrame([("f", "error", "u", None, None, "down", D(2024, 1, 21)), ("f", "crawl", "u", None, 404, None, D(2024, 1, 20))], fact)
    once = Q.apply_event_facts(md, old)
    row = {r.fingerprint: r for r in once.collect()}
    assert (row["f"].fetched_at, row["f"].status_code, row["f"].error, row["f"].score, row["f"].headers) == (D(2024, 1, 20), 200, None, 7.5, {"h": ["v"]})
    assert (row["g"].status_code, row["g"].score) == (301, None)
    a = Q.apply_event_facts(Q.apply_event_facts(once, new), old)
    b = Q.apply_event_facts(Q.apply_event_facts(md, new), old)
    assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    final = {r.fingerprint: r for r in a.collect()}["f"]
    assert (final.status_code, final.error, final.error_at) == (404, "down", D(2024, 1, 21))


def test_scores_reach_unknown_urls_and_map_columns_pass_the_seen_filter(spark):
    from datetime import datetime as D
    queue = Q.to_queue(spark.createDataFrame([("http://a/", 1.0, D(2024, 1, 1), 0)], "url string, score double, created_at timestamp_ntz, depth int"))
    queue = queue.withColumn("headers", F.create_map(F.lit("a"), F.array(F.lit("b"))))
    upd = spark.createDataFrame([("x", "http://b/", 0.1, True, D(2024, 1, 2), 7, 1), ("x", "http://b/", 0.9, False, D(2024, 1, 2), 7, 0)],
                                "fingerprint string, url string, score double, schedule boolean, ts timestamp_ntz, depth int, offset long")
    md = spark.createDataFrame([("y", 5.0)], "fingerprint string, score double")
    metadata, after = Q.apply_scores(md, queue, upd)
    assert {r.fingerprint: r.score for r in metadata.collect()} == {"x": 0.1, "y": 5.0}
    assert {(r.url, r.depth) for r in after.collect()} == {("http://a/", 0), ("http://b/", 7)}
    assert {r.url for r in Q.filter_unseen(after, after.where("url = 'http://a/'")).collect()} == {"http://b/"}


def test_hot_partition_is_written_and_batched_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60_000).select(F.concat(F.lit("http://same/"), F.sha2(F.col("id").cast("string"), 256)).alias("url"),
                                          (F.col("id") / 7).alias("score"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.lit(0).alias("depth"))
        Q.write_queue(Q.to_queue(rows.repartition(8)), str(tmp_path / "q"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (part,) = [p for p in (tmp_path / "q").iterdir() if p.name.startswith("partition_id=")]
    assert len(list(part.glob("*.parquet"))) > 1
    stored = spark.read.parquet(str(tmp_path / "q"))
    top = Q.next_batch(stored, [0, 1], 10)
    assert sorted(r.score for r in top.collect()) == [k / 7 for k in range(59_990, 60_000)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_fair_batch_when_one_host_holds_most_of_the_queue(spark):
    import random
    rng = random.Random(6)
    rows = []
    for k in range(1000):
        host = 0 if k < 700 else rng.randrange(1, 60)
        rows.append((host % 2, rng.randrange(100) / 100, f"http://h{host}/{k}", f"{host:08x}{k:032d}", T0 + dt.timedelta(seconds=k % 50), 0, host))
    q = spark.createDataFrame(rows, "partition_id int, score double, url string, fingerprint string, created_at timestamp_ntz, depth int, host_crc32 long").repartition(7)
    for n, per_host in ((20, 4), (200, 3), (10, 1000)):
        got = Q.fair_batch(q, [0, 1], n, per_host).collect()
        want, rank = set(), {}
        for r in sorted(rows, key=lambda r: (-r[1], r[4], r[3])):
            rank[r[6]] = rank.get(r[6], 0) + 1
            if rank[r[6]] <= per_host:
                want.add((rank[r[6]], -r[1], r[4], r[3], r[0]))
        want = {x[3] for p in (0, 1) for x in sorted(w for w in want if w[4] == p)[:n]}
        assert {r.fingerprint for r in got} == want and len(got) == len(want) and got[0].__fields__ == q.columns
    assert Q.fair_batch(q, [1], 30, 5).where("partition_id = 0").count() == 0
