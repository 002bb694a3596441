"""Seeds (S1-S3), robots (T8), sinks (K1, K2)."""

import os
import tempfile

from pyspark.sql import functions as F

from crawlframe.operators.robots import apply_robots
from crawlframe.sources.seeds import read_seeds


def _tmp(name, text):
    d = tempfile.mkdtemp(prefix="crawlframe-test-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_text_seeds(spark):
    p = _tmp("seeds.txt", "http://a/ \nhttp://b/\n\nhttp://c/")
    assert [r.url for r in read_seeds(spark, p).collect()] == ["http://a/", "http://b/", "http://c/"]


def test_csv_seeds(spark):
    p = _tmp("list.csv", 'p1\thttp://x/1\np2\t\np3\t"http://x/3"\n')
    assert [(r.url, r.source_page) for r in read_seeds(spark, p).collect()] == [("http://x/1", "p1"), ("http://x/3", "p3")]


def test_no_seeds(spark):
    df = read_seeds(spark, None)
    assert df.count() == 0 and df.columns == ["url", "source_page"]


def test_robots(spark):
    rules = spark.createDataFrame([("h", "*", False, "/private"), ("h", "*", True, "/private/ok"),
                                   ("h", "*", False, "/*.pdf$"), ("g", "bot", False, "/"), ("g", "*", True, "/")],
                                  "host string, agent string, allow boolean, pattern string")
    urls = spark.createDataFrame([(u,) for u in ["http://h/private/x", "http://h/private/ok/1", "http://h/a.pdf",
                                                 "http://h/a.pdf?x", "http://g/any", "http://z/"]], "url string")
    got = {r.url: r.status_code for r in apply_robots(urls, rules, "bot").collect()}
    assert got == {"http://h/private/x": -9998, "http://h/private/ok/1": None, "http://h/a.pdf": -9998,
                   "http://h/a.pdf?x": None, "http://g/any": -9998, "http://z/": None}


def test_sinks(spark):
    import __spark_entry__ as E
    from crawlframe.plans.q_crawllog import all_outcomes_log
    from crawlframe.session import scratch_path
    from crawlframe.sinks.files import write_crawl_log, write_items_jsonl
    from crawlframe.operators.crawllog import items_feed
    log = all_outcomes_log(spark, "/root/testdata/sf0.001")
    out = scratch_path(spark, "crawl-log")
    write_crawl_log(log, out)
    back = spark.read.text(out)
    assert back.count() == log.count() and "log_date" in back.columns
    items = scratch_path(spark, "items")
    write_items_jsonl(items_feed(log), items)
    j = spark.read.json(items)
    assert j.count() == items_feed(log).count() and "content_digest" in j.columns


def test_crawl_log_of_one_hot_day_is_several_files(spark, tmp_path):
    from crawlframe.sinks.files import crawl_log_partitions, write_crawl_log
    log = spark.range(60_000).select(
        F.lit("2024-01-02T03:04:05").cast("timestamp_ntz").alias("timestamp"), F.lit(200).alias("status_code"), F.lit(1).alias("content_length"),
        F.concat(F.lit("http://h/"), F.sha2(F.col("id").cast("string"), 256)).alias("url"), *[F.lit("-").alias(c) for c in (
            "hop_path", "via", "mimetype", "thread", "start_time_plus_duration", "content_digest", "seed", "annotations")])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        write_crawl_log(log.repartition(6), str(tmp_path / "log"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (day,) = [p for p in (tmp_path / "log").iterdir() if p.name == "log_date=2024-01-02"]
    assert len(list(day.glob("*.txt"))) > 1
    assert spark.read.text(str(tmp_path / "log")).count() == crawl_log_partitions(log).count() == 60_000


def test_a_feed_step_is_one_file_that_many_tasks_share(spark):
    import pyarrow.parquet as pq
    from crawlframe.plans.inputs import feed_in_order
    rows = spark.range(60000).select(F.col("id").alias("n"), F.concat(*[F.sha2(F.concat("id", F.lit(f"/{k}")), 512) for k in range(2)]).alias("value"))
    path = feed_in_order(spark, rows, "n", 2)
    files = sorted(f.split(":", 1)[1].replace("///", "/") for f in spark.read.parquet(path).inputFiles())
    assert len(files) == 2 and all(pq.ParquetFile(f).num_row_groups > 3 for f in files)  # a row group goes to one task
    ends = sorted((pq.read_table(f)["n"].to_pylist() for f in files), key=min)
    assert max(ends[0]) < min(ends[1]) and sorted(ends[0] + ends[1]) == list(range(60000))


def test_a_feed_step_is_several_files_and_its_rows_are_computed_once(spark):
    import os
    import pyarrow.parquet as pq
    from crawlframe.plans.inputs import feed_in_order
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(n):
        seen.add(1)
        return f"v{n}"

    late = F.timestamp_add("SECOND", "id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = spark.range(3000, numPartitions=3).select(F.when(F.col("id") > 9, late).alias("t"), "id", costly("id").alias("value"))
    path = feed_in_order(spark, rows, "t", 3, 4)
    assert seen.value == 3000  # the bounds of the steps come from the column of the order alone
    files = sorted((f.split(":", 1)[1].replace("///", "/") for f in spark.read.parquet(path).inputFiles()), key=lambda f: os.stat(f).st_mtime_ns)
    ids = [pq.read_table(f)["id"].to_pylist() for f in files]
    assert len(files) == 12 and all(len(x) > 200 for x in ids)
    steps = [sum(ids[k:k + 4], []) for k in (0, 4, 8)]  # nulls come first
    assert max(steps[0]) < min(steps[1]) and max(steps[1]) < min(steps[2]) and sorted(sum(steps, [])) == list(range(3000))


def test_a_feed_of_no_rows_and_of_equal_times_is_whole(spark):
    from crawlframe.plans.inputs import feed_in_order
    rows = spark.range(50).select(F.lit(7).cast("long").alias("n"), "id")
    assert spark.read.parquet(feed_in_order(spark, rows, "n", 3, 4)).count() == 50
    nulls = rows.withColumn("n", F.lit(None).cast("long"))
    assert spark.read.parquet(feed_in_order(spark, nulls, "n", 3, 4)).count() == 50
    assert spark.read.parquet(feed_in_order(spark, rows.where("id < 0"), "n", 3, 4)).count() == 0
