"""F8 as a stream: timers, replaced timers, restart, late and missing fetch times."""

import datetime as dt
import os

from crawlframe.streaming import revisit

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "fingerprint string, url string, fetched_at timestamp"


def test_due_urls_follow_the_watermark_over_a_restart(spark, tmp_path):
    feed, out, ckpt = (str(tmp_path / n) for n in ("feed", "out", "ckpt"))
    at = lambda hours: T0 + dt.timedelta(hours=hours)
    count = 0

    def come(*batches):
        nonlocal count
        for rows in batches:
            spark.createDataFrame([(f, f"u-{f}", t) for f, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
            for f in (tmp_path / "feed").glob("*.parquet"):
                if not (tmp_path / f"old-{f.name}").exists():
                    os.utime(f, (1_700_000_000 + 100 * count,) * 2)
                    (tmp_path / f"old-{f.name}").touch()
            count += 1
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
        revisit.stream_due(stream, out, ckpt, "3 days", "1 hour").awaitTermination()
        return {(r.fingerprint, r.url, r.fetched_at) for r in revisit.read_due(spark, out).collect()}

    due = come([("a", at(0)), ("b", at(1)), ("never", None), (None, at(0))], [("a", at(2)), ("a", at(1)), ("c", at(30))])
    assert due == {("never", "u-never", None)}  # the watermark stands at hour 29
    # after the restart: hour 74 makes the watermark 73, so b (due at 73) ends and a (due at 74) does not
    due = come([("d", at(74))])
    assert due == {("never", "u-never", None), ("b", "u-b", at(1))}
    # b is fetched again and no longer due; a late fetch of a counts for nothing; a ends; never is fetched
    due = come([("b", at(75)), ("a", at(40)), ("never", at(75))], [("e", at(80))])
    assert due == {("a", "u-a", at(2))}


def test_equals_the_table_job_at_the_final_watermark(spark, tmp_path):
    import random
    from pyspark.sql import functions as F
    from crawlframe.operators.frontier import due_for_revisit
    rng = random.Random(1)
    rows = sorted([(f"f{rng.randrange(40)}", "u", T0 + dt.timedelta(minutes=rng.randrange(20000))) for _ in range(200)], key=lambda r: r[2])
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    df.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "feed"))
    revisit.stream_due(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "3 days", "0 seconds").awaitTermination()
    latest = df.groupBy("fingerprint").agg(F.max("fetched_at").alias("fetched_at"))
    want = {(r.fingerprint, r.fetched_at) for r in due_for_revisit(latest, F.lit(rows[-1][2])).collect()}
    assert {(r.fingerprint, r.fetched_at) for r in revisit.read_due(spark, str(tmp_path / "out")).collect()} == want != set()
