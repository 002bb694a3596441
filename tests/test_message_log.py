"""The message log's source and sink, with restarts, retries and lost tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from crawlframe.sources.message_log import Log, MessageLogStreamReader, MessageLogWriter, Staged, fair_shares
from crawlframe.streaming import spiderlog as S


def _feed(spark, tmp_path, n, name="in", start=0):
    """n messages over three partitions, sequence 0 to n - 1."""
    df = spark.range(start, start + n).select(
        F.concat(F.lit("k"), F.col("id") % 5).cast("binary").alias("key"), F.concat(F.lit("v"), F.col("id")).cast("binary").alias("value"),
        (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("sequence"))
    df.repartition(4).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def _write(spark, tmp_path, n, start=0):
    S.write_spider_log(_feed(spark, tmp_path, n, start=start), str(tmp_path / "log"), str(tmp_path / "w-ckpt"), 3).awaitTermination()


def _values(df):
    return sorted((r.partition, r.offset, bytes(r.value).decode()) for r in df.collect())


def test_written_messages_are_ordered_and_numbered_per_partition(spark, tmp_path):
    _write(spark, tmp_path, 20)
    _write(spark, tmp_path, 10, start=20)
    got = _values(S.read_whole_log(spark, str(tmp_path / "log")))
    assert got == [(p, k, f"v{3 * k + p}") for p in range(3) for k in range(10)]


def test_polls_are_bounded_and_go_on_after_a_restart(spark, tmp_path):
    _write(spark, tmp_path, 30)
    polls = []

    def poll(most, partitions=None, ckpt="r-ckpt"):
        def keep(batch, _):
            polls.append(_values(batch))
        stream = S.read_log(spark, str(tmp_path / "log"), partitions, most)
        stream.writeStream.option("checkpointLocation", str(tmp_path / ckpt)).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        return polls.pop() if polls else []

    first, second = poll(7), poll(11)  # each is a new query on the old checkpoint
    assert len(first) == 7 and len(second) == 11 and not set(first) & set(second)
    _write(spark, tmp_path, 6, start=30)
    third = poll(1000)
    assert sorted(first + second + third) == [(p, k, f"v{3 * k + p}") for p in range(3) for k in range(12)]
    assert poll(1000) == []
    assert {p for p, *_ in poll(1000, [1], "one-ckpt")} == {1}


def test_continuous_polls_reach_the_end(spark, tmp_path):
    _write(spark, tmp_path, 30)
    sizes = []
    stream = S.read_log(spark, str(tmp_path / "log"), None, 8)
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: sizes.append(b.count())).start()
    q.processAllAvailable()
    q.stop()
    assert sum(sizes) == 30 and max(sizes) <= 8


def test_a_task_holds_one_record_batch_of_messages_in_order(tmp_path):
    import pyarrow as pa
    alive = []

    def batches():
        for k in range(40):
            values = pa.array([b"%08d" % (k * 1000 + i) * 100 for i in range(1000)], pa.binary())  # 0.8 MB
            alive.append(pa.total_allocated_bytes())
            yield pa.record_batch({"key": [b"k"] * 1000, "value": values, "partition": pa.array([k // 20] * 1000, pa.int32()), "sequence": range(k * 1000, k * 1000 + 1000)})

    writer = MessageLogWriter({"path": str(tmp_path / "log"), "inorder": "True"})
    before = pa.total_allocated_bytes()
    writer.commit([writer.write(batches())], 0)
    assert max(alive) - before < 16e6  # of 32 MB
    log = Log(str(tmp_path / "log"))
    got = [v for p in (0, 1) for s in log.plan({}, {p: log.bounds(p)[1]}) for b in log.read(s) for v in b.column("value").to_pylist()]
    assert [int(v[:8]) for v in got] == list(range(40000)) and log.bounds(0) == log.bounds(1) == (0, 20000)


def test_spark_sorts_the_messages_of_a_micro_batch(spark, tmp_path):
    q = S.write_spider_log(_feed(spark, tmp_path, 25), str(tmp_path / "log"), str(tmp_path / "w-ckpt"), 3)
    q.awaitTermination()
    assert "ForeachBatch" in q.recentProgress[0].sink.description  # a stream cannot be sorted, its sink would have to
    assert _values(S.read_whole_log(spark, str(tmp_path / "log"))) == [(k % 3, k // 3, f"v{k}") for k in sorted(range(25), key=lambda k: (k % 3, k))]


def test_a_repeated_commit_changes_nothing_and_a_broken_one_is_finished(spark, tmp_path):
    import pyarrow as pa
    writer = MessageLogWriter({"path": str(tmp_path / "log")})
    batch = lambda values: pa.record_batch({"key": [b"k"] * len(values), "value": values, "partition": pa.array([0] * len(values), pa.int32())})
    one = writer.write(iter([batch([b"a", b"b"])]))
    lost = writer.write(iter([batch([b"lost"])]))  # its task's answer never came
    log = Log(str(tmp_path / "log"))
    assert log.partitions() == []  # nothing to see before the commit
    writer.commit([one, None], 0)
    again = writer.write(iter([batch([b"a", b"b"])]))
    writer.commit([again], 0)
    assert log.bounds(0) == (0, 2)
    two = writer.write(iter([batch([b"c"])]))
    moves = [(two.files[0][1], f"{log.root}/partition=0/{2:020d}-{2:020d}.parquet")]
    log.put("_commits/writer-1.json", json.dumps(moves).encode())  # the driver died after the record, before the rename
    writer.commit([writer.write(iter([batch([b"c"])]))], 1)
    assert _values(S.read_whole_log(spark, str(tmp_path / "log"))) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c")]
    three = writer.write(iter([batch([b"d"])]))
    writer.abort([three, None], 2)
    assert [f for f in os.listdir(tmp_path / "log" / "_staged")] == [os.path.basename(lost.files[0][1])]
    assert writer.write(iter([])).files == [] and Staged([]).files == []


def test_a_killed_task_leaves_no_half_segment(spark, tmp_path):
    _write(spark, tmp_path, 6)
    bad = _feed(spark, tmp_path, 9, name="bad", start=6).withColumn(
        "value", F.when(F.col("sequence") == 11, F.raise_error(F.lit("task killed")).cast("binary")).otherwise(F.col("value")))
    with pytest.raises(Exception):
        S.write_spider_log(bad, str(tmp_path / "log"), str(tmp_path / "bad-ckpt"), 3, writer="bad").awaitTermination()
    assert len(_values(S.read_whole_log(spark, str(tmp_path / "log")))) == 6


def test_shares_starting_offsets_and_gaps(spark, tmp_path):
    assert fair_shares({0: 100, 1: 2, 2: 100}, 12) == {1: 2, 0: 5, 2: 5} and fair_shares({0: 1}, 9) == {0: 1} and fair_shares({}, 5) == {}
    _write(spark, tmp_path, 12)
    reader = lambda **o: MessageLogStreamReader({"path": str(tmp_path / "log"), **o})
    assert reader().initialOffset() == {"0": 0, "1": 0, "2": 0}
    assert reader(startingoffsets="latest").initialOffset() == {"0": 4, "1": 4, "2": 4}
    assert reader(startingoffsets='{"1": 3}', partitions="1,2").initialOffset() == {"1": 3, "2": 0}
    segment = next((tmp_path / "log" / "partition=1").glob("*.parquet"))
    segment.rename(segment.with_name(f"{2:020d}-{5:020d}.parquet"))
    with pytest.raises(ValueError, match="gone"):
        reader().partitions({"1": 0}, {"1": 4})
    assert S.read_whole_log(spark, str(tmp_path / "nothing")).collect() == []
