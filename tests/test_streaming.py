"""The stream debouncer gives the events of its batch twin."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import files
from tallyweave.streaming import monitor, state


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for source in range(3):
        on = {"A": False, "B": False}
        for hop in range(60):
            for c in on:
                on[c] = rnd.random() < (0.85 if on[c] else 0.15)
            rows.append((source, hop, [c for c in on if on[c]]))
    schema = "source long, hop long, codes array<string>"
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "in")
    for a in range(0, 60, 20):
        df.where((F.col("hop") >= a) & (F.col("hop") < a + 20)).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    q = (
        monitor.stream_confirmations(stream, 3, 5).writeStream.format("memory").queryName("confirmed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("confirmed").collect()}
    long = df.select("source", "hop", F.explode_outer("codes").alias("code")).withColumn("fired", F.col("code").isNotNull())
    want = {(r.source, r.code, r.hop, r.event) for r in monitor.confirmations(long, 3, 5).collect()}
    assert got == want and len(want) > 5
    with pytest.raises(ValueError):
        monitor.confirmations(long, 6, 5)


def test_chunks_arrive_whole_and_in_order(spark, tmp_path):
    schema = "source long, t_start double, samples array<double>"
    rows = spark.createDataFrame([(1, float(t), [t + 0.5, t + 0.75]) for t in range(6)], schema)
    src, seen = str(tmp_path / "chunks"), []
    for t in range(0, 6, 2):
        rows.where((F.col("t_start") >= t) & (F.col("t_start") < t + 2)).coalesce(1).write.mode("append").parquet(src)
    keep = lambda df, k: seen.append((k, sorted((r.t_start, *r.samples) for r in df.collect())))
    q = files.chunk_stream(spark, src, schema).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 3
    assert [r for _, batch in sorted(seen) for r in batch] == [(float(t), t + 0.5, t + 0.75) for t in range(6)]


def monitored(spark, src, at, n):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("source long, seq long, n long, codes array<string>").option("maxFilesPerTrigger", 1).json(src)
    q = state.stream_monitor(stream, window=100, hop=40, k=2, m=3).writeStream.format("json").option("path", str(at / "out")).outputMode("append").option("checkpointLocation", str(at / "cp")).start()
    seen, ends = {}, time.time() + 100  # timers keep the stream busy without end, so its input is counted
    while sum(seen.values()) < n and time.time() < ends:
        seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
        time.sleep(0.2)
    q.stop()
    assert sum(seen.values()) == n


def test_stream_monitor_equals_batch_over_a_restart_and_resets(spark, tmp_path):
    rnd = random.Random(9)
    rows = []
    for source in range(3):
        for seq in range(90):
            reset = source == 1 and seq in (31, 32) or source == 2 and seq == 60
            rows.append((source, seq, None if reset else rnd.choice([0, 5, 30, 45, 130]), [] if reset else [c for c in "AB" if rnd.random() < (0.7 if (seq // 15) % 2 else 0.2)]))
    schema = "source long, seq long, n long, codes array<string>"
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "in")
    for a in (0, 30):
        df.where((F.col("seq") >= a) & (F.col("seq") < a + 30)).coalesce(1).write.mode("append").json(src)
    monitored(spark, src, tmp_path, 180)
    df.where("seq >= 60").coalesce(1).write.mode("append").json(src)
    monitored(spark, src, tmp_path, 90)  # goes on from the state of the first run
    got = sorted(map(str, spark.read.schema(state.OUTPUT).json(str(tmp_path / "out")).collect()))
    want = state.monitor_events(df, window=100, hop=40, k=2, m=3)
    assert got == sorted(map(str, want.select("source", "seq", "event", "code", "total", "skipped").collect()))
    events = {r.event for r in want.collect()}
    assert events == {"analysis", "reset", "onset", "offset"} and want.where("skipped > 0").count() > 5


def test_oversized_chunks_give_one_analysis(spark):
    df = spark.createDataFrame([(1, 1, 99, []), (1, 2, 1, []), (1, 3, 500, []), (1, 4, 1, []), (1, 5, None, []), (1, 6, 99, []), (1, 7, 300, [])], "source long, seq long, n long, codes array<string>")
    got = [(r.seq, r.total, r.skipped) for r in state.due_analyses(df, 100, 40).orderBy("seq").collect()]
    assert got == [(2, 100, 0), (3, 600, 11), (7, 399, 7)]
