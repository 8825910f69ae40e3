"""Streams of connections: frames cut over batches, silence, order of arrival."""

import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docflow.operators import sessions
from docflow.streaming import live

START = datetime(2024, 1, 1)


def frame(kind, payload, crc=None):
    head = bytes([0x59, 0x41, 1, kind, 0, 0]) + len(payload).to_bytes(4, "little")
    return head + (zlib.crc32(payload) if crc is None else crc).to_bytes(4, "little") + payload


def arriving(spark, folder, batches, schema):
    """A stream of one file per batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(hours):
    return START + timedelta(hours=hours)


def test_frames_over_batches(spark, tmp_path):
    long, other = frame(20, b"x" * 40), frame(11, b"abc")
    batches = [
        [(1, at(0), 1, long[:5]), (2, at(0), 1, other[:9]), (3, at(0), 1, other), (4, at(0), 1, frame(10, b"bad", 7))],
        [(1, at(1), 2, long[5:30]), (1, at(0), 1, long[:5]), (4, at(1), 2, other)],  # the first chunk again
        [(1, at(2), 3, long[30:] + other), (5, at(2), 1, b"")],
        [(2, at(30), 2, other), (6, at(31), 1, other[:3])],  # 2 was silent for longer than a day
        [(7, at(90), 1, other)],  # the watermark passes 6 and closes it
    ]
    stream = arriving(spark, str(tmp_path / "in"), batches, "session long, ts timestamp, seq long, data binary")
    frames = live.run_available(live.frame_connections_stream(stream, "1 day", "1 minute"), str(tmp_path / "out"))
    got = sorted((r.session, r.opened, r.frame_no, r.type, r.payload and bytes(r.payload), r.reason) for r in frames.collect())
    assert [g for g in got if g[0] == 1] == [(1, at(0), 1, 20, b"x" * 40, None), (1, at(0), 2, 11, b"abc", None)]
    assert [g for g in got if g[0] == 2] == [(2, at(0), 1, None, None, "incomplete"), (2, at(30), 1, 11, b"abc", None)]
    assert [g for g in got if g[0] == 4] == [(4, at(0), 1, None, None, "bad_crc")]
    assert [g for g in got if g[0] == 6] == [(6, at(31), 1, None, None, "incomplete")]
    assert {g[0] for g in got} == {1, 2, 3, 4, 6, 7}


def test_intervals_in_any_order(spark, tmp_path):
    """The stream gives the batch's rows, though packets arrive out of order."""
    acts = [(1, 0, "start"), (1, 2, "start"), (1, 3, "stop"), (1, 4, "start"), (1, 5, "disconnect"), (1, 6, "start"), (2, 0, "start"), (2, 1, "ping"),
            (1, 40, "start"), (1, 41, "stop"), (3, 1, "stop"), (3, 2, "ping"), (9, 200, "ping")]
    rows = [(s, at(h), k, a) for k, (s, h, a) in enumerate(acts)]
    schema = "session long, ts timestamp, seq long, action string"
    shuffled = [[rows[i] for i in order] for order in ((3, 1, 6), (0, 2, 10), (5, 4, 11, 7), (9, 8), (12,))]
    stream = arriving(spark, str(tmp_path / "in"), shuffled, schema)
    got = live.run_available(live.session_intervals_stream(stream, "1 day", "6 hours"), str(tmp_path / "out"))
    want = sessions.session_state(spark.createDataFrame(rows, schema), "1 day").where("session <> 9")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert (2, at(0), at(25)) in set(map(tuple, got.collect()))


@pytest.mark.parametrize("gap", ["10 minutes", "6 hours"])
def test_stretches_as_session_windows(spark, gap):
    times = [(k % 3 == 0 and "hot" or f"h{k % 7}", START + timedelta(seconds=(k * k * 37) % 900_000)) for k in range(600)]
    rows = spark.createDataFrame(times, "host string, ts timestamp")
    want = rows.groupBy("host", F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    got = sessions.host_presence(rows, gap)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("host", "w.start", "last", "n").collect()))


def test_sliding_windows_as_copies(spark):
    rows = spark.range(500).select(
        (F.lit(START).cast("timestamp") + F.make_interval(secs=(F.col("id") * 971).cast("int"))).alias("ts"), (F.col("id") % 3).alias("session"), (F.col("id") % 2).alias("type"), (F.col("id") % 50).alias("bytes"))
    want = rows.groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "session", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    got = sessions.traffic_windows(rows, "6 hours", "2 hours")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("w.start", "session", "type", "n", "bytes").collect()))
    with pytest.raises(ValueError):
        sessions.traffic_windows(rows, "5 hours", "2 hours")
