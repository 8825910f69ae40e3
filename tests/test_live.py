"""Wire formats and the live operators."""

import struct
import zlib

from pyspark.sql import functions as F

from docflow.functions import wire
from docflow.operators import sessions
from docflow.streaming import live


def frame(kind, payload, crc=None, magic=b"\x59\x41", version=1, length=None):
    size = len(payload) if length is None else length
    return magic + bytes([version, kind, 0, 0]) + struct.pack("<II", size, zlib.crc32(payload) if crc is None else crc) + payload


def beacon(role=2, port=5406, name=b"pc", magic=bytes.fromhex("594144"), version=1, size=None):
    return magic + bytes([version, role]) + struct.pack("<H", port) + bytes([len(name) if size is None else size]) + name


def column(spark, values, make):
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, v binary")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_beacons(spark):
    good = [beacon(), beacon(name=b""), beacon(role=1, port=65535, name="ўз".encode()), beacon() + b"tail"]
    bad = [b"", bytes.fromhex("594144"), beacon(magic=bytes.fromhex("594145")), beacon(version=2), beacon(role=3), beacon(port=0), beacon(size=9)]
    got = column(spark, good + bad, wire.parse_beacon)
    assert [tuple(g) for g in got[:4]] == [(2, 5406, "pc"), (2, 5406, ""), (1, 65535, "ўз"), (2, 5406, "pc")]
    assert got[4:] == [None] * len(bad)


def test_frames(spark):
    cases = {
        frame(3, b"hi"): None, frame(3, b""): None, frame(3, b"hi")[:-1]: "incomplete", b"\x59": "incomplete",
        frame(3, b"hi", magic=b"XX"): "bad_magic", frame(3, b"hi", version=2): "bad_version",
        frame(3, b"hi", length=64 * 2**20 + 1): "too_long", frame(3, b"hi", crc=1): "bad_crc"}
    assert column(spark, list(cases), wire.frame_reason) == list(cases.values())
    built = spark.range(1).select(wire.build_frame(F.lit(11), F.lit(b"data")).alias("f")).collect()[0].f
    assert bytes(built) == frame(11, b"data")


def test_input_events(spark):
    pack = lambda kind, button=1, on=1, x=0.25, y=-1.5, wheel=-120, key=300: bytes([kind, button, on, 0]) + struct.pack("<ffiH", x, y, wheel, key)
    got = column(spark, [pack(1), pack(2), pack(3), pack(4), pack(9), pack(1)[:-1], pack(1, x=1e-40)], wire.parse_input)
    assert (got[0].kind, got[0].x, got[0].y, got[0].key) == ("MouseMove", 0.25, -1.5, None)
    assert (got[1].kind, got[1].button, got[1].pressed) == ("MouseButton", 1, True)
    assert (got[2].kind, got[2].wheel) == ("MouseWheel", -120)
    assert (got[3].kind, got[3].key) == ("Key", 300)
    assert got[4:6] == [None, None]
    assert abs(got[6].x - struct.unpack("<f", struct.pack("<f", 1e-40))[0]) < 1e-50


def test_screens_and_commands(spark):
    screens = [struct.pack("<iiB", 800, 600, 1) + b"img", struct.pack("<iiB", 0, 600, 1), struct.pack("<iiB", 1, 16385, 1), b"short"]
    got = column(spark, screens, wire.parse_screen)
    assert (got[0].width, got[0].height, bytes(got[0].image)) == (800, 600, b"img")
    assert got[1:] == [None, None, None]
    commands = [b"\x01\x00\x02\x00hi", b"\x02\x00\x00\x00", b"\x03\x00\x00\x00", b"\x01\x00\x05\x00hi", b"\x01"]
    got = column(spark, commands, wire.parse_command)
    assert [(g.kind, g.text) if g else None for g in got] == [("ShowMessage", "hi"), ("LockScreen", None), None, None, None]


def chunk_rows():
    one = frame(3, b"") + frame(11, b"x" * 50) + frame(4, b"yy")
    two = frame(3, b"a") + frame(3, b"b", crc=5) + frame(3, b"c")
    rows = []
    for session, data in ((1, one), (2, two), (3, frame(3, b"zz")[:-1])):
        for n, at in enumerate(range(0, len(data), 13)):
            rows.append((session, n, bytearray(data[at : at + 13])))
    return rows


WANT = {(1, 1, 3, None), (1, 2, 11, None), (1, 3, 4, None), (2, 1, 3, None), (2, 2, None, "bad_crc")}


def test_frames_are_put_together(spark):
    chunks = spark.createDataFrame(chunk_rows(), "session long, seq long, data binary")
    got = sessions.frame_reassembly(chunks).collect()
    assert {(r.session, r.frame_no, r.type, r.reason) for r in got} == WANT


def streamed(spark, tmp_path, frame, name, parts=3):
    folder = tmp_path / name
    for part in range(parts):
        frame.where(F.col("seq") % parts == part if parts == 1 else F.expr(f"ntile_no = {part + 1}")).coalesce(1).write.mode(
            "append").parquet(str(folder))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def tiles(frame, parts=3):
    from pyspark.sql import Window

    return frame.withColumn("ntile_no", F.ntile(parts).over(Window.orderBy("seq")))


def test_frames_are_put_together_live(spark, tmp_path):
    chunks = tiles(spark.createDataFrame(chunk_rows(), "session long, seq long, data binary"))
    stream = streamed(spark, tmp_path, chunks, "chunks")
    got = live.run_available(live.frame_reassembly_stream(stream), str(tmp_path)).collect()
    assert {(r.session, r.frame_no, r.type, r.reason) for r in got} == WANT


def packets(spark):
    actions = ["start", "start", "stop", "stop", "start", "disconnect", "start", "stop"]
    rows = [(1, s, a) for s, a in enumerate(actions)] + [(2, 100, "stop"), (2, 101, "start")]
    frame = spark.createDataFrame(rows, "session long, seq long, action string")
    return frame.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("seq") * 3600 * 9))


def test_sessions(spark, tmp_path):
    at = lambda n: 1_700_000_000 + n * 3600 * 9
    rows = sessions.session_state(packets(spark)).select("session", F.unix_seconds("started").alias("a"), F.unix_seconds("ended").alias("b"))
    assert {tuple(r) for r in rows.collect()} == {(1, at(0), at(2)), (1, at(4), at(5)), (2, at(101), None)}
    stream = streamed(spark, tmp_path, tiles(packets(spark)), "packets")
    changes = live.run_available(live.session_state_stream(stream), str(tmp_path))
    assert {(r.session, r.change, r.s) for r in changes.withColumn("s", F.unix_seconds("ts")).collect()} == {
        (1, "started", at(0)), (1, "ended", at(2)), (1, "started", at(4)), (1, "ended", at(5)), (2, "started", at(101))}


def test_registry_live(spark, tmp_path):
    rows = [(n, f"h{n % 3}", bytearray(beacon(role=1 if n % 5 == 0 else 2, name=f"n{n % 3}".encode()))) for n in range(30)]
    frame = spark.createDataFrame(rows, "seq long, host string, payload binary").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    want = {(r.host, r.port, r.name) for r in sessions.peer_registry(frame).collect()}
    for delay in (None, "1 hour"):
        stream = streamed(spark, tmp_path, tiles(frame), f"beacons-{delay}".replace(" ", ""))
        got = live.run_available(live.peer_registry_stream(stream, delay), str(tmp_path)).collect()
        assert {(r.host, r.port, r.name) for r in got} == want and len(got) == len(want)


def test_windows_live(spark, tmp_path):
    frame = spark.range(50).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.lit(1).alias("session"),
        (F.col("id") % 2).cast("int").alias("type"), F.lit(10).alias("bytes"))
    stream = streamed(spark, tmp_path, tiles(frame), "traffic")
    got = live.run_available(live.traffic_stream(stream, "1 second", "1 minute"), str(tmp_path))
    batch = sessions.traffic_windows(frame, "1 minute")
    late = 49 * 20 - 1
    done = batch.where(F.unix_seconds("window_start") + 60 <= late)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in done.collect()}


def test_smoothing_matches_a_loop(spark):
    import random

    from docflow.operators import grids

    rng = random.Random(1)
    for width, height, radius in ((5, 4, 1.5), (3, 2, 4.0), (6, 1, 0.3)):
        mask = {(x, y): rng.randint(0, 255) for x in range(width) for y in range(height)}
        cells = spark.createDataFrame([(1, x, y, v) for (x, y), v in mask.items()], "g int, x int, y int, v int")
        weights = grids.kernel(radius)
        r = len(weights) // 2
        clamp = lambda n, top: max(0, min(n, top - 1))
        across = {(x, y): sum(mask[clamp(x + k, width), y] * weights[k + r] for k in range(-r, r + 1)) for x, y in mask}
        both = {(x, y): round(sum(across[x, clamp(y + k, height)] * weights[k + r] for k in range(-r, r + 1))) for x, y in mask}
        got = {(c.x, c.y): c.v for c in grids.gaussian_smooth(cells, ["g"], "v", width, height, radius).collect()}
        assert got == both
    assert grids.kernel(0.0) == []
