"""Queries over beacons, frames, sessions and binary files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docflow.functions import wire
from docflow.operators import sessions as ops
from docflow.plans.registry import query, table
from docflow.sources import files as files_io
from docflow.sources.placing import dealt, scratch, settle
from docflow.streaming import live as streams

HOST = "concat('10.0.', CAST(floor(user_id / 256) AS STRING), '.', CAST(user_id % 256 AS STRING))"
K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# ---- beacons --------------------------------------------------------------------------

BEACONS_SQL = """b AS (SELECT ts, event_id AS seq, concat('10.0.', user_id // 256, '.', user_id % 256) AS host,
  CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS role, 5000 + regexp_extract(props, '([0-9]+)', 1)::INTEGER % 3 AS port, 'pc-' || user_id AS name
  FROM events WHERE NOT (event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0))"""


def beacons(spark, sf):
    """Beacon packets of the events, one in five spoilt."""
    e = F.col("event_id")
    name = F.encode(F.concat(F.lit("pc-"), F.col("user_id").cast("string")), "UTF-8")
    role = F.when(e % 13 == 0, 7).when(F.col("event_type") == "error", 1).otherwise(2)
    port = F.when(e % 19 == 0, 0).otherwise(5000 + F.expr(K) % 3)
    whole = F.concat(
        F.when(e % 11 == 0, F.unhex(F.lit("594145"))).otherwise(F.unhex(F.lit(wire.BEACON_MAGIC))),
        F.when(e % 23 == 0, F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("01"))),
        wire.little_endian(role, 1), wire.little_endian(port, 2), wire.little_endian(F.length(name), 1), name,
    )
    cut = F.when(e % 17 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    packets = table(spark, sf, "events").select("ts", e.alias("seq"), F.expr(HOST).alias("host"), cut.alias("payload"))
    return packets


@query("beacon_valid", f"WITH {BEACONS_SQL} SELECT ts, seq, host, role, port, name FROM b")
def beacon_valid(spark, sf):
    return ops.valid_beacons(settle(beacons(spark, sf)))


REGISTRY_SQL = BEACONS_SQL + """,
r AS (SELECT host, port, arg_min(name, ts) AS name, min(ts) AS first_seen FROM b WHERE role = 2 GROUP BY ALL)"""


@query("peer_registry", f"WITH {REGISTRY_SQL} SELECT host, port, name, first_seen FROM r")
def peer_registry(spark, sf):
    folder = scratch(spark, "beacons")
    files_io.write_table(beacons(spark, sf), folder)
    packets = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    seen = streams.run_available(streams.peer_registry_stream(packets), scratch(spark, "registry"))
    return seen.select("host", "port", "name", F.col("ts").alias("first_seen"))


@query("registry_new", f"WITH {REGISTRY_SQL} SELECT * FROM r WHERE (host, port) NOT IN (SELECT concat('10.0.', c_custkey // 256, '.', c_custkey % 256), 5000 FROM customer)")
def registry_new(spark, sf):
    known = table(spark, sf, "customer").select(
        F.expr(HOST.replace("user_id", "c_custkey")).alias("host"), F.lit(5000).alias("port")
    )
    return ops.registry_new(settle(beacons(spark, sf)), known)


@query("host_presence", f"""
WITH {BEACONS_SQL}, g AS (SELECT host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM b),
s AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY ts) AS k FROM g)
SELECT host, min(ts) AS online_from, max(ts) AS last_seen, count(*) AS beacons FROM s GROUP BY host, k""")
def host_presence(spark, sf):
    return ops.host_presence(ops.valid_beacons(settle(beacons(spark, sf))), "6 hours")


@query("host_presence_live", f"""
WITH {BEACONS_SQL}, m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS passed FROM b),
g AS (SELECT host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM b),
s AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY ts) AS k FROM g),
p AS (SELECT host, min(ts) AS online_from, max(ts) AS last_seen, count(*) AS beacons FROM s GROUP BY host, k)
SELECT * FROM p WHERE last_seen + INTERVAL 6 HOUR <= (SELECT passed FROM m)""")
def host_presence_live(spark, sf):
    """Stays of hosts out of a stream of beacons that arrive shuffled by up to 50 minutes."""
    late = F.expr("make_interval(0, 0, 0, 0, 0, 0, CAST(crc32(CAST(seq AS STRING)) % 3000 AS DECIMAL(18, 6)))")
    packets = ops.valid_beacons(settle(beacons(spark, sf)))
    arriving = streams.stream_in_parts(packets, scratch(spark, "beacons"), F.col("ts") + late, "host")
    return streams.run_available(streams.presence_stream(arriving, "1 hour", "6 hours"), scratch(spark, "presence"))


# ---- frames ---------------------------------------------------------------------------

TYPE_CASE = "CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 11 WHEN 'error' THEN 250 WHEN 'signup' THEN 10 ELSE 21 END"


def frames(spark, sf):
    """One frame per event; some spoilt in one way each."""
    e = F.col("event_id")
    payload = F.encode("props", "UTF-8")
    good = wire.build_frame(F.expr(TYPE_CASE), payload)
    spoilt = (
        F.when(e % 301 == 0, F.concat(F.unhex(F.lit("5A")), F.substring(good, F.lit(2), F.length(good))))
        .when(e % 307 == 0, F.concat(F.substring(good, 1, 2), F.unhex(F.lit("09")), F.substring(good, F.lit(4), F.length(good))))
        .when(e % 311 == 0, F.concat(F.substring(good, 1, 6), F.unhex(F.lit("00000010")), F.substring(good, F.lit(11), F.length(good))))
        .when(e % 313 == 0, wire.build_frame(F.expr(TYPE_CASE), payload, F.crc32(payload).bitwiseXOR(F.lit(1))))
        .otherwise(good)
    )
    packets = table(spark, sf, "events").select(F.col("user_id").alias("session"), e.alias("seq"), "ts", spoilt.alias("data"))
    return settle(packets)


REASON_SQL = (
    "CASE WHEN event_id % 301 = 0 THEN 'bad_magic' WHEN event_id % 307 = 0 THEN 'bad_version' "
    "WHEN event_id % 311 = 0 THEN 'too_long' {0} WHEN event_id % 313 = 0 THEN 'bad_crc' {1} END"
)


@query("frame_integrity", f"""
WITH f AS (SELECT user_id AS session, {REASON_SQL.format("WHEN event_id % 29 = 0 THEN 'incomplete'", "ELSE 'ok'")} AS reason,
  14 + length(props) - CASE WHEN event_id % 29 = 0 THEN 3 ELSE 0 END AS n FROM events)
SELECT session, reason, count(*) AS frames, sum(n)::BIGINT AS bytes FROM f GROUP BY ALL""")
def frame_integrity(spark, sf):
    cut = F.when(F.col("seq") % 29 == 0, F.substring("data", F.lit(1), F.length("data") - 3)).otherwise(F.col("data"))
    return ops.frame_integrity(frames(spark, sf).withColumn("data", cut), ["session"])


def chunks(spark, sf):
    """Each frame's bytes in two chunks cut at an odd place."""
    at = (F.col("seq") % 19 + 1).cast("int")
    two = F.array(F.substring("data", F.lit(1), at), F.substring("data", at + 1, F.length("data")))
    return frames(spark, sf).select("session", "ts", F.col("seq").alias("frame"), F.posexplode(two).alias("i", "data")).select(
        "session", "ts", (F.col("frame") * 2 + F.col("i")).alias("seq"), "data"
    )


@query("frame_reassembly", f"""
WITH f AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame_no, {TYPE_CASE} AS type, props AS payload,
  {REASON_SQL.format('', '')} AS reason, min(CASE WHEN event_id % 301 = 0 OR event_id % 307 = 0 OR event_id % 311 = 0 OR event_id % 313 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS bad, event_id FROM events)
SELECT session, frame_no, CASE WHEN reason IS NULL THEN type END AS type, CASE WHEN reason IS NULL THEN payload END AS payload, reason
FROM f WHERE bad IS NULL OR event_id <= bad""")
def frame_reassembly(spark, sf):
    whole = ops.frame_reassembly(chunks(spark, sf))
    return whole.withColumn("payload", wire.utf8(F.col("payload")))


STALL, FRAME_DELAY = "1 day", "10 minutes"


def broken_connections(spark, sf):
    """The chunks of ``chunks``; where a session falls silent for a day, half of the frames
    before the silence lack their second chunk."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = F.lead("ts").over(by_time)
    silent = after.isNull() | (after > F.col("ts") + F.expr(f"INTERVAL {STALL}"))
    cut = table(spark, sf, "events").select("event_id", (silent & (F.col("event_id") % 2 == 0)).alias("cut")).where("cut")
    lost = cut.select((F.col("event_id") * 2 + 1).alias("seq"))
    return chunks(spark, sf).join(lost, "seq", "left_anti").select("session", "ts", "seq", "data")


@query("frame_connections_live", f"""
WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {FRAME_DELAY} AS passed FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL {STALL} THEN 1 ELSE 0 END AS new, coalesce(lead(ts) OVER w > ts + INTERVAL {STALL}, true) AS silent,
  lead(ts) OVER w IS NOT NULL OR ts + INTERVAL {STALL} <= (SELECT passed FROM m) AS known FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
f AS (SELECT user_id AS session, k, min(ts) OVER c AS opened, row_number() OVER (c ORDER BY ts, event_id) AS frame_no, {TYPE_CASE} AS type, props AS payload, known,
  silent AND event_id % 2 = 0 AS cut, CASE WHEN silent AND event_id % 2 = 0 AND (event_id % 19 + 1 < 14 OR event_id % 313 = 0 AND event_id % 301 <> 0 AND event_id % 307 <> 0 AND event_id % 311 <> 0) THEN 'incomplete' ELSE {REASON_SQL.format('', '')} END AS bad
  FROM n WINDOW c AS (PARTITION BY user_id, k)),
r AS (SELECT *, CASE WHEN bad IS NULL AND cut THEN 'incomplete' ELSE bad END AS reason FROM f),
e AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN frame_no END) OVER (PARTITION BY session, k) AS ends FROM r)
SELECT session, opened, frame_no, CASE WHEN reason IS NULL THEN type END AS type, CASE WHEN reason IS NULL THEN payload END AS payload, reason
FROM e WHERE (ends IS NULL OR frame_no <= ends) AND (reason IS NULL OR reason <> 'incomplete' OR known)""")
def frame_connections_live(spark, sf):
    """Frames out of a stream whose batches cut frames in two, with connections that stall."""
    arriving = streams.stream_in_parts(broken_connections(spark, sf), scratch(spark, "chunks"), F.col("ts"), "session")
    frames = streams.run_available(streams.frame_connections_stream(arriving, STALL, FRAME_DELAY), scratch(spark, "frames"))
    return frames.withColumn("payload", wire.utf8(F.col("payload")))


@query("traffic_windows", f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id AS session, {TYPE_CASE} AS type, count(*) AS n, sum(length(props))::BIGINT AS bytes FROM events GROUP BY ALL""")
def traffic_windows(spark, sf):
    return ops.traffic_windows(traffic(spark, sf), "1 hour")


def traffic(spark, sf):
    return table(spark, sf, "events").select(
        "ts", F.col("user_id").alias("session"), F.expr(TYPE_CASE).alias("type"), F.length("props").alias("bytes")
    )


@query("traffic_sliding", f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS window_start, user_id AS session, {TYPE_CASE} AS type, count(*) AS n, sum(length(props))::BIGINT AS bytes
FROM events, range(6) r(k) GROUP BY ALL""")
def traffic_sliding(spark, sf):
    return ops.traffic_windows(traffic(spark, sf), "6 hours", "1 hour")


@query("traffic_sessions", f"""
WITH e AS (SELECT ts, event_id, user_id AS session, {TYPE_CASE} AS type, length(props) AS bytes FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY session, type ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY session, type ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS started, max(ts) AS ended, session, type, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM s GROUP BY session, type, k""")
def traffic_sessions(spark, sf):
    return ops.traffic_sessions(traffic(spark, sf), "6 hours")


@query("traffic_live", f"""
WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS passed FROM events),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS window_start, user_id AS session, {TYPE_CASE} AS type, count(*) AS n, sum(length(props))::BIGINT AS bytes
FROM events, range(3) r(k) GROUP BY ALL)
SELECT * FROM w WHERE window_start + INTERVAL 3 HOUR <= (SELECT passed FROM m)""")
def traffic_live(spark, sf):
    """Sliding windows out of a stream, each once it is over."""
    arriving = streams.stream_in_parts(traffic(spark, sf), scratch(spark, "traffic"), F.col("ts"), "session")
    return streams.run_available(streams.traffic_stream(arriving, "1 hour", "3 hours", "1 hour"), scratch(spark, "windows"))


@query("refuse_once", """
SELECT user_id AS session, arg_min(props, (ts, event_id)) AS reason, min(ts) AS refused_at FROM events WHERE event_type = 'error' GROUP BY user_id""")
def refuse_once(spark, sf):
    refused = table(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "user_id AS session", "ts", "event_id AS seq", "props AS reason"
    )
    return ops.refuse_once(refused)


ACTION_CASE = "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'error' THEN 'stop' WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'disconnect' END"


@query("session_state", f"""
WITH p AS (SELECT user_id AS session, ts, event_id AS seq, {ACTION_CASE} AS action FROM events WHERE {ACTION_CASE} IS NOT NULL),
q AS (SELECT *, min(CASE WHEN action = 'disconnect' THEN seq END) OVER (PARTITION BY session) AS closed FROM p),
l AS (SELECT *, lag(action) OVER (PARTITION BY session ORDER BY ts, seq) AS was FROM q WHERE closed IS NULL OR seq <= closed),
c AS (SELECT *, lead(ts) OVER (PARTITION BY session ORDER BY ts, seq) AS ended FROM l WHERE (action = 'start') <> coalesce(was = 'start', false))
SELECT session, ts AS started, ended FROM c WHERE action = 'start'""")
def session_state(spark, sf):
    packets = table(spark, sf, "events").selectExpr("user_id AS session", "ts", "event_id AS seq", f"{ACTION_CASE} AS action")
    return ops.session_state(packets.where("action IS NOT NULL"))


IDLE, PACKET_DELAY = "1 day", "2 hours"


@query("session_state_live", f"""
WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {PACKET_DELAY} AS passed FROM events),
a AS (SELECT user_id AS session, ts, event_id AS seq, coalesce({ACTION_CASE}, 'ping') AS action FROM events WHERE ts <= (SELECT passed FROM m)),
g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY session ORDER BY ts, seq) + INTERVAL {IDLE} THEN 1 ELSE 0 END AS new FROM a),
n AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, seq) AS k FROM g),
p AS (SELECT *, max(ts) OVER (PARTITION BY session, k) + INTERVAL {IDLE} AS silence, min(CASE WHEN action = 'disconnect' THEN (ts, seq) END) OVER (PARTITION BY session, k) AS closed FROM n),
l AS (SELECT *, lag(action) OVER (PARTITION BY session, k ORDER BY ts, seq) AS was FROM p WHERE action <> 'ping' AND (closed IS NULL OR (ts, seq) <= closed)),
c AS (SELECT *, lead(ts) OVER (PARTITION BY session, k ORDER BY ts, seq) AS next FROM l WHERE (action = 'start') <> coalesce(was = 'start', false))
SELECT session, ts AS started, coalesce(next, silence) AS ended FROM c WHERE action = 'start' AND (next IS NOT NULL OR silence <= (SELECT passed FROM m))""")
def session_state_live(spark, sf):
    """Intervals out of a stream of packets that arrive shuffled by up to the delay."""
    late = F.expr("make_interval(0, 0, 0, 0, 0, 0, CAST(crc32(CAST(seq AS STRING)) % 7000 AS DECIMAL(18, 6)))")
    packets = table(spark, sf, "events").selectExpr("user_id AS session", "ts", "event_id AS seq", f"coalesce({ACTION_CASE}, 'ping') AS action")
    arriving = streams.stream_in_parts(packets, scratch(spark, "packets"), F.col("ts") + late, "session")
    return streams.run_available(streams.session_intervals_stream(arriving, IDLE, PACKET_DELAY), scratch(spark, "intervals"))


@query("active_duration", """
WITH s AS (SELECT user_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events WHERE event_type IN ('signup', 'error'))
SELECT user_id, count(*) AS changes, coalesce(sum(epoch_us(nx) - epoch_us(ts)) FILTER (WHERE event_type = 'signup'), 0)::DOUBLE / 1000000 AS active_seconds FROM s GROUP BY user_id""")
def active_duration(spark, sf):
    states = table(spark, sf, "events").where("event_type IN ('signup', 'error')").selectExpr(
        "user_id", "ts", "event_id AS seq", "CASE WHEN event_type = 'signup' THEN 'recording' ELSE 'paused' END AS state"
    )
    return ops.active_duration(states, ["user_id"])


def inputs(spark, sf):
    """Input packets of the events: kind by id, one in nine cut short, one in ten of no kind."""
    e = F.col("event_id")
    flag = lambda on: F.when(on, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    # 0.5 and 2.0 as IEEE singles, lowest byte first.
    half, two = F.unhex(F.lit("0000003F")), F.unhex(F.lit("00000040"))
    wheel = F.when(e % 4 == 0, F.unhex(F.lit("88FFFFFF"))).otherwise(F.unhex(F.lit("78000000")))
    packet = F.concat(
        wire.little_endian(F.when(e % 10 == 0, 9).otherwise(e % 4 + 1), 1), wire.little_endian(F.lit(1), 1), flag(e % 3 == 0),
        F.unhex(F.lit("00")), half, F.when(e % 5 == 0, two).otherwise(half), wheel, wire.little_endian(e % 200, 2),
    )
    data = F.when(e % 9 == 0, F.substring(packet, 1, 17)).otherwise(packet)
    return settle(table(spark, sf, "events").select(F.col("user_id").alias("session"), "ts", data.alias("payload")))


@query("input_activity", """
WITH i AS (SELECT user_id AS session, ts, event_id AS e, ['MouseMove', 'MouseButton', 'MouseWheel', 'Key'][event_id % 4 + 1] AS kind FROM events WHERE event_id % 9 <> 0 AND event_id % 10 <> 0)
SELECT session, kind, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE kind IN ('MouseButton', 'Key') AND e % 3 = 0) AS pressed,
  sum(CASE WHEN kind = 'MouseWheel' THEN CASE WHEN e % 4 = 0 THEN -120 ELSE 120 END END)::BIGINT AS wheel,
  count(*) FILTER (WHERE kind IN ('MouseMove', 'MouseButton') AND e % 5 <> 0) AS on_screen FROM i GROUP BY ALL""")
def input_activity(spark, sf):
    return ops.input_activity(inputs(spark, sf), ["session"], "1 hour")


@query("packet_activity", """
WITH p AS (SELECT user_id AS session, ts, event_id AS e, length(props) AS n, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'Broken' ELSE 'ScreenFrame' END
  WHEN 1 THEN CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'Broken' WHEN event_id % 2 = 0 THEN 'ShowMessage' ELSE 'LockScreen' END END AS kind FROM events)
SELECT session, kind, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, sum(CASE WHEN kind = 'ScreenFrame' THEN n END)::BIGINT AS image_bytes,
  sum(CASE WHEN kind = 'ScreenFrame' THEN (e % 16384 + 1) * 720 END)::BIGINT AS pixels, sum(CASE WHEN kind = 'ShowMessage' THEN n END)::BIGINT AS message_chars FROM p WHERE kind IS NOT NULL GROUP BY ALL""")
def packet_activity(spark, sf):
    """Screen frames and commands of the events: one in three each; of both, one in five has a
    wrong size and one in seven a wrong length or kind."""
    e, image = F.col("event_id"), F.encode("props", "UTF-8")
    number = lambda value, size: wire.little_endian(value, size)
    width = F.when(e % 5 == 0, 0).when(e % 7 == 0, 20000).otherwise(e % 16384 + 1)
    screen = F.concat(number(width, 4), number(F.lit(720), 4), number(F.lit(1), 1), image)
    kind = F.when(e % 5 == 0, 9).when(e % 2 == 0, 1).otherwise(2)
    command = F.concat(number(kind, 1), number(F.lit(0), 1), number(F.length(image) + F.when(e % 7 == 0, 1).otherwise(0), 2), image)
    payload = F.when(e % 3 == 0, screen).when(e % 3 == 1, command).otherwise(image)
    kinds = F.when(e % 3 == 0, 11).when(e % 3 == 1, 21).otherwise(20)
    packets = table(spark, sf, "events").select(F.col("user_id").alias("session"), "ts", kinds.alias("type"), payload.alias("payload"))
    return ops.packet_activity(settle(packets), ["session"], "1 hour")


# ---- files ----------------------------------------------------------------------------

@query("decode_text_files", """
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 5 = 4 THEN 'not_utf8' END AS error FROM documents""")
def decode_text_files(spark, sf):
    k = F.col("doc_id") % 5
    coded = lambda mark, name: F.concat(F.unhex(F.lit(mark)), F.encode("text", name))
    content = (
        F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, coded("EFBBBF", "UTF-8"))
        .when(k == 2, coded("FFFE", "UTF-16LE")).when(k == 3, coded("FEFF", "UTF-16BE"))
        .otherwise(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("EC20"))))
    )
    docs = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return files_io.decode_text(docs).select("doc_id", "text", "error")


@query("text_files", """
SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN text || chr(10) END AS text, CASE doc_id % 6 WHEN 4 THEN 'not_utf8' WHEN 5 THEN 'not_utf16' END AS error, doc_id % 6 >= 4 AS rejected FROM documents""")
def text_files(spark, sf):
    """Documents written as files of four encodings and two broken ones, one document a file,
    read from their folder, and written as accepted and rejected ones in one pass."""
    folder, split = scratch(spark, "texts"), scratch(spark, "decoded")
    kind = F.col("doc_id") % 6
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    marked = lambda mark, *rest: F.concat(F.unhex(F.lit(mark)), *rest)
    content = (
        F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, marked("EFBBBF", F.encode(text, "UTF-8")))
        .when(kind == 2, marked("FFFE", F.encode(text, "UTF-16LE"))).when(kind == 3, marked("FEFF", F.encode(text, "UTF-16BE")))
        .when(kind == 4, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("EC20"))))
        .otherwise(marked("FFFE", F.encode(text, "UTF-16LE"), F.unhex(F.lit("00D80A00"))))
    )
    docs = table(spark, sf, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), content.alias("content"))
    files_io.write_files(docs, folder, "name", "content")
    files = files_io.read_files(spark, folder, "*.txt").withColumn("doc_id", F.regexp_extract("path", r"/(-?[0-9]+)\.txt$", 1).cast("bigint"))
    files_io.write_split(files_io.decode_text(files).select("doc_id", "text", "error"), split)
    return spark.read.parquet(split).select("doc_id", "text", "error", (F.col("rejected") == "true").alias("rejected"))


@query("folder_files", """
WITH f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'DOC_' ELSE 'doc_' END || s_suppkey // 2 || CASE WHEN s_suppkey // 2 % 7 = 0 THEN '.pdf' WHEN s_suppkey % 3 = 0 THEN '.TXT' ELSE '.txt' END AS folder, s_name FROM supplier),
g AS (SELECT folder, sum(octet_length(encode(s_name)) + 1)::BIGINT AS length FROM f GROUP BY folder)
SELECT min(folder) AS folder, arg_min(length, folder) AS length FROM g WHERE lower(folder) LIKE '%.txt' GROUP BY lower(folder)""")
def folder_files(spark, sf):
    """Files written under names that differ in case only, listed from their folder."""
    root = scratch(spark, "dropped")
    spelling = "CASE WHEN s_suppkey % 3 = 0 THEN '{0}' ELSE '{1}' END"
    name = f"concat({spelling.format('DOC_', 'doc_')}, CAST(floor(s_suppkey / 2) AS STRING), CASE WHEN floor(s_suppkey / 2) % 7 = 0 THEN '.pdf' ELSE {spelling.format('.TXT', '.txt')} END)"
    rows = table(spark, sf, "supplier").selectExpr(f"{name} AS name", "encode(concat(s_name, '\\n'), 'UTF-8') AS content")
    files_io.write_files(rows, root, "name", "content")
    return files_io.list_files(spark, root, [".txt"]).select(F.col("name").alias("folder"), "length")


def zipped_pages(spark, sf):
    """Every page as a small archive: a folder, the page under a backslash path, its address."""

    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for frame in batches:
            out = []
            for page, url, html in zip(frame["page_id"].tolist(), frame["url"].tolist(), frame["html"].tolist()):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("docs/", b"")
                    z.writestr(f"docs\\page{page}.html", html.encode())
                    z.writestr("url.txt", url.encode())
                out.append((f"{page}.zip", data.getvalue() if page % 20 else b"junk"))
            yield pd.DataFrame(out, columns=["path", "content"])

    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return dealt(pages, 500, "page_id").mapInPandas(pack, "path string, content binary")


@query("archive_entries", """
WITH p AS (SELECT *, page_id || '.zip' AS archive_id FROM pages)
SELECT archive_id, 0::BIGINT AS entry_no, 'docs/' AS path, 0::BIGINT AS size, true AS is_directory, false AS is_encrypted, NULL AS error FROM p WHERE page_id % 20 <> 0
UNION ALL SELECT archive_id, 1, 'docs/page' || page_id || '.html', octet_length(encode(html)), false, false, NULL FROM p WHERE page_id % 20 <> 0
UNION ALL SELECT archive_id, 2, 'url.txt', octet_length(encode(url)), false, false, NULL FROM p WHERE page_id % 20 <> 0
UNION ALL SELECT archive_id, NULL, NULL, NULL, NULL, NULL, 'ValueError' FROM p WHERE page_id % 20 = 0""")
def archive_entries(spark, sf):
    return files_io.list_archives(zipped_pages(spark, sf)).drop("compressed_size", "modified")


@query("sink_atomic", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def sink_atomic(spark, sf):
    target = scratch(spark, "orders")
    files_io.write_table(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), target)
    return spark.read.parquet(target)
