"""The live forms of the registries and sessions, on Structured Streaming.

The surveyed behaviour never forgets; a watermark bounds the state where a query can do with
what arrived lately. Both forms are offered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docflow.operators import sessions


def peer_registry_stream(beacons: DataFrame, delay: str | None = None) -> DataFrame:
    """Agents as they are first seen. Without a delay every host is remembered for good, and of
    what arrives together the earliest sighting counts."""
    found = sessions.agents(beacons).select("ts", "host", "port", "name")

    def first(key, frames, state):
        import pandas as pd

        sightings = pd.concat(list(frames))
        if not state.exists:
            state.update((True,))
            yield sightings.sort_values("ts", kind="stable").head(1)

    if delay is None:
        return found.groupBy("host", "port").applyInPandasWithState(first, found.schema, "seen boolean", "append", "NoTimeout")
    return found.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["host", "port"])


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with a watermark on ``ts`` and the same time ``at`` in microseconds."""
    exact = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return exact.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))


def _time(micros: str, like: DataFrame) -> Column:
    """Microseconds as a time of the type that ``ts`` has."""
    return F.timestamp_micros(micros).cast(like.schema["ts"].dataType)


def refuse_once_stream(refusals: DataFrame, delay: str) -> DataFrame:
    """The first refusal of a session to arrive; more of them within ``delay`` behind it, and what is
    older than the watermark when it comes, are left out."""
    kept = _timed(refusals, delay).dropDuplicatesWithinWatermark(["session"])
    return kept.withColumn("ts", F.col("ts").cast(refusals.schema["ts"].dataType)).drop("at")


def traffic_stream(frames: DataFrame, delay: str, length: str, slide: str | None = None, keys: tuple[str, ...] = ("session", "type")) -> DataFrame:
    """``window_start, keys, n, bytes`` of windows that the watermark has passed."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _timed(frames, delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(
        F.col("w.start").cast(frames.schema["ts"].dataType).alias("window_start"), *keys, "n", "bytes"
    )


def presence_stream(beacons: DataFrame, delay: str, gap: str) -> DataFrame:
    """The rows of ``sessions.host_presence`` once the watermark has passed a gap without a
    beacon; beacons that come later than ``delay`` are left out."""
    kind = beacons.schema["ts"].dataType
    return _timed(beacons, delay).groupBy("host", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("beacons"), F.max("ts").alias("last_seen")
    ).select("host", F.col("w.start").cast(kind).alias("online_from"), F.col("last_seen").cast(kind).alias("last_seen"), "beacons")


def frame_reassembly_stream(chunks: DataFrame) -> DataFrame:
    """Frames as their last byte arrives; the unfinished rest of a session is its state."""

    def step(key, frames, state):
        import pandas as pd

        rest, broken, number = state.get if state.exists else (b"", False, 0)
        buffer = sessions.FrameBuffer(bytes(rest), broken)
        rows = []
        for _, data in sorted((s, d) for f in frames for s, d in zip(f["seq"].tolist(), f["data"].tolist())):
            for kind, payload, reason in buffer.feed(data):
                number += 1
                rows.append((key[0], number, kind, payload, reason))
        state.update((bytes(buffer.rest), buffer.broken, number))
        out = pd.DataFrame(rows, columns=["session", "frame_no", "type", "payload", "reason"])
        out["type"] = out["type"].astype("Int32")
        yield out

    return chunks.groupBy("session").applyInPandasWithState(
        step, sessions.FRAME_SCHEMA, "rest binary, broken boolean, number long", "append", "NoTimeout"
    )


def session_state_stream(packets: DataFrame) -> DataFrame:
    """Starts and stops that change something, as they happen."""

    def step(key, frames, state):
        import pandas as pd

        on, closed = state.get if state.exists else (False, False)
        rows = []
        events = sorted(
            (t, s, a) for f in frames for t, s, a in zip(f["ts"].tolist(), f["seq"].tolist(), f["action"].tolist())
        )
        for ts, _, action in events:
            if closed:
                break
            if action == "start" and not on:
                on = True
                rows.append((key[0], "started", ts))
            elif action != "start" and on:
                on = False
                rows.append((key[0], "ended", ts))
            closed = action == "disconnect"
        state.update((on, closed))
        yield pd.DataFrame(rows, columns=["session", "change", "ts"])

    return packets.groupBy("session").applyInPandasWithState(
        step, "session long, change string, ts timestamp", "running boolean, closed boolean", "append", "NoTimeout"
    )


# ---- connections that can end by silence ----------------------------------------------------

CONNECTION_FRAMES = "session long, opened long, frame_no long, type int, payload binary, reason string"
CONNECTION_INTERVALS = "session long, started long, ended long"


def _micros(interval: str) -> int:
    """An interval such as ``6 hours`` in microseconds."""
    import pandas as pd

    return pd.Timedelta(interval) // pd.Timedelta(microseconds=1)


class _Frames(StatefulProcessor):
    """Frames of one session. Its state is the connection that is open: bytes that make no
    whole frame yet, frames so far, and the last chunk. A timer closes it."""

    def __init__(self, stall: int):
        self.stall = stall

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("connection", "rest binary, broken boolean, number long, opened long, last long, seq long")

    def _ended(self, session, state):
        """The row of a connection that ends within a frame."""
        rest, broken, number, opened, *_ = state
        return [(session, opened, number + 1, None, None, "incomplete")] if len(rest) and not broken else []

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        state, out, session = self.state.get() if self.state.exists() else None, [], key[0]
        buffer = None
        arrived = sorted((a, s, d) for f in rows for a, s, d in zip(f["at"].tolist(), f["seq"].tolist(), f["data"].tolist()))
        for at, seq, data in arrived:
            if state and at - state[4] > self.stall:
                out += self._ended(session, (bytes(buffer.rest), buffer.broken, *state[2:]) if buffer else state)
                state = buffer = None
            if state and (at, seq) <= (state[4], state[5]):
                continue  # delivered again
            if state is None:
                state = (b"", False, 0, at, at, seq)
            if buffer is None:
                buffer = sessions.FrameBuffer(bytes(state[0]), state[1])
            number = state[2]
            for kind, payload, reason in buffer.feed(data):
                number += 1
                out.append((session, state[3], number, kind, payload, reason))
            state = (b"", False, number, state[3], at, seq)
        if buffer is not None:
            self.state.update((bytes(buffer.rest), buffer.broken, *state[2:]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((state[4] + self.stall) // 1000 + 1)
        yield _frame(out, CONNECTION_FRAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = self._ended(key[0], self.state.get()) if self.state.exists() else []
        self.state.clear()
        yield _frame(out, CONNECTION_FRAMES)

    def close(self) -> None:
        pass


class _Intervals(StatefulProcessor):
    """Streaming intervals of one session. Packets wait until the watermark has passed them,
    so they are read in the order of their time however they arrive; a timer wakes the
    session for the next packet that waits, or ends it after silence."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, action string")
        self.state = handle.getValueState("connection", "running boolean, closed boolean, started long, last long")

    def _wake(self, at: int) -> None:
        if at not in list(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        new = [x for f in rows for x in zip(f["at"].tolist(), f["seq"].tolist(), f["action"].tolist())]
        if new:
            self.waiting.appendList(new)
            self._wake(-(-min(new)[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [x for x in waiting if x[0] <= passed], [x for x in waiting if x[0] > passed]
        state, out = self.state.get() if self.state.exists() else None, []
        for at, _, action in ready:
            state = self._silent(key[0], state, at - 1, out)
            on, closed, started, _ = state or (False, False, 0, at)
            if not closed and action == "start" and not on:
                on, started = True, at
            elif not closed and action in ("stop", "disconnect") and on:
                on = False
                out.append((key[0], started, at))
            state = on, closed or action == "disconnect", started, at
        state = self._silent(key[0], state, passed, out)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self._wake(-(-(state[3] + self.idle) // 1000))
        if later:
            self.waiting.put(later)
            self._wake(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        yield _frame(out, CONNECTION_INTERVALS)

    def _silent(self, session, state, now: int, out: list):
        """The state at a time, which is none if the connection has been silent for too long."""
        if state is None or state[3] + self.idle > now:
            return state
        if state[0]:
            out.append((session, state[2], state[3] + self.idle))
        return None

    def close(self) -> None:
        pass


def _frame(rows: list, schema: str):
    import pandas as pd

    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])
    return out.astype({"type": "Int32"}) if "type" in out else out


def frame_connections_stream(chunks: DataFrame, stall: str, delay: str) -> DataFrame:
    """``session, opened, frame_no, type, payload, reason``: frames of each connection as their
    last byte arrives.

    ``chunks (session, ts, seq, data)`` arrive in the order of (ts, seq) per session, some
    perhaps more than once. A bad frame ends what can be read of its connection. Silence of
    more than ``stall`` ends the connection: by the next chunk, which opens another one, or by
    a timer once the watermark has passed. What was unfinished is reported as ``incomplete``
    and the state goes, so no session is remembered for longer than that. Needs the RocksDB
    state store (``run_available`` sets it).
    """
    found = _timed(chunks, delay).select("session", "ts", "at", "seq", "data")
    frames = found.groupBy("session").transformWithStateInPandas(_Frames(_micros(stall)), CONNECTION_FRAMES, "Append", "EventTime")
    return frames.withColumn("opened", _time("opened", chunks))


def session_intervals_stream(packets: DataFrame, idle: str, delay: str) -> DataFrame:
    """``session, started, ended``: the rows of ``sessions.session_state`` with the same
    ``idle``, as they become certain: packets may arrive up to ``delay`` late and in any order.
    An interval that is still open is not known yet. State goes after ``idle`` without a packet.
    """
    found = _timed(packets, delay).select("session", "ts", "at", "seq", "action")
    ended = found.groupBy("session").transformWithStateInPandas(_Intervals(_micros(idle)), CONNECTION_INTERVALS, "Append", "EventTime")
    return ended.select("session", _time("started", packets).alias("started"), _time("ended", packets).alias("ended"))


# ---- files in, files out ---------------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_in_parts(rows: DataFrame, folder: str, order: Column, key: str, parts: int = 3, files: int | None = None) -> DataFrame:
    """A stream of ``rows`` that takes them in over ``parts`` batches, by equal stretches of
    ``order`` (a time). In one batch the rows of a key lie in one file, so a key's rows
    arrive in the order of the batches."""
    spark = rows.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__at", F.unix_micros(order.cast("timestamp")))
    low, high = placed.agg(F.min("__at"), F.max("__at")).first()
    part = F.least(F.floor((F.col("__at") - F.lit(low)) * parts / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(parts - 1))
    for k in range(parts):
        placed.where(part == k).drop("__at").repartition(files, key).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Take in everything there is now, write it as a table and read that table."""
    name = uuid.uuid4().hex
    target = f"{folder.rstrip('/')}/stream-{name}"
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKS)  # state on disk, with timers
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder.rstrip('/')}/progress-{name}")
            .trigger(availableNow=True)
            .format("parquet")
            .start(target)
        )
    finally:
        conf.set(key, before) if before else conf.unset(key)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
