"""Peers, sessions and traffic over tables of events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import wire
from docflow.operators.ordered import running

def _parsed(value: Column) -> Column:
    """Rows whose value is there, and no others. As a generator it parses once, where a
    filter would parse again."""
    return F.explode(F.array_compact(F.array(value)))


def valid_beacons(beacons: DataFrame) -> DataFrame:
    """Beacons that parse; everything else on the port is dropped without a word."""
    return beacons.select(
        *(c for c in beacons.columns if c != "payload"), _parsed(wire.parse_beacon(F.col("payload"))).alias("b")
    ).select(*(c for c in beacons.columns if c != "payload"), "b.role", "b.port", "b.name")


def agents(beacons: DataFrame) -> DataFrame:
    return valid_beacons(beacons).where(F.col("role") == wire.ROLE_AGENT)


def peer_registry(beacons: DataFrame) -> DataFrame:
    """First sighting of each agent by host and port."""
    return agents(beacons).groupBy("host", "port").agg(
        F.min_by("name", F.struct("ts", "seq")).alias("name"), F.min("ts").alias("first_seen")
    )


def registry_new(beacons: DataFrame, known: DataFrame) -> DataFrame:
    """Agents that the registry does not list yet."""
    return peer_registry(beacons).join(known.select("host", "port").distinct(), ["host", "port"], "left_anti")


def gap_sessions(events: DataFrame, keys: Sequence[str], gap: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``keys, start, last, n`` and sums of the stretches of a key whose events are closer than
    ``gap``. Of times that are null nothing is known; such events are left out.

    Events of one block of the length of a gap belong together whatever they are, so a first
    aggregate, which combines before it shuffles, leaves one row per key and block that has
    events. Only those rows are put in order per key: a key with a third of all events is
    spread over its blocks until it is small."""
    sums = sums or {}
    step = F.expr(f"INTERVAL {gap}")
    length = F.unix_micros(F.timestamp_seconds(F.lit(0)) + step)
    timed = events.where(F.col("ts").isNotNull()).withColumn("__block", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / length))
    blocks = timed.groupBy(*keys, "__block").agg(
        F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items())
    )
    before = running(blocks, keys, ["__block"], lags={"__before": F.col("last")})
    new = F.when(F.col("__before").isNull() | (F.col("start") >= F.col("__before") + step), 1).otherwise(0)
    numbered = running(before.withColumn("__new", new), keys, ["__block"], sums={"__session": F.col("__new")})
    return numbered.groupBy(*keys, "__session").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums)
    ).drop("__session")


def host_presence(beacons: DataFrame, gap: str) -> DataFrame:
    """When each host was online: beacons closer than the gap belong together."""
    return gap_sessions(beacons, ["host"], gap).select("host", F.col("start").alias("online_from"), F.col("last").alias("last_seen"), F.col("n").alias("beacons"))


def traffic_windows(frames: DataFrame, length: str, slide: str | None = None, keys: Sequence[str] = ("session", "type")) -> DataFrame:
    """Frames and bytes per window, tumbling or sliding.

    Sliding windows are sums of panes, one per step of ``slide``: each event is aggregated
    once, and what is copied into all windows it lies in is a pane, not the event. ``length``
    is a multiple of ``slide``."""
    step = slide or length
    panes = frames.groupBy(F.window("ts", step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(
        F.col("w.start").alias("window_start"), *keys, "n", "bytes"
    )
    if slide is None or slide == length:
        return panes
    import pandas as pd

    copies, rest = divmod(pd.Timedelta(length), pd.Timedelta(slide))
    if rest:
        raise ValueError(f"{length} is no multiple of {slide}")
    starts = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.col("window_start") - k * F.expr(f"INTERVAL {slide}"))
    return panes.withColumn("window_start", F.explode(starts)).groupBy("window_start", *keys).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def traffic_sessions(frames: DataFrame, gap: str, keys: Sequence[str] = ("session", "type")) -> DataFrame:
    """Frames and bytes of stretches of traffic: frames closer than ``gap`` belong together."""
    return gap_sessions(frames, keys, gap, {"bytes": F.col("bytes")}).select(F.col("start").alias("started"), F.col("last").alias("ended"), *keys, "n", "bytes")


def refuse_once(refusals: DataFrame) -> DataFrame:
    """The first refusal of each session, whatever its reason."""
    first = F.min_by(F.struct("reason", "ts"), F.struct("ts", "seq"))
    return refusals.groupBy("session").agg(first.alias("f")).select("session", "f.reason", F.col("f.ts").alias("refused_at"))


def session_state(packets: DataFrame, idle: str | None = None) -> DataFrame:
    """Streaming intervals per session. A start while running and a stop while idle do
    nothing; a disconnect ends the session and all that follows is void. With ``idle``, silence
    of that length ends a connection: an interval that is open ends then, and the next packet,
    of whatever action, opens another connection of the session."""
    keys = ["session"]
    if idle is not None:
        length = F.expr(f"INTERVAL {idle}")
        silent = running(packets, ["session"], ["ts", "seq"], lags={"__last": F.col("ts")})
        new = F.when(F.col("ts") >= F.col("__last") + length, 1).otherwise(0)
        keys.append("__connection")
        packets = running(silent.withColumn("__new", new), ["session"], ["ts", "seq"], sums={"__connection": F.col("__new")}).drop("__last", "__new")
        ends = packets.groupBy(*keys).agg((F.max("ts") + length).alias("__silence"))
    closed = packets.where("action = 'disconnect'").groupBy(*keys).agg(
        F.min(F.struct("ts", "seq")).alias("__end")
    )
    live = packets.where("action IN ('start', 'stop', 'disconnect')").join(closed, keys, "left").where(
        F.col("__end").isNull() | (F.struct("ts", "seq") <= F.col("__end"))
    ).drop("__end")
    before = running(live, keys, ["ts", "seq"], lags={"__was": F.col("action") == "start"})
    on = F.col("action") == "start"
    changes = before.where(on != F.coalesce("__was", F.lit(False)))
    paired = running(changes, keys, ["ts", "seq"], leads={"ended": F.col("ts")}).where(on)
    if idle is not None:
        paired = paired.join(ends, keys).withColumn("ended", F.coalesce("ended", "__silence"))
    return paired.select("session", F.col("ts").alias("started"), "ended")


def active_duration(states: DataFrame, keys: Sequence[str], running_state: str = "recording") -> DataFrame:
    """Seconds spent in the running state, from each change to the next."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = running(states, keys, ["ts", "seq"], leads={"__next": at})
    spent = F.when(F.col("state") == running_state, F.col("__next") - at)
    return timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("changes"),
        (F.coalesce(F.sum(spent), F.lit(0)) / 1e6).alias("active_seconds"),
    )


def frame_integrity(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames per session by what is wrong with them."""
    reason = F.coalesce(wire.frame_reason(F.col("data")), F.lit("ok"))
    return frames.groupBy(*keys, reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.length("data")).alias("bytes")
    )


def input_activity(inputs: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Input events per session, kind and window; broken ones are left out."""
    parsed = inputs.select(*keys, "ts", _parsed(wire.parse_input(F.col("payload"))).alias("e"))
    far = F.col("e.x").between(0, 1) & F.col("e.y").between(0, 1)
    return parsed.groupBy(*keys, F.col("e.kind").alias("kind"), F.window("ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("e.pressed")).alias("pressed"),
        F.sum("e.wheel").alias("wheel"),
        F.count_if(far).alias("on_screen"),
    ).select(*keys, "kind", F.col("w.start").alias("window_start"), "n", "pressed", "wheel", "on_screen")


def packet_activity(packets: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Screen frames and commands per session, kind and window: how many, bytes of images,
    pixels, and characters of messages. Packets of those types that do not parse are counted as
    ``Broken``; other types are left out."""
    kind_of = F.create_map(*(F.lit(x) for pair in wire.PACKET_TYPES.items() for x in pair))
    typed = packets.withColumn("__type", kind_of[F.col("type")]).where(F.col("__type").isin("ScreenFrame", "Command"))
    parsed = typed.select(
        *keys, "ts", F.when(F.col("__type") == "ScreenFrame", wire.parse_screen(F.col("payload"))).alias("s"),
        F.when(F.col("__type") == "Command", wire.parse_command(F.col("payload"))).alias("c"),
    )
    kind = F.when(F.col("s").isNotNull(), "ScreenFrame").when(F.col("c").isNotNull(), F.col("c.kind")).otherwise("Broken")
    return parsed.groupBy(*keys, kind.alias("kind"), F.window("ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("s.image")).alias("image_bytes"),
        F.sum(F.col("s.width").cast("bigint") * F.col("s.height")).alias("pixels"),
        F.sum(F.length("c.text")).alias("message_chars"),
    ).select(*keys, "kind", F.col("w.start").alias("window_start"), "n", "image_bytes", "pixels", "message_chars")


class FrameBuffer:
    """Bytes of one session that do not make a whole frame yet."""

    def __init__(self, rest: bytes = b"", broken: bool = False):
        self.rest, self.broken = bytearray(rest), broken

    def feed(self, data: bytes) -> Iterator[tuple[int | None, bytes | None, str | None]]:
        """(type, payload, reason) of what is complete now. A bad frame ends the session."""
        import zlib

        if self.broken:
            return
        self.rest += data
        start = 0
        while not self.broken and len(self.rest) - start >= wire.FRAME_HEADER:
            head = self.rest[start : start + wire.FRAME_HEADER]
            size = int.from_bytes(head[6:10], "little")
            reason = None
            if head[:2].hex() != wire.FRAME_MAGIC:
                reason = "bad_magic"
            elif head[2] != wire.VERSION:
                reason = "bad_version"
            elif size > wire.MAX_PAYLOAD:
                reason = "too_long"
            elif len(self.rest) - start < wire.FRAME_HEADER + size:
                break
            else:
                body = bytes(self.rest[start + wire.FRAME_HEADER : start + wire.FRAME_HEADER + size])
                if zlib.crc32(body) != int.from_bytes(head[10:14], "little"):
                    reason = "bad_crc"
            if reason:
                self.broken = True
                yield None, None, reason
                break
            start += wire.FRAME_HEADER + size
            yield head[3], body, None
        if self.broken:
            self.rest = bytearray()
        elif start:  # what is unfinished stays where it is, so a long frame is not copied per chunk
            del self.rest[:start]


FRAME_SCHEMA = "session long, frame_no long, type int, payload binary, reason string"


def frame_reassembly(chunks: DataFrame) -> DataFrame:
    """Whole frames from chunks of bytes, per session in order.

    Where a frame begins is known only once the one before it is read, so a session is walked
    in order. Its chunks stream through a sorted partition; a task keeps one unfinished frame
    and nothing else.
    """

    def walk(batches):
        import pandas as pd

        session, buffer, number = None, FrameBuffer(), 0
        for frame in batches:
            rows = []
            for key, data in zip(frame["session"].tolist(), frame["data"].tolist()):
                if key != session:
                    session, buffer, number = key, FrameBuffer(), 0
                for kind, payload, reason in buffer.feed(data):
                    number += 1
                    rows.append((key, number, kind, payload, reason))
            out = pd.DataFrame(rows, columns=["session", "frame_no", "type", "payload", "reason"])
            out["type"] = out["type"].astype("Int32")
            yield out

    placed = chunks.select("session", "seq", "data").repartition("session").sortWithinPartitions("session", "seq")
    return placed.mapInPandas(walk, FRAME_SCHEMA)
