"""Fixed binary layouts as Column expressions: beacons, frames, input events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wire formats.
BEACON_MAGIC, FRAME_MAGIC, VERSION = "594144", "5941", 1
BEACON_HEADER, FRAME_HEADER, INPUT_SIZE = 8, 14, 18
MAX_PAYLOAD = 64 * 1024 * 1024
ROLE_MASTER, ROLE_AGENT = 1, 2
PACKET_TYPES = {
    1: "Handshake", 2: "HandshakeAck", 3: "Ping", 4: "Pong", 5: "Disconnect", 10: "ScreenRequest",
    11: "ScreenFrame", 20: "InputEvent", 21: "Command", 22: "FileChunk", 250: "Error",
}
INPUT_KINDS = {1: "MouseMove", 2: "MouseButton", 3: "MouseWheel", 4: "Key"}


def unsigned(data: Column, at: int, size: int) -> Column:
    """Little-endian unsigned number of up to four bytes at a 0-based offset."""
    swapped = F.concat(*(F.hex(F.substring(data, at + 1 + i, 1)) for i in reversed(range(size))))
    return F.conv(swapped, 16, 10).cast("bigint")


def signed32(data: Column, at: int) -> Column:
    raw = unsigned(data, at, 4)
    return F.when(raw >= 2**31, raw - 2**32).otherwise(raw).cast("int")


def float32(data: Column, at: int) -> Column:
    """IEEE single at an offset; not-a-number and infinities give NaN."""
    raw = unsigned(data, at, 4)
    sign = F.when(raw >= 2**31, -1.0).otherwise(1.0)
    power = F.shiftright(raw, 23).bitwiseAND(F.lit(255))
    mantissa = raw.bitwiseAND(F.lit(2**23 - 1)) / 2.0**23
    normal = sign * (1 + mantissa) * F.pow(F.lit(2.0), power - 127)
    tiny = sign * mantissa * 2.0**-126
    return F.when(power == 255, float("nan")).when(power == 0, tiny).otherwise(normal)


def little_endian(value: Column, size: int) -> Column:
    """A number as bytes, lowest first."""
    hexed = F.lpad(F.hex(value), size * 2, "0")
    return F.unhex(F.concat(*(F.substring(hexed, size * 2 - 1 - 2 * i, 2) for i in range(size))))


def utf8(data: Column) -> Column:
    """Text of bytes. Bad sequences become replacement characters; a foreign packet stops
    nothing."""
    return F.make_valid_utf8(data.cast("string"))


def parse_beacon(payload: Column) -> Column:
    """Role, port and name of a beacon, null for anything else."""
    role, port, size = unsigned(payload, 4, 1), unsigned(payload, 5, 2), unsigned(payload, 7, 1)
    valid = (
        (F.length(payload) >= BEACON_HEADER)
        & (F.hex(F.substring(payload, 1, 3)) == BEACON_MAGIC)
        & (unsigned(payload, 3, 1) == VERSION)
        & role.isin(ROLE_MASTER, ROLE_AGENT)
        & (port != 0)
        & (F.length(payload) >= BEACON_HEADER + size)
    )
    name = utf8(F.substring(payload, F.lit(BEACON_HEADER + 1), size.cast("int")))
    # A name is cut at 64 characters.
    return F.when(
        valid, F.struct(role.cast("int").alias("role"), port.cast("int").alias("port"), F.left(name, F.lit(64)).alias("name"))
    )


def frame_reason(data: Column) -> Column:
    """Why bytes are no whole frame, null for a good one."""
    length = unsigned(data, 6, 4)
    payload = F.substring(data, F.lit(FRAME_HEADER + 1), length.cast("int"))
    return (
        F.when(F.length(data) < FRAME_HEADER, "incomplete")
        .when(F.hex(F.substring(data, 1, 2)) != FRAME_MAGIC, "bad_magic")
        .when(unsigned(data, 2, 1) != VERSION, "bad_version")
        .when(length > MAX_PAYLOAD, "too_long")
        .when(F.length(data) < FRAME_HEADER + length, "incomplete")
        .when(F.crc32(payload) != unsigned(data, 10, 4), "bad_crc")
    )


def build_frame(kind: Column, payload: Column, crc: Column | None = None) -> Column:
    """A whole frame around a payload."""
    return F.concat(
        F.unhex(F.lit(FRAME_MAGIC)), F.unhex(F.lit(f"{VERSION:02X}")), little_endian(kind, 1), F.unhex(F.lit("0000")),
        little_endian(F.length(payload), 4), little_endian(F.crc32(payload) if crc is None else crc, 4), payload,
    )


def parse_input(payload: Column) -> Column:
    """Typed fields of an input event, null for a wrong size or kind. Fields that a kind
    does not use are null."""
    kind = unsigned(payload, 0, 1)
    name = F.lit(None).cast("string")
    for code, label in INPUT_KINDS.items():
        name = F.when(kind == code, label).otherwise(name)
    uses = lambda value, *kinds: F.when(name.isin(*kinds), value)
    return F.when(
        (F.length(payload) == INPUT_SIZE) & name.isNotNull(),
        F.struct(
            name.alias("kind"),
            uses(unsigned(payload, 1, 1).cast("int"), "MouseButton").alias("button"),
            uses(unsigned(payload, 2, 1) != 0, "MouseButton", "Key").alias("pressed"),
            uses(float32(payload, 4), "MouseMove", "MouseButton").alias("x"),
            uses(float32(payload, 8), "MouseMove", "MouseButton").alias("y"),
            uses(signed32(payload, 12), "MouseWheel").alias("wheel"),
            uses(unsigned(payload, 16, 2).cast("int"), "Key").alias("key"),
        ),
    )


def parse_screen(payload: Column, most: int = 16384) -> Column:
    """Width, height, format and image of a screen frame, null for a broken one."""
    width, height = signed32(payload, 0), signed32(payload, 4)
    valid = (F.length(payload) >= 9) & width.between(1, most) & height.between(1, most)
    image = F.substring(payload, F.lit(10), F.length(payload))
    return F.when(
        valid,
        F.struct(width.alias("width"), height.alias("height"), unsigned(payload, 8, 1).cast("int").alias("format"), image.alias("image")),
    )


def parse_command(payload: Column, most: int = 1200) -> Column:
    """Kind and text of a remote command, null for an unknown or broken one."""
    kind, size = unsigned(payload, 0, 1), unsigned(payload, 2, 2)
    valid = (F.length(payload) >= 4) & (size <= most) & (F.length(payload) == size + 4) & kind.isin(1, 2)
    text = utf8(F.substring(payload, F.lit(5), size.cast("int")))
    return F.when(
        valid, F.struct(F.when(kind == 1, "ShowMessage").otherwise("LockScreen").alias("kind"), F.when(kind == 1, text).alias("text"))
    )
