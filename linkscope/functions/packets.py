"""Expressions over packet columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import C2S, DB_PORTS, S2C, UNKNOWN

#: Bits of the TCP flags, in the order in which they are listed.
FLAGS = {"SYN": 0x02, "ACK": 0x10, "FIN": 0x01, "RST": 0x04, "PSH": 0x08}


def flag(name: str, flags: str | Column = "tcp_flags") -> Column:
    return F.col(flags).bitwiseAND(FLAGS[name]) != 0 if isinstance(flags, str) else flags.bitwiseAND(FLAGS[name]) != 0


def flags_text(flags: str = "tcp_flags") -> Column:
    """SYN,ACK,...; a dot for none."""
    text = F.concat_ws(",", *[F.when(flag(n, flags), F.lit(n)) for n in FLAGS])
    return F.when(text == "", F.lit(".")).otherwise(text)


def truncated() -> Column:
    return F.coalesce(F.col("cap_len") < F.col("frame_len"), F.lit(False))


def direction(server_ip: str = "server_ip", server_port: str = "server_port") -> Column:
    to_server = (F.col("dst_ip") == F.col(server_ip)) & (F.col("dst_port") == F.col(server_port))
    from_server = (F.col("src_ip") == F.col(server_ip)) & (F.col("src_port") == F.col(server_port))
    return F.when(to_server, C2S).when(from_server, S2C).otherwise(UNKNOWN)


def opposite(direction: str | Column) -> Column:
    d = F.col(direction) if isinstance(direction, str) else direction
    return F.when(d == C2S, S2C).when(d == S2C, C2S).otherwise(UNKNOWN)


def role_direction(direction: str = "direction") -> Column:
    return F.when(F.col(direction) == C2S, "APP_TO_DB").when(F.col(direction) == S2C, "DB_TO_APP").otherwise("UNKNOWN")


def expected_ack(seq: str = "tcp_seq", length: str = "tcp_len", flags: str = "tcp_flags") -> Column:
    return F.col(seq) + F.col(length) + flag("SYN", flags).cast("int") + flag("FIN", flags).cast("int")


def advances_sequence() -> Column:
    return (F.col("tcp_len") > 0) | flag("SYN") | flag("FIN")


def pure_ack() -> Column:
    return flag("ACK") & ~flag("SYN") & ~flag("FIN") & ~flag("RST") & (F.col("tcp_len") == 0)


def payload_sha256(hex_text: str = "payload_hex") -> Column:
    """Of the bytes that the hex text stands for, or of the text itself where it isn't whole hex bytes; of nothing for none."""
    text = F.coalesce(F.col(hex_text), F.lit(""))
    return F.sha2(F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text)).otherwise(F.encode(text, "UTF-8")), 256)


def stream_filter(stream: str = "tcp_stream", frames: Column | None = None) -> Column:
    """A display filter of a stream, narrowed to its first 30 frames where there are any."""
    base = F.concat(F.lit("tcp.stream eq "), F.coalesce(F.col(stream).cast("string"), F.lit("None")))
    if frames is None:
        return base
    listed = F.array_join(F.transform(F.slice(frames, 1, 30), lambda n: F.concat(F.lit("frame.number == "), n.cast("string"))), " || ")
    return F.when(F.size(frames) > 0, F.concat(base, F.lit(" && ("), listed, F.lit(")"))).otherwise(base)


def database_of(port: str) -> Column:
    """The database that usually listens on a port, or the port."""
    names = F.create_map(*[F.lit(x) for name, p in DB_PORTS.items() for x in (p, name)])
    return F.coalesce(F.element_at(names, F.col(port)), F.col(port).cast("string"))


def once(value: Column) -> Column:
    """The value computed once a row: a generator of one row, past which Spark moves no expression."""
    return F.explode(F.array(value))
