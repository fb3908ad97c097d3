"""Packets from the field text of a dissector: one line a packet, 20 fields between bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packets import once
from .lines import numbered

#: The fields in order.
FIELDS = (
    "frame.number", "frame.time_epoch", "frame.len", "frame.cap_len", "ip.src", "ip.dst", "tcp.srcport", "tcp.dstport", "tcp.stream", "tcp.flags", "tcp.seq", "tcp.ack", "tcp.window_size", "tcp.len", "tcp.payload",
    "tcp.analysis.retransmission", "tcp.analysis.fast_retransmission", "tcp.analysis.spurious_retransmission", "tcp.options.timestamp.tsval", "tcp.options.timestamp.tsecr",
)


def parse(lines: DataFrame) -> DataFrame:
    """Packets of lines (capture_id, line_no, value).

    A line without time, ports, flags or sequence number is dropped, and one in which a number
    is no number; an empty acknowledgement, window or length is 0, other empty numbers are null.
    """
    at = lambda i: F.coalesce(F.trim(F.get("c", F.lit(i))), F.lit(""))
    p = lines.select("capture_id", "line_no", once(F.split("value", r"\|")).alias("c"))
    number = lambda i, kind: at(i).try_cast(kind)
    flags = F.conv(F.nullif(F.regexp_replace(at(9), "^0[xX]", ""), F.lit("")), 16, 10).try_cast("int")
    flags = F.when(at(9).rlike("^(0[xX])?[0-9A-Fa-f]+$"), flags)
    truthy = lambda i: ~at(i).isin("", "0", "False", "false")
    p = p.select(
        "capture_id", F.col("line_no").alias("pkt_ord"), number(1, "double").alias("timestamp"), at(4).alias("src_ip"), at(5).alias("dst_ip"), number(6, "int").alias("src_port"), number(7, "int").alias("dst_port"), flags.alias("tcp_flags"), number(10, "long").alias("tcp_seq"),
        F.when(at(11) == "", 0).otherwise(number(11, "long")).alias("tcp_ack"), F.when(at(12) == "", 0).otherwise(number(12, "long")).alias("tcp_window"), F.when(at(13) == "", 0).otherwise(number(13, "int")).alias("tcp_len"),
        number(0, "long").alias("frame_number"), number(8, "long").alias("tcp_stream"), number(2, "int").alias("frame_len"), number(3, "int").alias("cap_len"), F.replace(at(14), F.lit(":"), F.lit("")).alias("payload_hex"),
        truthy(15).alias("ws_retransmission"), truthy(16).alias("ws_fast_retransmission"), truthy(17).alias("ws_spurious_retransmission"), number(18, "long").alias("tcp_options_tsval"), number(19, "long").alias("tcp_options_tsecr"),
        *[((at(i) != "") & number(i, "long").isNull()).alias(f"bad_{i}") for i in (0, 2, 3, 8, 18, 19)],
    )
    p = p.where("timestamp IS NOT NULL AND src_port IS NOT NULL AND dst_port IS NOT NULL AND tcp_flags IS NOT NULL AND tcp_seq IS NOT NULL AND tcp_ack IS NOT NULL AND tcp_window IS NOT NULL AND tcp_len IS NOT NULL AND NOT (bad_0 OR bad_2 OR bad_3 OR bad_8 OR bad_18 OR bad_19)")
    return p.drop("bad_0", "bad_2", "bad_3", "bad_8", "bad_18", "bad_19")


def read(spark: SparkSession, path: str | list[str], port: int | None = None, max_packets: int | None = None) -> DataFrame:
    """Packets of the field-text files under path; each file is a capture, its lines are numbered as they stand."""
    p = parse(numbered(spark, path, "capture_id", ends="\n").where("value <> ''"))
    p = p if port is None else p.where((F.col("src_port") == port) | (F.col("dst_port") == port))
    return p if max_packets is None else p.orderBy("capture_id", "pkt_ord").limit(max_packets)
