"""Sessions, their packets, handshakes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import packets as P
from ..schemas import C2S, KEYS, S2C


def with_session(packets: DataFrame) -> DataFrame:
    """packets with session_id: the stream number, or -1, -2, ... for each pair of endpoints without one, as they first appear."""
    a, b = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    lost = packets.where("tcp_stream IS NULL").select("capture_id", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "pkt_ord")
    pairs = lost.groupBy("capture_id", "lo", "hi").agg(F.min("pkt_ord").alias("first"))
    named = pairs.select("capture_id", "lo", "hi", (-F.row_number().over(Window.partitionBy("capture_id").orderBy("first"))).cast("long").alias("made_id"))
    known = packets.where("tcp_stream IS NOT NULL").withColumn("session_id", F.col("tcp_stream").cast("long"))
    given = packets.where("tcp_stream IS NULL").withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)}).join(named, ["capture_id", "lo", "hi"])
    return known.unionByName(given.withColumnRenamed("made_id", "session_id").drop("lo", "hi"))


def sessions(packets: DataFrame, db_port: int) -> DataFrame:
    """One row a session; the first packet names the server: the endpoint with the database's port, else the receiver."""
    first = F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port"), "pkt_ord").alias("f")
    s = packets.groupBy(*KEYS).agg(
        first,
        F.min("pkt_ord").alias("session_ord"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("packet_count"),
        F.max(P.flag("RST")).alias("rst_seen"),
        F.max(P.flag("FIN")).alias("fin_seen"),
    )
    at_source = (F.col("f.dst_port") != db_port) & (F.col("f.src_port") == db_port)
    end = lambda server, field: F.when(at_source == F.lit(server), F.col(f"f.src_{field}")).otherwise(F.col(f"f.dst_{field}"))
    return s.select(*KEYS, "session_ord", end(False, "ip").alias("client_ip"), end(False, "port").alias("client_port"), end(True, "ip").alias("server_ip"), end(True, "port").alias("server_port"),
                    "start_time", "end_time", "packet_count", "rst_seen", "fin_seen")


def with_direction(packets: DataFrame, sessions: DataFrame) -> DataFrame:
    """packets with their session's endpoints and their direction."""
    ends = sessions.select(*KEYS, "client_ip", "client_port", "server_ip", "server_port")
    return packets.join(ends, KEYS).withColumn("direction", P.direction())


def handshakes(packets: DataFrame) -> DataFrame:
    """One row a session: the first SYN, the first SYN-ACK after it, the first ACK after that, and the latency between the first two."""
    syn, synack = P.flag("SYN") & ~P.flag("ACK"), P.flag("SYN") & P.flag("ACK")
    ack = P.flag("ACK") & ~P.flag("SYN") & ~P.flag("RST")
    p = packets.select(*KEYS, "pkt_ord", "timestamp", syn.alias("is_syn"), synack.alias("is_synack"), ack.alias("is_ack"))
    first = lambda rows, n: rows.groupBy(*KEYS).agg(F.min("pkt_ord").alias(f"o{n}"), F.min_by("timestamp", "pkt_ord").alias(f"t{n}"))
    all_, one = p.select(*KEYS).distinct(), first(p.where("is_syn"), 1)
    two = first(p.where("is_synack").join(one.select(*KEYS, "o1"), KEYS).where("pkt_ord > o1"), 2)
    three = first(p.where("is_ack").join(two.select(*KEYS, "o2"), KEYS).where("pkt_ord > o2"), 3)
    again = p.where("is_syn").groupBy(*KEYS).agg((F.count(F.lit(1)) - 1).alias("again"))
    h = all_.join(one, KEYS, "left").join(two, KEYS, "left").join(three, KEYS, "left").join(again, KEYS, "left")
    h = h.select(*KEYS, F.col("t1").alias("syn_ts"), F.col("t2").alias("synack_ts"), F.col("t3").alias("ack_ts"), F.coalesce("again", F.lit(0)).cast("long").alias("syn_retransmissions"))
    return h.select(*KEYS, "syn_ts", "synack_ts", "ack_ts", "syn_retransmissions", (F.col("ack_ts").isNotNull()).alias("complete"), F.round((F.col("synack_ts") - F.col("syn_ts")) * 1000, 3).alias("latency_ms"))


def summaries(directed: DataFrame, sessions: DataFrame, handshakes: DataFrame, retx: DataFrame, stalls: DataFrame, resets: DataFrame, zero_windows: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """One row a session, with counts of every finding and the severity that follows."""
    counts = directed.groupBy(*KEYS).agg(F.count_if(F.col("direction") == C2S).alias("client_packets"), F.count_if(F.col("direction") == S2C).alias("server_packets"), F.sum("tcp_len").alias("payload_bytes"))
    r = retx.groupBy(*KEYS).agg(F.sum(F.col("count") - 1).alias("retransmissions"), F.max((F.col("severity") == "HIGH") & (F.col("plane") == "data")).alias("high_retx"))
    a = stalls.groupBy(*KEYS).agg(F.lit(True).alias("stalled"))
    x = resets.groupBy(*KEYS).agg(F.min_by("classification", "pkt_ord").alias("rst_class"), F.max(F.col("severity") == "HIGH").alias("high_rst"))
    z = zero_windows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("zero_window"))
    j = sessions.join(counts, KEYS)
    for part in (handshakes.select(*KEYS, F.col("latency_ms").alias("handshake_latency_ms")), r, a, x, z):
        j = j.join(part, KEYS, "left")
    j = j.fillna(0, ["retransmissions", "zero_window"]).fillna(False, ["high_retx", "stalled", "high_rst"])
    high = F.col("high_retx") | F.col("stalled") | F.col("high_rst") | (F.col("zero_window") >= th.zero_window_crit_count)
    warn = (F.col("retransmissions") > 0) | (F.col("zero_window") >= th.zero_window_warn_count)
    return j.select(*KEYS, "session_ord", "client_ip", "client_port", "server_ip", "server_port", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "packet_count", "client_packets",
                    "server_packets", "payload_bytes", "retransmissions", "rst_seen", "fin_seen", "zero_window", "handshake_latency_ms", "rst_class",
                    F.when(high, "HIGH").when(warn, "WARNING").otherwise("INFO").alias("severity"))
