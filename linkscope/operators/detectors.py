"""Detectors on the packets of sessions: retransmissions, stalled acknowledgements, resets, zero windows, capture quality.

All take packets with session keys, direction and payload_sha256, and follow pkt_ord, the order
in the capture, not time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import packets as P
from ..schemas import KEYS
from . import scan

#: Packets of a capture in whose ranges sessions are followed.
CHUNK = 1 << 20


def retransmissions(directed: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """One row a segment that was sent twice or more: same session, direction, sequence number, length and content."""
    g = directed.where(P.advances_sequence()).groupBy(*KEYS, "direction", F.col("tcp_seq").alias("seq"), "tcp_len", "payload_sha256").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.array_sort(F.collect_set("frame_number")).alias("frames"),
        F.min_by(P.expected_ack(), "pkt_ord").alias("expected_ack"),
        F.min("pkt_ord").alias("first_ord"),
    ).where("count >= 2")
    g = g.withColumn("duration_ms", F.round((F.col("last_ts") - F.col("first_ts")) * 1000, 3)).withColumn("plane", F.when(F.col("tcp_len") > 0, "data").otherwise("control"))
    n, ms = F.col("count"), F.col("duration_ms")
    control = F.when((n >= th.retx_burst_warn_count) | (ms >= th.retx_high_duration_ms), "WARNING").otherwise("INFO")
    data = F.when((n >= th.retx_high_count) & (ms >= th.retx_high_duration_ms), "HIGH").when(n >= th.retx_burst_warn_count, "WARNING").otherwise(th.severity("retx_single_severity", "INFO"))
    g = g.withColumn("severity", F.when(F.col("plane") == "control", control).otherwise(data))
    return g.withColumn("anomaly_type", F.concat(F.upper("plane"), F.lit("_RETRANSMISSION"))).withColumn("filter", P.stream_filter("session_id", F.col("frames")))


def ack_stalls(directed: DataFrame, retx: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Data segments sent again for long while the peer's acknowledgement never passed them; no acknowledgement counts as 0.

    Acknowledgements and the segments' last times are merged in one order of time for each session and
    direction, and the greatest acknowledgement so far is what a segment had seen: as many
    rows as there are acknowledgements and segments, none for their pairs.
    """
    long = retx.where((F.col("tcp_len") > 0) & (F.col("duration_ms") >= th.ack_stall_ms)).withColumn("ack_direction", P.opposite("direction"))
    place = [*KEYS, "ack_direction"]
    until = long.groupBy(*place).agg(F.max("last_ts").alias("until"))
    acks = directed.where(P.flag("ACK")).select(*KEYS, F.col("direction").alias("ack_direction"), F.col("timestamp").alias("at"), "tcp_ack")
    acks = acks.join(until, place).where("at <= until").drop("until").withColumn("segment", F.lit(False))
    segments = long.withColumns({"at": F.col("last_ts"), "segment": F.lit(True)})
    so_far = Window.partitionBy(*place).orderBy("at", "segment").rowsBetween(Window.unboundedPreceding, 0)
    both = segments.unionByName(acks, allowMissingColumns=True).withColumn("observed_ack", F.coalesce(F.max("tcp_ack").over(so_far), F.lit(0).cast("long")))
    out = both.where("segment AND observed_ack < expected_ack")
    return out.select(*KEYS, F.col("direction").alias("send_direction"), "seq", "tcp_len", "payload_sha256", "expected_ack", "observed_ack", F.col("duration_ms").alias("stall_duration_ms"), F.col("count").alias("retransmission_count"), "frames", "first_ord", F.lit("HIGH").alias("severity"), "filter")


#: What a report says of each class of resets.
RST_NOTES = {
    "RST_AFTER_FIN": "Reset after a FIN: usually the cleanup of a connection that its application had closed.",
    "ACK_TO_RST": "Data had been exchanged; the reset follows an acknowledgement.",
    "RST_DURING_DATA": "The connection was reset while data was on its way.",
    "RST_AFTER_SYN": "Reset during or right after the handshake: look for a refused port, a firewall or a service not yet up.",
    "RST_OTHER": "The capture shows neither handshake nor data before this reset.",
}


def resets(directed: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """One row a reset, with its class by what came before it in the session."""
    p = directed.select(*KEYS, "pkt_ord", "frame_number", "timestamp", "direction", P.flag("RST").alias("is_rst"), P.flag("SYN").alias("syn"), P.flag("FIN").alias("fin"), ((F.col("tcp_len") > 0) & ~P.flag("SYN")).alias("data"), P.pure_ack().alias("ack"))
    seen = {"saw_syn": ("max", F.col("syn")), "saw_fin": ("max", F.col("fin")), "saw_data": ("max", F.col("data")), "after_ack": ("lag", F.col("ack"))}
    p = scan.in_chunks(p, KEYS, "pkt_ord", CHUNK, seen).where("is_rst").fillna(False, ["after_ack"])
    cls = F.when(F.col("saw_fin"), "RST_AFTER_FIN").when(F.col("after_ack") & F.col("saw_data"), "ACK_TO_RST").when(F.col("saw_data"), "RST_DURING_DATA").when(F.col("saw_syn"), "RST_AFTER_SYN").otherwise("RST_OTHER")
    severity = {"RST_AFTER_FIN": th.severity("rst_after_fin_severity", "INFO"), "ACK_TO_RST": th.severity("ack_to_rst_severity", "WARNING"), "RST_DURING_DATA": th.severity("rst_during_data_severity", "HIGH"), "RST_AFTER_SYN": th.severity("rst_after_syn_severity", "WARNING"), "RST_OTHER": "WARNING"}
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("classification"))
    return p.withColumn("classification", cls).select(*KEYS, "pkt_ord", F.col("frame_number").alias("frame"), "timestamp", "direction", "classification", of(severity).alias("severity"), of(RST_NOTES).alias("note"))


def zero_windows(directed: DataFrame) -> DataFrame:
    """One row a run of packets with window 0 that are neither reset nor end; whatever packet follows ends it."""
    zero = (F.col("tcp_window") == 0) & ~P.flag("RST") & ~P.flag("FIN")
    p = directed.select(*KEYS, "pkt_ord", "timestamp", "direction", "frame_number", F.coalesce(zero, F.lit(False)).alias("zero"))
    # Packets of a run have as many other ones before them.
    p = scan.in_chunks(p, KEYS, "pkt_ord", CHUNK, {"run": ("sum", F.when(F.col("zero"), 0).otherwise(1).cast("long"))})
    p = scan.in_chunks(p, KEYS, "pkt_ord", CHUNK, {"next_ts": ("lag", F.col("timestamp"))}, backwards=True)
    runs = p.where("zero").groupBy(*KEYS, "run").agg(F.min_by("timestamp", "pkt_ord").alias("start_ts"), F.max_by("next_ts", "pkt_ord").alias("end_ts"), F.min_by("direction", "pkt_ord").alias("direction"),
                                                     F.transform(F.array_sort(F.collect_list(F.struct("pkt_ord", "frame_number"))), lambda x: x["frame_number"]).alias("frames"), F.min("pkt_ord").alias("first_ord"))
    return runs.drop("run").withColumn("duration_ms", F.round((F.col("end_ts") - F.col("start_ts")) * 1000, 3))


def capture_quality(packets: DataFrame, th: Thresholds = Thresholds(), cut_short: bool | DataFrame = False) -> DataFrame:
    """One row a capture: how much of the packets it holds. cut_short: of the capture, or (capture_id, file_cut_short) of many."""
    cut = packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total_packets"), F.count_if(P.truncated()).alias("truncated_packets"), F.count("cap_len").alias("known"))
    modes = packets.where("cap_len IS NOT NULL").groupBy("capture_id", "cap_len").agg(F.count(F.lit(1)).alias("n"), F.min("pkt_ord").alias("first"))
    mode = modes.groupBy("capture_id").agg(F.max_by(F.struct("cap_len", "n"), F.struct("n", -F.col("first"))).alias("m"))
    q = cut.join(mode, "capture_id", "left")
    of_many = isinstance(cut_short, DataFrame)
    q = q.join(cut_short.select("capture_id", "file_cut_short"), "capture_id", "left") if of_many else q.withColumn("file_cut_short", F.lit(cut_short))
    torn = F.coalesce("file_cut_short", F.lit(False))
    ratio = F.col("truncated_packets") / F.col("total_packets")
    credibility = F.when(ratio >= th.truncated_high_ratio, "LOW").when(F.col("truncated_packets") > 0, "DEGRADED").when(torn, "DEGRADED").otherwise("HIGH")
    return q.select("capture_id", "total_packets", "truncated_packets", F.round(ratio, 4).alias("truncated_ratio"), F.col("m.cap_len").alias("common_cap_len"), F.coalesce((F.col("m.cap_len") == 128) & (F.col("m.n") * 2 >= F.col("known")), F.lit(False)).alias("snaplen_128_hint"), credibility.alias("credibility"), torn.alias("file_cut_short"))
