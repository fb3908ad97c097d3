"""Timelines of events: what the captures show around each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packets as P

#: Kinds of findings that a timeline lists, beside resets.
IMPORTANT = ("DATA_RETRANSMISSION", "CONTROL_RETRANSMISSION", "ACK_STALLED", "ZERO_WINDOW", "RST_AFTER_SYN", "RST_DURING_DATA", "ACK_TO_RST", "RST_AFTER_FIN", "RST_OTHER", "HANDSHAKE_INCOMPLETE")
COLUMNS = {"event_id": "string", "timestamp": "double", "relative_seconds": "double", "source": "string", "event_type": "string", "side": "string", "frame": "long", "stream": "long", "seq": "long", "ack": "long", "tcp_len": "int", "description": "string", "evidence_level": "string", "correlation_id": "string", "direction": "string", "app_stream": "long", "db_stream": "long"}


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def anomaly_times(found: DataFrame, packets: DataFrame, sessions: DataFrame) -> DataFrame:
    """found with ts: of the first packet among its frames; else the middle of its session; else the session's start."""
    a = found.where("session_id IS NOT NULL").withColumn("a_id", F.xxhash64("session_id", "type", "seq", "tcp_len", "first_ord", "frames"))
    hit = a.select("a_id", "session_id", F.explode("frames").alias("frame_number")).hint("merge").join(packets.select("session_id", "frame_number", "timestamp", "pkt_ord"), ["session_id", "frame_number"]).groupBy("a_id").agg(F.min_by("timestamp", "pkt_ord").alias("hit_ts"))
    s = sessions.select("session_id", ((F.col("start_time") + F.col("end_time")) / 2).alias("middle"), "start_time")
    return a.join(hit.hint("merge"), "a_id", "left").join(s.hint("merge"), "session_id", "left").withColumn("ts", F.coalesce("hit_ts", "middle", "start_time")).drop("a_id", "hit_ts", "middle", "start_time")


def timeline(events: DataFrame, chosen: DataFrame, sides: dict[str, dict[str, DataFrame]], segments: DataFrame, window: float = 30.0, strict_compat: bool = False) -> DataFrame:
    """All entries of all events. chosen: event_id, evidence_level, correlation_id, app_stream, db_stream, client_ip, ... of each event.

    sides: {"APP"/"DB": {"packets", "anomalies", "sessions", "quality"}}. strict_compat reproduces that stream 0 counts as none.
    """
    c = F.col
    e = events.select("event_id", F.col("timestamp").alias("t0"), "event_type", F.trim(F.concat(c("event_type"), F.lit(": "), F.coalesce("caused_by_class", "exception_class", F.lit("")), F.lit(" "), F.coalesce("caused_by_message", "message", F.lit("")))).alias("said"))
    # Joins of what grows with events or packets never go through the driver: many of them run at once.
    j = e.hint("merge").join(chosen.select("event_id", "evidence_level", "correlation_id", "app_stream", "db_stream", "client_ip", "client_port", "server_ip", "server_port"), "event_id")
    parts = [_rows(j, event_id=c("event_id"), timestamp=c("t0"), relative_seconds=F.when(c("t0").isNotNull(), 0.0), source=F.lit("JDBC"), event_type=c("event_type"), side=F.lit("APP_LOG"), description=c("said"), evidence_level=c("evidence_level"))]
    way = F.concat(c("client_ip"), F.lit(":"), c("client_port"), F.lit(" -> "), c("server_ip"), F.lit(":"), c("server_port"))
    linked = j.where("app_stream IS NOT NULL" + (" AND app_stream <> 0" if strict_compat else ""))
    identity = {"correlation_id": c("correlation_id"), "direction": way, "app_stream": c("app_stream"), "db_stream": c("db_stream")}
    for side, source in (("APP", "APP_PCAP"), ("DB", "DB_PCAP")):
        own, stream = sides[side], c(f"{side.lower()}_stream")
        mine = linked.where(stream.isNotNull() & (stream != 0 if strict_compat else F.lit(True)))
        label = F.when(P.flag("SYN") & ~P.flag("ACK"), "SYN").when(P.flag("SYN"), "SYN_ACK").when(P.flag("FIN"), "FIN").when(P.flag("RST"), "RST")
        marks = own["packets"].withColumn("label", label).where("label IS NOT NULL").select(c("session_id").alias("stream"), "timestamp", "label", "frame_number", "tcp_seq", "tcp_ack", "tcp_len")
        gap = F.abs(c("timestamp") - c("t0"))
        kept = mine.hint("merge").join(marks, stream == c("stream")).where(c("t0").isNull() | (gap <= window) | (c("label").isin("SYN", "SYN_ACK") & (gap <= max(window, 120))))
        parts.append(_rows(kept, event_id=c("event_id"), timestamp=c("timestamp"), relative_seconds=c("timestamp") - c("t0"), source=F.lit(source), event_type=c("label"), side=F.lit(side), frame=c("frame_number"), stream=c("stream"), seq=c("tcp_seq"), ack=c("tcp_ack"), tcp_len=c("tcp_len"),
                           description=F.concat(c("label"), F.lit(f" observed at {side} capture")), evidence_level=F.lit("CONFIRMED"), **identity))
        told = anomaly_times(own["anomalies"].where(c("type").isin(*IMPORTANT) | c("type").startswith("RST")), own["packets"], own["sessions"]).select(c("session_id").alias("stream"), "type", "summary", c("evidence_level").alias("a_level"), F.get("frames", F.lit(0)).alias("a_frame"), "ts")
        kept = mine.hint("merge").join(told, stream == c("stream")).where(F.coalesce(F.abs(c("ts") - c("t0")) <= 3 * window, F.lit(True)))
        parts.append(_rows(kept, event_id=c("event_id"), timestamp=c("ts"), relative_seconds=c("ts") - c("t0"), source=F.lit(source), event_type=c("type"), side=F.lit(side), frame=c("a_frame"), stream=c("stream"), description=c("summary"), evidence_level=c("a_level"), **identity))
        bad = own["quality"].where("credibility <> 'HIGH'").limit(1)  # a row a capture
        noted = linked.join(F.broadcast(bad.select("credibility", "truncated_packets")))
        parts.append(_rows(noted, event_id=c("event_id"), timestamp=c("t0"), relative_seconds=F.when(c("t0").isNotNull(), 0.0), source=F.lit(source), event_type=F.lit("CAPTURE_QUALITY"), side=F.lit(side), description=F.format_string(f"{side} capture credibility=%s truncated=%d", c("credibility"), c("truncated_packets")), evidence_level=F.lit("CONFIRMED")))
    segs = segments.where("match_status = 'MATCHED_BOTH_SIDES' AND app_timestamp IS NOT NULL").select("correlation_id", "app_timestamp", "app_frame", "seq", c("ack").alias("s_ack"), "tcp_len", c("evidence_level").alias("s_level"))
    kept = linked.hint("merge").join(segs, "correlation_id").where(c("t0").isNull() | (F.abs(c("app_timestamp") - c("t0")) <= window))
    parts.append(_rows(kept, event_id=c("event_id"), timestamp=c("app_timestamp"), relative_seconds=c("app_timestamp") - c("t0"), source=F.lit("DUAL"), event_type=F.lit("MATCHED_SEGMENT"), side=F.lit("BOTH"), frame=c("app_frame"), stream=c("app_stream"), seq=c("seq"), ack=c("s_ack"), tcp_len=c("tcp_len"), description=F.format_string("Matched segment Seq=%d Len=%d", c("seq"), c("tcp_len")), evidence_level=c("s_level"), **identity))
    return reduce(DataFrame.unionByName, parts)


def with_near_ties(entries: DataFrame, others: DataFrame) -> DataFrame:
    """entries, and those of the near ties without their log rows, marked with their candidate."""
    marked = others.where("source <> 'JDBC'").withColumn("description", F.concat(F.lit("[candidate "), F.coalesce("correlation_id", F.lit("?")), F.lit("] "), F.col("description")))
    return entries.unionByName(marked)


def in_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("event_id", F.asc_nulls_last("timestamp"), "source", "event_type")


def key_event(events: DataFrame, first: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The event that a case (each of `by`) is about: the last connection reset, else the last event. Reports of exception logs take the first instead."""
    at = F.struct((F.col("event_type") == "CONNECTION_RESET").alias("r"), (F.lit(-1) * F.col("event_ord") if first else F.col("event_ord")).alias("o"))
    return events.groupBy(*by).agg(F.max_by(F.struct("event_id", "timestamp"), at).alias("k")).select(*by, "k.*")


def unified(entries: DataFrame, markers: DataFrame, key: DataFrame) -> DataFrame:
    """The key event's timeline with the ping markers, graded by kind of evidence; runs of one retransmission are one row."""
    k = F.broadcast(key.select(F.col("event_id").alias("key_id"), F.col("timestamp").alias("key_ts")))  # one row
    t = entries.join(k, F.col("event_id") == F.col("key_id"))
    grade = F.when((F.col("source") == "JDBC") | (F.col("event_type") == "CAPTURE_QUALITY"), "CONFIRMED").otherwise("CORRELATED")
    own = t.select("event_id", "timestamp", "relative_seconds", "source", "event_type", "correlation_id", F.when(F.col("app_stream").isNull() & F.col("side").isin("APP", "BOTH"), F.col("stream")).otherwise(F.col("app_stream")).alias("app_stream"),
                   F.when(F.col("db_stream").isNull() & (F.col("side") == "DB"), F.col("stream")).otherwise(F.col("db_stream")).alias("db_stream"), "frame", "direction", "seq", "ack", "tcp_len", "description", grade.alias("evidence_class"), F.when(F.col("source") == "JDBC", "CONFIRMED").otherwise(F.col("evidence_level")).alias("confidence"))
    m = markers.select("timestamp", "event_type", "description").distinct().join(k).where("key_ts IS NOT NULL")
    ping = m.select(F.col("key_id").alias("event_id"), "timestamp", (F.col("timestamp") - F.col("key_ts")).alias("relative_seconds"), F.lit("PING").alias("source"), "event_type", "description", F.lit("SUPPORTING").alias("evidence_class"), F.lit("SUPPORTING").alias("confidence"))
    return collapsed(own.unionByName(ping, allowMissingColumns=True))


def collapsed(rows: DataFrame, by: Sequence[str] = ("event_id",)) -> DataFrame:
    """Runs of one data retransmission as the first row of each, with n_rows and last_timestamp.

    Rows are neighbours in the order of the whole timeline of an event (or case: `by`), so any other
    row between two of a run ends it. Without a sequence number a row stands alone.
    """
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last("timestamp"), "source", "event_type", F.asc_nulls_first("seq"), "tcp_len", "frame")
    like = [F.lag(c).over(order).eqNullSafe(F.col(c)) for c in ("source", "event_type", "seq", "tcp_len", "correlation_id")]
    same = reduce(Column.__and__, like, (F.col("event_type") == "DATA_RETRANSMISSION") & F.col("seq").isNotNull())
    r = rows.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_run", F.count_if(~F.col("_same")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*by, "_run")
    r = r.withColumn("n_rows", F.count(F.lit(1)).over(w)).withColumn("last_timestamp", F.max("timestamp").over(w)).where(~F.col("_same")).drop("_same", "_run")
    return r.withColumn("description", F.when(F.col("n_rows") > 1, F.format_string("Seq=%d Len=%d sent again: %d rows in one", "seq", "tcp_len", "n_rows")).otherwise(F.col("description")))
