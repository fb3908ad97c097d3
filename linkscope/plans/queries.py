"""Queries over the derived views, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import case_evidence
from . import views
from .analyze import Capture

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def single(spark: SparkSession, sf_dir: str) -> Capture:
    return Capture(views.view(spark, sf_dir, "single"), views.DB_PORT)


SYN, ACK, FIN, RST = (f"((tcp_flags & {bit}) <> 0)" for bit in (2, 16, 1, 4))


def pk(name: str = "single", prefix: str = "") -> str:
    return f"{prefix}p AS (SELECT *, tcp_stream AS session_id, CASE WHEN dst_ip = '{views.SERVER_IP}' THEN 'client_to_server' ELSE 'server_to_client' END AS direction FROM ({views.cte(name)}))"


RETX = f"""
r0 AS (
  SELECT session_id, direction, tcp_seq AS seq, tcp_len, payload_sha256, count(*) AS count, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
         list_sort(list(DISTINCT frame_number)) AS frames, min(pkt_ord) AS first_ord,
         arg_min(tcp_seq + tcp_len + CASE WHEN {SYN} THEN 1 ELSE 0 END + CASE WHEN {FIN} THEN 1 ELSE 0 END, pkt_ord) AS expected_ack
  FROM p WHERE tcp_len > 0 OR {SYN} OR {FIN} GROUP BY ALL HAVING count(*) >= 2),
r1 AS (SELECT *, round((last_ts - first_ts) * 1000, 3) AS duration_ms, CASE WHEN tcp_len > 0 THEN 'data' ELSE 'control' END AS plane FROM r0),
r AS (SELECT *, CASE WHEN plane = 'control' THEN CASE WHEN count >= 2 OR duration_ms >= 1000 THEN 'WARNING' ELSE 'INFO' END
                     WHEN count >= 3 AND duration_ms >= 1000 THEN 'HIGH' WHEN count >= 2 THEN 'WARNING' ELSE 'INFO' END AS severity FROM r1)"""
STALL = f"""
s AS (
  SELECT r.session_id, r.direction AS send_direction, r.seq, r.tcp_len, r.payload_sha256, r.expected_ack, coalesce(max(a.tcp_ack), 0) AS observed_ack, r.duration_ms AS stall_duration_ms, r.count AS retransmission_count, r.frames, r.first_ord
  FROM r LEFT JOIN p a ON a.session_id = r.session_id AND a.direction <> r.direction AND {ACK.replace("tcp_flags", "a.tcp_flags")} AND a.timestamp <= r.last_ts
  WHERE r.tcp_len > 0 AND r.duration_ms >= 1000
  GROUP BY ALL HAVING coalesce(max(a.tcp_ack), 0) < r.expected_ack)"""
RESET = f"""
x0 AS (
  SELECT *, bool_or({SYN}) OVER w AS saw_syn, bool_or({FIN}) OVER w AS saw_fin, bool_or(tcp_len > 0 AND NOT {SYN}) OVER w AS saw_data,
         coalesce(lag({ACK} AND NOT {SYN} AND NOT {FIN} AND NOT {RST} AND tcp_len = 0) OVER (PARTITION BY session_id ORDER BY pkt_ord), false) AS after_ack
  FROM p WINDOW w AS (PARTITION BY session_id ORDER BY pkt_ord ROWS UNBOUNDED PRECEDING)),
x AS (
  SELECT session_id, frame_number AS frame, timestamp, direction, pkt_ord,
         CASE WHEN saw_fin THEN 'RST_AFTER_FIN' WHEN after_ack AND saw_data THEN 'ACK_TO_RST' WHEN saw_data THEN 'RST_DURING_DATA' WHEN saw_syn THEN 'RST_AFTER_SYN' ELSE 'RST_OTHER' END AS classification
  FROM x0 WHERE {RST}),
xs AS (SELECT *, CASE classification WHEN 'RST_AFTER_FIN' THEN 'INFO' WHEN 'RST_DURING_DATA' THEN 'HIGH' ELSE 'WARNING' END AS severity FROM x)"""
ZERO = f"""
z0 AS (SELECT *, tcp_window = 0 AND NOT {RST} AND NOT {FIN} AS zero FROM p),
z1 AS (SELECT *, sum(CASE WHEN zero THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY pkt_ord) AS run, lead(timestamp) OVER (PARTITION BY session_id ORDER BY pkt_ord) AS next_ts FROM z0),
z AS (
  SELECT session_id, arg_min(timestamp, pkt_ord) AS start_ts, arg_max(coalesce(next_ts, -1), pkt_ord) AS end0, arg_min(direction, pkt_ord) AS direction, list(frame_number ORDER BY pkt_ord) AS frames, min(pkt_ord) AS first_ord
  FROM z1 WHERE zero GROUP BY session_id, run)"""
SHAKE = f"""
h1 AS (SELECT *, min(CASE WHEN {SYN} AND NOT {ACK} THEN pkt_ord END) OVER (PARTITION BY session_id) AS o1 FROM p),
h2 AS (SELECT *, min(CASE WHEN {SYN} AND {ACK} AND pkt_ord > o1 THEN pkt_ord END) OVER (PARTITION BY session_id) AS o2 FROM h1),
h3 AS (SELECT *, min(CASE WHEN {ACK} AND NOT {SYN} AND NOT {RST} AND pkt_ord > o2 THEN pkt_ord END) OVER (PARTITION BY session_id) AS o3 FROM h2),
h AS (
  SELECT session_id, max(CASE WHEN pkt_ord = o1 THEN timestamp END) AS syn_ts, max(CASE WHEN pkt_ord = o2 THEN timestamp END) AS synack_ts, max(CASE WHEN pkt_ord = o3 THEN timestamp END) AS ack_ts,
         count(*) FILTER ({SYN} AND NOT {ACK} AND pkt_ord > o1) AS syn_retransmissions FROM h3 GROUP BY session_id)"""
SESSION = f"""
f AS (SELECT session_id, min(pkt_ord) AS session_ord, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS packet_count, bool_or({RST}) AS rst_seen, bool_or({FIN}) AS fin_seen,
             arg_min(CASE WHEN direction = 'client_to_server' THEN src_ip ELSE dst_ip END, pkt_ord) AS client_ip, arg_min(CASE WHEN direction = 'client_to_server' THEN src_port ELSE dst_port END, pkt_ord) AS client_port,
             '{views.SERVER_IP}' AS server_ip, {views.DB_PORT} AS server_port
      FROM p GROUP BY session_id)"""
SUMMARY = """
sm AS (
  SELECT f.*, c.client_packets, c.server_packets, c.payload_bytes, coalesce(ra.n, 0) AS retransmissions, coalesce(za.n, 0) AS zero_window, round((h.synack_ts - h.syn_ts) * 1000, 3) AS handshake_latency_ms, xa.rst_class,
         CASE WHEN coalesce(ra.high, false) OR sa.session_id IS NOT NULL OR coalesce(xa.high, false) OR coalesce(za.n, 0) >= 5 THEN 'HIGH' WHEN coalesce(ra.n, 0) > 0 OR coalesce(za.n, 0) >= 1 THEN 'WARNING' ELSE 'INFO' END AS severity
  FROM f JOIN h USING (session_id)
  JOIN (SELECT session_id, count(*) FILTER (direction = 'client_to_server') AS client_packets, count(*) FILTER (direction = 'server_to_client') AS server_packets, sum(tcp_len)::BIGINT AS payload_bytes FROM p GROUP BY ALL) c USING (session_id)
  LEFT JOIN (SELECT session_id, sum(count - 1)::BIGINT AS n, bool_or(severity = 'HIGH' AND plane = 'data') AS high FROM r GROUP BY ALL) ra USING (session_id)
  LEFT JOIN (SELECT DISTINCT session_id FROM s) sa USING (session_id)
  LEFT JOIN (SELECT session_id, arg_min(classification, pkt_ord) AS rst_class, bool_or(severity = 'HIGH') AS high FROM xs GROUP BY ALL) xa USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS n FROM z GROUP BY ALL) za USING (session_id))"""
ANOMALY = """
an AS (
  SELECT NULL::BIGINT AS session_id, 'PACKET_TRUNCATED' AS type, 'WARNING' AS severity, 'PACKET_TRUNCATED: ' || count(*) || ' packets' AS summary, list(frame_number ORDER BY pkt_ord)[1:50] AS frames, NULL::BIGINT AS seq, NULL::INT AS len, -1 AS ord FROM p WHERE cap_len < frame_len HAVING count(*) > 0
  UNION ALL SELECT session_id, 'HANDSHAKE_INCOMPLETE', 'INFO', 'The capture holds no SYN: latency of the handshake unknown', [], NULL, NULL, 0 FROM h WHERE syn_ts IS NULL
  UNION ALL SELECT session_id, upper(plane) || '_RETRANSMISSION', severity, upper(plane) || '_RETRANSMISSION x' || count || ' Seq=' || seq || ' Len=' || tcp_len, frames, seq, tcp_len, first_ord FROM r
  UNION ALL SELECT session_id, 'ACK_STALLED', 'HIGH', 'Not acknowledged: ' || expected_ack || ' expected, ' || observed_ack || ' at most seen', frames, seq, tcp_len, first_ord FROM s
  UNION ALL SELECT session_id, classification, severity, classification || ' @ frame ' || frame, [frame], NULL, NULL, pkt_ord FROM xs
  UNION ALL SELECT session_id, 'ZERO_WINDOW', CASE WHEN count(*) OVER (PARTITION BY session_id) >= 5 THEN 'HIGH' ELSE 'WARNING' END, 'Zero Window (' || direction || ')', frames, NULL, NULL, first_ord FROM z
  UNION ALL SELECT NULL, 'MULTI_STREAM_RETRANSMISSION', 'HIGH', 'Persistent retransmissions in ' || count(DISTINCT session_id) || ' streams', [], NULL, NULL, NULL FROM r WHERE severity = 'HIGH' AND plane = 'data' HAVING count(DISTINCT session_id) >= 2)"""
EVERYTHING = "WITH " + ", ".join([pk(), RETX, STALL, RESET, ZERO, SHAKE, SESSION, SUMMARY, ANOMALY])


@query(f"WITH {pk()}, {SESSION} SELECT session_id, client_ip, client_port, server_ip, server_port, start_time, end_time, packet_count, rst_seen, fin_seen FROM f")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).sessions.drop("capture_id", "session_ord")


@query(f"WITH {pk()}, {SHAKE} SELECT session_id, syn_ts, synack_ts, ack_ts, syn_retransmissions, ack_ts IS NOT NULL AS complete, round((synack_ts - syn_ts) * 1000, 3) AS latency_ms FROM h")
def handshake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).handshakes.drop("capture_id")


@query(f"WITH {pk()}, {RETX} SELECT session_id, direction, seq, tcp_len, payload_sha256, count, first_ts, last_ts, duration_ms, array_to_string(frames, ',') AS frames, expected_ack, plane, severity FROM r")
def retransmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).retransmissions.select("session_id", "direction", "seq", "tcp_len", "payload_sha256", "count", "first_ts", "last_ts", "duration_ms", F.array_join("frames", ",").alias("frames"), "expected_ack", "plane", "severity")


@query(f"WITH {pk()}, {RETX}, {STALL} SELECT session_id, send_direction, seq, tcp_len, expected_ack, observed_ack, stall_duration_ms, retransmission_count, array_to_string(frames, ',') AS frames FROM s")
def ack_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).ack_stalls.select("session_id", "send_direction", "seq", "tcp_len", "expected_ack", "observed_ack", "stall_duration_ms", "retransmission_count", F.array_join("frames", ",").alias("frames"))


@query(f"WITH {pk()}, {RESET} SELECT session_id, frame, timestamp, direction, classification, severity FROM xs")
def rst_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).resets.select("session_id", "frame", "timestamp", "direction", "classification", "severity")


@query(f"WITH {pk()}, {ZERO} SELECT session_id, start_ts, nullif(end0, -1) AS end_ts, direction, array_to_string(frames, ',') AS frames, round((nullif(end0, -1) - start_ts) * 1000, 3) AS duration_ms FROM z")
def zero_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).zero_windows.select("session_id", "start_ts", "end_ts", "direction", F.array_join("frames", ",").alias("frames"), "duration_ms")


@query(f"""WITH {pk()}, m AS (SELECT cap_len, count(*) AS n, min(pkt_ord) AS o FROM p GROUP BY cap_len), t AS (SELECT arg_max(cap_len, n * 1e9 - o) AS common_cap_len FROM m),
q AS (SELECT count(*) AS total_packets, count(*) FILTER (cap_len < frame_len) AS truncated_packets FROM p)
SELECT total_packets, truncated_packets, round(truncated_packets / total_packets, 4) AS truncated_ratio, common_cap_len, common_cap_len = 128 AS snaplen_128_hint,
       CASE WHEN truncated_packets / total_packets >= 0.3 THEN 'LOW' WHEN truncated_packets > 0 THEN 'DEGRADED' ELSE 'HIGH' END AS credibility FROM q, t""")
def capture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).quality.drop("capture_id", "file_cut_short")


@query(f"WITH {', '.join([pk(), RETX, STALL, RESET, ZERO, SHAKE, SESSION, SUMMARY])} SELECT session_id, client_ip, client_port, server_ip, server_port, start_time, end_time, end_time - start_time AS duration, packet_count, client_packets, server_packets, payload_bytes, retransmissions, rst_seen, fin_seen, zero_window, handshake_latency_ms, rst_class, severity FROM sm")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).summaries.drop("capture_id", "session_ord")


@query(f"WITH {pk()}, {RETX} SELECT count(DISTINCT session_id) AS high_streams, count(*) AS high_segments FROM r WHERE severity = 'HIGH' AND plane = 'data'")
def multi_stream_retx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).retransmissions.where("severity = 'HIGH' AND plane = 'data'").agg(F.countDistinct("session_id").alias("high_streams"), F.count(F.lit(1)).alias("high_segments"))


@query(f"{EVERYTHING} SELECT session_id, type, severity, summary, array_to_string(frames, ',') AS frames, seq, len AS tcp_len FROM an")
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).anomalies.select("session_id", "type", "severity", "summary", F.array_join("frames", ",").alias("frames"), "seq", "tcp_len")


@query(f"""{EVERYTHING}, u AS (SELECT session_id, type, severity, seq, len, unnest(frames) AS frame_number FROM an WHERE session_id IS NOT NULL)
SELECT u.session_id, type, severity, frame_number, p.timestamp, p.direction, p.tcp_seq, p.tcp_ack, p.tcp_len FROM u JOIN p USING (session_id, frame_number) WHERE u.seq IS NULL OR (u.seq = p.tcp_seq AND u.len = p.tcp_len)""")
def frame_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).evidence.select("session_id", "type", "severity", "frame_number", "timestamp", "direction", "tcp_seq", "tcp_ack", "tcp_len")


@query(f"""{EVERYTHING}, q AS (SELECT count(*) FILTER (cap_len < frame_len) AS n, count(*) AS total FROM p), c AS (SELECT CASE WHEN n / total >= 0.3 THEN 'LOW' WHEN n > 0 THEN 'DEGRADED' ELSE 'HIGH' END AS credibility FROM q),
k AS (SELECT (SELECT max(CASE severity WHEN 'HIGH' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) FROM sm) AS a, (SELECT max(CASE severity WHEN 'HIGH' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) FROM an WHERE type <> 'PACKET_TRUNCATED') AS b)
SELECT (SELECT count(*) FROM sm) AS sessions, (SELECT sum(packet_count)::BIGINT FROM sm) AS packets, (SELECT sum(retransmissions)::BIGINT FROM sm) AS retransmissions, (SELECT count(*) FROM an WHERE severity = 'HIGH') AS high_count,
       (SELECT count(*) FROM an WHERE severity = 'WARNING') AS warning_count, (SELECT count(*) FROM an WHERE severity = 'INFO') AS info_count,
       ['INFO', 'WARNING', 'HIGH'][greatest(a, b) + 1] AS tcp_health, CASE WHEN greatest(a, b) > 0 THEN ['INFO', 'WARNING', 'HIGH'][greatest(a, b) + 1] WHEN credibility <> 'HIGH' THEN 'WARNING' ELSE 'INFO' END AS analysis_status,
       CASE credibility WHEN 'LOW' THEN 'LOW' WHEN 'DEGRADED' THEN 'DEGRADED' ELSE 'OK' END AS confidence, CASE credibility WHEN 'LOW' THEN 'BLOCKING' WHEN 'DEGRADED' THEN 'DEGRADED' ELSE 'OK' END AS input_quality FROM k, c""")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).rollup.drop("capture_id")


@query(f"""{EVERYTHING}, q AS (SELECT count(*) FILTER (cap_len < frame_len) AS n, count(*) AS all_ FROM p), k AS (
  SELECT count(*) FILTER (severity = 'HIGH' AND type <> 'PACKET_TRUNCATED') AS hi, count(*) FILTER (severity = 'WARNING' AND type <> 'PACKET_TRUNCATED') AS wa, count(*) FILTER (type = 'PACKET_TRUNCATED') AS cut FROM an),
gr AS (SELECT *, CASE WHEN type = 'PACKET_TRUNCATED' THEN 2 WHEN severity = 'HIGH' THEN 0 WHEN severity = 'WARNING' THEN 1 ELSE 3 END AS grade FROM an),
nf AS (SELECT summary, row_number() OVER (ORDER BY session_id NULLS FIRST, ord NULLS FIRST, type, seq NULLS FIRST, len NULLS FIRST, summary) AS no FROM gr),
nc AS (SELECT summary, row_number() OVER (ORDER BY grade, session_id NULLS FIRST, ord NULLS FIRST, type, seq NULLS FIRST, len NULLS FIRST, summary) AS no FROM gr WHERE grade < 3)
SELECT CASE WHEN hi > 0 THEN 'HIGH_TCP_ANOMALY' WHEN wa > 0 THEN 'TCP_ATTENTION' WHEN cut > 0 OR n > 0 THEN 'CAPTURE_QUALITY_ONLY' ELSE 'NOTHING_OBSERVED' END AS verdict, CASE WHEN hi > 0 THEN 'red' WHEN wa > 0 OR cut > 0 OR n > 0 THEN 'yellow' ELSE 'green' END AS color,
       CASE WHEN hi > 0 THEN 'HIGH' WHEN wa > 0 THEN 'WARNING' ELSE 'INFO' END AS tcp_health, n > 0 AS may_be_incomplete,
       coalesce((SELECT string_agg(summary, '; ' ORDER BY no) FROM nf WHERE no <= 20), '') AS findings,
       concat_ws('; ', CASE WHEN n > 0 THEN 'capture quality: ' || n || ' of ' || all_ || ' packets truncated, credibility ' || CASE WHEN n / all_ >= 0.3 THEN 'LOW' ELSE 'DEGRADED' END END, (SELECT string_agg(summary, '; ' ORDER BY no) FROM nc WHERE no <= 20)) AS concerns
FROM k, q""")
def conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).conclusion.select("verdict", "color", "tcp_health", "may_be_incomplete", *[F.array_join(c, "; ").alias(c) for c in ("findings", "concerns")])


@query(f"""WITH {pk()}, {SESSION} SELECT asked, count(*) AS sessions, count(*) FILTER (server_ip IS DISTINCT FROM asked) AS mismatched FROM f, (SELECT unnest(['{views.SERVER_IP}', '10.9.0.2']) AS asked) GROUP BY asked""")
def server_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = single(spark, sf_dir).sessions
    each = [case_evidence.server_mismatch(s, ip).select(F.lit(ip).alias("asked"), "sessions", "mismatched") for ip in (views.SERVER_IP, "10.9.0.2")]
    return each[0].union(each[1])
