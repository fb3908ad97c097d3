"""Evidence classes, conclusions and collapsed runs on small tables."""

from pyspark.sql import functions as F

from linkscope.operators import case_evidence, timeline

ROWS = "event_id string, timestamp double, source string, event_type string, seq long, tcp_len int, frame long, correlation_id string, description string"


def test_other_rows_end_a_run(spark):
    again = lambda t, seq=5: ("E1", t, "APP_PCAP", "DATA_RETRANSMISSION", seq, 10, int(t * 10), "CF1", "x")
    rows = [again(1.0), ("E1", 1.5, "DB_PCAP", "FIN", None, None, 1, "CF1", "y"), again(2.0), again(3.0), again(4.0, None), again(5.0, None), ("E2", 2.5, "APP_PCAP", "FIN", None, None, 1, None, "z")]
    got = timeline.collapsed(spark.createDataFrame(rows, ROWS)).orderBy("event_id", "timestamp").collect()
    assert [(r.event_id, r.timestamp, r.n_rows, r.last_timestamp) for r in got] == [("E1", 1.0, 1, 1.0), ("E1", 1.5, 1, 1.5), ("E1", 2.0, 2, 3.0), ("E1", 4.0, 1, 4.0), ("E1", 5.0, 1, 5.0), ("E2", 2.5, 1, 2.5)]
    assert got[0].description == "x" and got[2].description == "Seq=5 Len=10 sent again: 2 rows in one"


FOUND = "capture_id string, session_id long, type string, severity string, summary string, first_ord long, seq long, tcp_len int"
QUALITY = "capture_id string, total_packets long, truncated_packets long, credibility string, file_cut_short boolean"


def test_conclusion(spark):
    found = [("a", 1, "ACK_STALLED", "HIGH", f"s{n:02}", n, n, 1) for n in range(25)] + [("b", None, "PACKET_TRUNCATED", "WARNING", "cut", -1, None, None), ("b", 2, "HANDSHAKE_INCOMPLETE", "INFO", "no SYN", 0, None, None), ("d", 3, "ZERO_WINDOW", "WARNING", "zero", 1, None, None)]
    quality = [("a", 50, 0, "HIGH", False), ("b", 9, 3, "LOW", False), ("c", 9, 0, "HIGH", False), ("d", 9, 0, "HIGH", True)]
    got = {r.capture_id: r for r in case_evidence.conclusion(spark.createDataFrame(found, FOUND), spark.createDataFrame(quality, QUALITY)).collect()}
    assert [(k, got[k].verdict, got[k].color, got[k].tcp_health) for k in "abcd"] == [("a", "HIGH_TCP_ANOMALY", "red", "HIGH"), ("b", "CAPTURE_QUALITY_ONLY", "yellow", "INFO"), ("c", "NOTHING_OBSERVED", "green", "INFO"), ("d", "TCP_ATTENTION", "yellow", "WARNING")]
    assert got["a"].findings == got["a"].concerns == [f"s{n:02}" for n in range(20)]
    assert got["b"].findings == ["cut", "no SYN"] and got["b"].concerns == ["capture quality: 3 of 9 packets truncated, credibility LOW", "cut"]
    assert got["c"].findings == got["c"].concerns == [] and got["d"].concerns[0].endswith("file cut short")


def inputs(spark, status):
    key = spark.createDataFrame([("E1", 9.0)], "event_id string, timestamp double")
    events = spark.createDataFrame([("E1", 9.0, None, "CONNECTION_RESET", None, None, "java.net.SocketException", "Connection reset", 3, 5), ("E2", 1.0, None, "BROKEN_PIPE", None, None, None, None, 6, 7)], "event_id string, timestamp double, timestamp_raw string, event_type string, exception_class string, message string, caused_by_class string, caused_by_message string, start_line int, end_line int")
    flow = "correlation_id string, app_stream long, db_stream long, client_ip string, client_port int, server_ip string, server_port int"
    way = lambda n: (f"CF{n}", n, n + 100, "10.0.0.1", 40000 + n, "10.9.0.1", 5236)
    chosen = spark.createDataFrame([("E1", status, "STRONG", 6, *way(0))], f"event_id string, correlation_status string, evidence_level string, candidate_count long, {flow}")
    ranked = spark.createDataFrame([("E1", n + 1, 90.0 - 3 * n, *way(n)) for n in range(6)], f"event_id string, rank int, total_score double, {flow}")
    rows = [("E1", 8.0 + n / 100, -1.0 + n / 100, "APP", "MATCHED_SEGMENT", f"segment {n}", "CONFIRMED", "CF0") for n in range(60)] + [("E1", 8.0, -1.0, "APP", "SYN", "no", "CONFIRMED", "CF0"), ("E2", 8.0, -1.0, "APP", "FIN", "no", "CONFIRMED", "CF0")]
    entries = spark.createDataFrame(rows, "event_id string, timestamp double, relative_seconds double, side string, event_type string, description string, evidence_level string, correlation_id string")
    qualities = {side: spark.createDataFrame([(side, 9, n, "HIGH", False)], QUALITY) for n, side in enumerate(("APP", "DB"))}
    return key, events, chosen, ranked, entries, qualities


def kinds(items):
    got = {}
    for r in items.orderBy("evidence_class", "item").collect():
        got.setdefault(r.evidence_class, []).append(r.kind)
    return got


def test_evidence_of_an_ambiguous_event_without_ping(spark):
    items = case_evidence.evidence(*inputs(spark, "AMBIGUOUS"), None)
    got = kinds(items)
    assert got["CONFIRMED_FACTS"] == ["LOGGED_EVENT", "APP_CAPTURE", "DB_CAPTURE"]
    assert got["CORRELATED_EVIDENCE"] == ["FIRST_CANDIDATE", *["NEAR_TIE"] * 3, *["MATCHED_SEGMENT"] * 36]
    assert got["UNKNOWN"] == ["NO_UNIQUE_FLOW", "NO_PING", *["CAVEAT"] * 3] and "SUPPORTING_EVIDENCE" not in got
    assert items.where("item = 1 AND kind = 'LOGGED_EVENT'").first().description == "Logged CONNECTION_RESET at 9.0 (java.net.SocketException: Connection reset), lines 3 to 5"


def test_evidence_of_a_matched_event_with_ping(spark):
    pings = spark.createDataFrame([("E1", 4, 3, 1, 0, 0.5, 0.75, None)], "event_id string, samples long, replies long, timeouts long, unreachable long, min_rtt_ms double, max_rtt_ms double, target_host string")
    items = case_evidence.evidence(*inputs(spark, "MATCHED"), pings)
    got = kinds(items)
    assert got["CONFIRMED_FACTS"] == ["LOGGED_EVENT", "APP_CAPTURE", "DB_CAPTURE", "SELECTED_FLOW", "PING_COUNTS"]
    assert got["CORRELATED_EVIDENCE"] == ["MATCHED_SEGMENT"] * 40 and got["SUPPORTING_EVIDENCE"] == ["PING_SUMMARY", "PING_CAUTION"] and got["UNKNOWN"] == ["CAVEAT"] * 3
    assert "3 replies, 1 timeouts" in items.where("kind = 'PING_SUMMARY'").first().description


def test_no_event_gives_no_evidence(spark):
    key, *rest = inputs(spark, "MATCHED")
    assert case_evidence.evidence(key.withColumn("event_id", F.lit(None).cast("string")), *rest, None).count() == 0


def test_server_mismatch_and_stalls(spark):
    s = spark.createDataFrame([("a", "10.9.0.1"), ("a", "10.9.0.2"), ("a", None)], "capture_id string, server_ip string")
    assert case_evidence.server_mismatch(s, "10.9.0.1").collect() == [("a", 3, 2)]
    stall = spark.createDataFrame([("server_to_client", 124, 5810, 11, 3208.926, 5934, 5810)], "send_direction string, tcp_len int, seq long, retransmission_count long, stall_duration_ms double, expected_ack long, observed_ack long")
    assert case_evidence.explained(stall).first().explanation.startswith("The database sent the same 124 bytes (Seq=5810) 11 times over 3208.9 ms; the application")
