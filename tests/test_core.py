"""Hand-built packets and logs with known findings, and randomized checks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from linkscope.functions import logtext, packets as P
from linkscope.operators import correlate, detectors, dual, grouping, ping, sessions
from linkscope.plans.analyze import Capture, prepared
from linkscope.schemas import PACKETS
from linkscope.sources import discover, fieldtext, logs

SYN, SYNACK, ACK, PSH, FIN, RST = 0x02, 0x12, 0x10, 0x18, 0x11, 0x04
APP, DB = ("10.0.0.1", 40000), ("10.0.0.2", 5236)


def packet(n, ts, flags, to_db=True, seq=1, ack=1, length=0, window=65535, stream=0, payload="", cap=None, capture="c"):
    (sip, sp), (dip, dp) = (APP, DB) if to_db else (DB, APP)
    return (capture, n, float(ts), sip, dip, sp, dp, flags, seq, ack, window, length, n, stream, 54 + length, 54 + length if cap is None else cap, payload)


def capture(spark, rows):
    return Capture(prepared(spark.createDataFrame(rows, PACKETS)), 5236)


def test_handshake(spark):
    c = capture(spark, [packet(1, 1.0, SYN), packet(2, 1.05, SYNACK, False), packet(3, 1.06, ACK)])
    h = c.handshakes.first()
    assert h.complete and h.latency_ms == 50.0
    s = c.sessions.first()
    assert (s.client_ip, s.client_port, s.server_ip, s.server_port) == (*APP, *DB)


def test_stalled_acknowledgement(spark):
    rows = [packet(n, 10 + n, PSH, False, 5810, 1, 124, payload="aa") for n in range(3)] + [packet(3, 11, ACK, True, 1, 5810), packet(4, 30, ACK, True, 1, 5934)]
    c = capture(spark, rows)
    s = c.ack_stalls.collect()
    assert [(x.expected_ack, x.observed_ack, x.retransmission_count) for x in s] == [(5934, 5810, 3)]
    r = c.retransmissions.first()
    assert (r.severity, r.plane, r.duration_ms) == ("HIGH", "data", 2000.0)
    assert "ACK_STALLED" in {a.type for a in c.anomalies.collect()}
    assert c.evidence.where("type = 'ACK_STALLED'").count() == 3


def test_control_retransmissions_never_rank_high(spark):
    c = capture(spark, [packet(n, n * 1.1, SYN) for n in range(4)])
    r = c.retransmissions.first()
    assert (r.plane, r.severity, c.ack_stalls.count()) == ("control", "WARNING", 0)


def test_reset_classes(spark):
    rows = [packet(1, 1, SYN, stream=1), packet(2, 2, RST, False, stream=1)]
    rows += [packet(3, 1, PSH, length=3, stream=2), packet(4, 2, RST, stream=2)]
    rows += [packet(5, 1, PSH, length=3, stream=3), packet(6, 2, ACK, False, stream=3), packet(7, 3, RST, stream=3)]
    rows += [packet(8, 1, FIN, stream=4), packet(9, 2, RST, stream=4)]
    got = {r.session_id: (r.classification, r.severity) for r in capture(spark, rows).resets.collect()}
    assert got == {1: ("RST_AFTER_SYN", "WARNING"), 2: ("RST_DURING_DATA", "HIGH"), 3: ("ACK_TO_RST", "WARNING"), 4: ("RST_AFTER_FIN", "INFO")}


def test_zero_window_and_quality(spark):
    c = capture(spark, [packet(1, 1.0, ACK, window=0), packet(2, 1.5, ACK, window=0), packet(3, 2.0, ACK, window=1000)])
    z = c.zero_windows.collect()
    assert [(x.duration_ms, x.frames) for x in z] == [(1000.0, [1, 2])]
    q = capture(spark, [packet(n, n, PSH, length=1446, cap=128 if n < 2 else None) for n in range(3)]).quality.first()
    assert (q.truncated_packets, q.common_cap_len, q.snaplen_128_hint, q.credibility) == (2, 128, True, "LOW")


def test_truncation_is_not_tcp_health(spark):
    r = capture(spark, [packet(n, n, ACK, cap=20) for n in range(20)]).rollup.first()
    assert (r.tcp_health, r.analysis_status, r.input_quality) == ("INFO", "WARNING", "BLOCKING")


def test_sessions_without_stream(spark):
    rows = [packet(1, 1, ACK, stream=None), packet(2, 2, ACK, False, stream=None), packet(3, 3, ACK, stream=7)]
    assert {(r.session_id, r.packet_count) for r in capture(spark, rows).sessions.collect()} == {(-1, 2), (7, 1)}


def test_greedy_flows_equal_a_loop(spark):
    r = random.Random(4)
    make = lambda base: [("10.0.0.%d" % r.randint(1, 3), 40000, *DB, base + n, n, float(s := r.randint(0, 900)), float(s + r.choice([0, 5, 300])), r.choice([None, 0, 5, 6])) for n in range(25)]
    kind = "client_ip string, client_port int, server_ip string, server_port int, session_id long, session_ord long, start_time double, end_time double, syn_seq long"
    a, d = make(0), make(100)
    got = dual.match_flows(spark.createDataFrame(a, kind), spark.createDataFrame(d, kind)).collect()
    want = []
    for key in sorted({x[:4] for x in a}):
        pairs = []
        for x in (x for x in a if x[:4] == key):
            for y in (y for y in d if y[:4] == key):
                if x[8] and y[8] and x[8] != y[8]:
                    continue
                ov = max(0.0, min(x[7], y[7]) - max(x[6], y[6]))
                gap = abs(x[6] - y[6])
                if ov > 0 or gap <= 600:
                    pairs.append((-(ov if ov > 0 else 1 / (1 + gap)), x[5], y[5], x[4], y[4]))
        used = set()
        for _, _, _, x, y in sorted(pairs):
            if not {x, y} & used:
                used |= {x, y}
                want.append((x, y))
    assert [(g.app_stream, g.db_stream) for g in sorted(got, key=lambda g: g.correlation_id)] == want


def test_event_groups_equal_a_loop(spark):
    r = random.Random(9)
    rows = [("f", n + 1, None if r.random() < 0.1 else float(r.randint(0, 60)), r.choice("AB")) for n in range(200)]
    df = spark.createDataFrame(rows, "source_file string, event_ord long, timestamp double, event_type string").withColumns({c: F.lit("x") for c in ("thread_name", "message", "caused_by_message", "connection_hint")})
    groups, order = {}, []
    want = {}
    for _, n, t, kind in rows:
        for g in reversed(order):
            k, first, last = groups[g]
            if k == kind and t is not None and first is not None and abs(t - first) <= 3 and abs(t - last) <= 3:
                groups[g] = (k, first, t)
                break
        else:
            g = f"JG{len(order) + 1:04d}"
            order.append(g)
            groups[g] = (kind, t, t)
        want[n] = g
    assert {x.event_ord: x.group_id for x in grouping.assign_groups(df).collect()} == want


LOG = """[ERROR - 2031-03-07 22:14:05] tid:88 - [orders-7] { lease-3 } commit();  [USED TIME]: 412ms;
acme.db.LinkException: statement lost
\tat acme.db.Link.send(Link.java:77)
Caused by: java.net.SocketException: Connection reset
[INFO - 2031-03-07 22:14:06] tid:88 - [orders-7] { lease-3 } retired;
try connect success [172.20.5.6:5432] password=sesame
[ERROR - 2031-03-07 22:15:40] tid:91 - [orders-7] {} select
java.sql.SQLException: no such column
[WARN - 2031-03-07 22:16:00] tid:91 - [orders-7] {} slow
"""


def test_jdbc_log(spark, tmp_path):
    (tmp_path / "x.log").write_text(LOG, encoding="utf-8")
    e = logs.parse_jdbc(logs.read_lines(spark, str(tmp_path / "x.log"))).collect()
    assert [(x.event_id, x.event_type, x.start_line, x.end_line, x.used_time_ms, x.database_host, x.database_port) for x in e] == [("JE0001", "CONNECTION_RESET", 1, 4, 412.0, "172.20.5.6", 5432)]
    assert e[0].stack_summary == "acme.db.LinkException: statement lost | at acme.db.Link.send(Link.java:77) | Caused by: java.net.SocketException: Connection reset"


@pytest.mark.parametrize("cls,message,kind", [("java.net.SocketException", "Connection reset", "CONNECTION_RESET"), ("a.ConnectException", "No connection: actively refused", "CONNECTION_REFUSED"), ("a.SocketTimeoutException", "connect timed out", "CONNECT_TIMEOUT"), ("a.SocketTimeoutException", "Read timed out", "READ_TIMEOUT"),
                                              ("java.net.SocketTimeoutException", "timeout waiting", "SOCKET_TIMEOUT"), ("a.IOException", "Broken pipe", "BROKEN_PIPE"), ("a.SQLException", "Connection is closed", "CONNECTION_CLOSED"), ("a.X", "I/O error writing request", "UNKNOWN_NETWORK_ERROR"), ("a.SQLException", "no such column", "NOT_NETWORK"), ("a.SocketTimeoutException", "gave up on the socket, timed out", "SOCKET_TIMEOUT"), ("a.X", "socket read: timed out", "READ_TIMEOUT"), ("a.X", "connection closed successfully", "NOT_NETWORK"), ("a.DMException", "io fault", "UNKNOWN_NETWORK_ERROR"), ("a.X", "could not connect, timed out", "CONNECT_TIMEOUT")])
def test_classification(spark, cls, message, kind):
    df = spark.createDataFrame([(cls, message, None, None)], "a string, b string, c string, d string")
    assert df.select(logtext.classify("a", "b", "c", "d")).first()[0] == kind


def test_ping_log(spark):
    text = ["[2031-03-07 21:00:00.125] ===== Ping monitor started: 172.20.5.6 =====", "[2031-03-07 21:00:01.130] 64 bytes from 172.20.5.6: icmp_seq=40 ttl=57 time=3.25 ms", "[2031-03-07 21:00:09.500] no answer yet for icmp_seq=48", "[2031-03-07 21:01:00.000] Reply from 172.20.0.1: Destination host unreachable.", "cut off"]
    s = logs.parse_ping(spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(text)], "source_file string, line_no int, value string")).orderBy("source_line").collect()
    assert [(x.status, x.target_host, x.rtt_ms, x.ttl, x.icmp_seq) for x in s] == [("REPLY", "172.20.5.6", 3.25, 57, 40), ("TIMEOUT", "172.20.5.6", None, None, 48), ("UNREACHABLE", "172.20.5.6", None, None, None)]


def test_redaction_and_payload_hash(spark):
    df = spark.createDataFrame([("password=abc; access_token: xyz Authorization: Bearer q",)], "x string")
    assert df.select(logtext.redact("x")).first()[0] == "password=***; access_token:*** Authorization: Bearer ***"
    import hashlib

    got = spark.createDataFrame([("6162",), ("abc",), (None,), ("zz",)], "payload_hex string").select(P.payload_sha256()).collect()
    assert [r[0] for r in got] == [hashlib.sha256(b).hexdigest() for b in (b"ab", b"abc", b"", b"zz")]


def test_field_text(spark):
    rows = ["1|1.5|60|60|10.0.0.1|10.0.0.2|1|5236|0|0x0018|5||||aa:bb|1||0||", "x|1.5|60|60|a|b|1|2|0|0x2|5|||||||||", "2||60|60|a|b|1|2|0|0x2|5|||||||||", "|2|||||7|8||2|9|||||||||"]
    got = fieldtext.parse(spark.createDataFrame([("c", i, r) for i, r in enumerate(rows)], "capture_id string, line_no long, value string")).orderBy("pkt_ord").collect()
    assert [(g.tcp_flags, g.tcp_seq, g.tcp_ack, g.payload_hex, g.ws_retransmission, g.src_ip) for g in got] == [(24, 5, 0, "aabb", True, "10.0.0.1"), (2, 9, 0, "", False, "")]


def test_ping_never_ranks_and_two_candidates_are_ambiguous(spark):
    flows = spark.createDataFrame([("CF0001", "a", 1, *DB, 1, 11, 0.0, 100.0), ("CF0002", "a", 2, *DB, 2, 12, 0.0, 100.0), ("CF0003", "a", 3, "10.9.9.9", 1, 3, 13, 0.0, 100.0), ("CF0004", "a", 4, *DB, 4, 14, 0.0, 20.0)],
                                  "correlation_id string, client_ip string, client_port int, server_ip string, server_port int, app_stream long, db_stream long, app_start double, app_end double")
    events = spark.createDataFrame([("E1", 50.0, *DB), ("E2", 23.0, *DB), ("E3", 9000.0, *DB)], "event_id string, timestamp double, database_host string, database_port int")
    pk = spark.createDataFrame([(1, 1, 49.0, 1), (2, 2, 41.0, 2)], "session_id long, pkt_ord long, timestamp double, frame_number long")
    found = spark.createDataFrame([(2, "ZERO_WINDOW")], "session_id long, type string")
    c = correlate.candidates(events, flows, pk, found)
    got = {r.event_id: r for r in correlate.correlate(events, c, correlate.accounting(events, flows)).collect()}
    assert (got["E1"].correlation_status, got["E1"].correlation_id, got["E1"].filtered_endpoint, got["E1"].filtered_time) == ("AMBIGUOUS", "CF0001", 1, 1)
    assert got["E2"].eligible_count == 3  # ended 3 s before: within the grace
    assert (got["E3"].correlation_status, got["E3"].filtered_time) == ("NO_MATCH", 3)


def test_ping_statistics(spark):
    e = spark.createDataFrame([("E1", 100.0)], "event_id string, timestamp double")
    s = spark.createDataFrame([(95.0, "h", "REPLY", 1.0, 1), (99.0, "h", "TIMEOUT", None, 2), (101.0, "h", "TIMEOUT", None, 3), (103.0, "h", "REPLY", 3.0, 4), (500.0, "h", "REPLY", 9.0, 5)], "timestamp double, target_host string, status string, rtt_ms double, source_line int")
    r = ping.statistics(e, s).first()
    assert (r.samples, r.replies, r.timeouts, r.last_reply_before, r.first_reply_after, r.nearest_timeout_before, r.nearest_timeout_after) == (4, 2, 2, 95.0, 103.0, 99.0, 101.0)
    m = {(x.event_type, x.timestamp) for x in ping.markers(e, s).collect()}
    assert m == {("PING_TIMEOUT", 99.0), ("PING_RECOVERY", 103.0)}


def test_discovery(tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "app.txt").write_text("|".join("1" * 20))
    (tmp_path / "noise.bin").write_bytes(b"zz")
    d = discover.discover(str(tmp_path))
    assert (d["status"], d["missing"]) == ("MISSING_INPUT", ["second capture"])
    (tmp_path / "db.txt").write_text("|".join("1" * 20))
    assert discover.discover(str(tmp_path))["status"] == "READY"
