"""Readers of files that are cut into many splits, against the whole file."""

import re

import pytest

from linkscope.sources import fieldtext, lines, logs


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_lines_of_many_splits_keep_their_numbers(spark, tmp_path, small_splits):
    texts = {"a.txt": "".join(f"line {k} é{'x' * (k % 40)}" + ("\r\n" if k % 3 else "\n") for k in range(200)) + "\n\nlast", "b.txt": "one\x0btwo three\nfour", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    df = lines.numbered(spark, str(tmp_path), more_ends=logs.MORE_ENDS)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = sorted((r.source_file.rsplit("/", 1)[-1], r.line_no, r.value) for r in df.collect())
    assert got == sorted((name, n + 1, x) for name, text in texts.items() for n, x in enumerate(text.splitlines()))


def log(n):
    out = []
    for k in range(n):
        out.append(f"[{'ERROR' if k % 3 else 'INFO'} - 2031-03-07 22:{k // 60 % 60:02}:{k % 60:02}] tid:{k} - [pool-{k % 4}] {{ c-{k} }} run; host=172.20.5.{k % 9}:5432 [USED TIME]: {k}ms;")
        out += ["acme.db.LinkException: lost", *["\tat a.b.C.d(C.java:1)"] * (k % 7), "Caused by: java.net.SocketException: " + ("Connection reset" if k % 2 else "Broken pipe")]
    return out


def test_a_log_of_many_splits_equals_the_whole(spark, tmp_path, small_splits):
    text = log(80)
    (tmp_path / "x.log").write_text("\n".join(text) + "\n")
    got = logs.parse_jdbc(logs.read_lines(spark, str(tmp_path / "x.log"))).orderBy("event_ord").collect()
    heads = [n for n, x in enumerate(text) if x.startswith("[")] + [len(text)]
    want = [(a + 1, b, "CONNECTION_RESET" if "reset" in text[b - 1] else "BROKEN_PIPE", re.search(r"172[\d.]+", text[a])[0]) for a, b in zip(heads, heads[1:]) if "ERROR" in text[a]]
    assert [(e.start_line, e.end_line, e.event_type, e.database_host) for e in got] == want
    assert [e.event_id for e in got] == [f"JE{k + 1:04d}" for k in range(len(want))]


def test_field_text_of_many_splits(spark, tmp_path, small_splits):
    rows = [f"{k}|{k}.5|60|60|10.0.0.1|10.0.0.2|1|5236|0|0x0018|{k}||||aa:bb|||||" if k % 5 else "" for k in range(120)]
    (tmp_path / "f.txt").write_text("\n".join(rows))
    got = fieldtext.read(spark, str(tmp_path / "f.txt")).orderBy("pkt_ord").collect()
    assert [(g.pkt_ord, g.tcp_seq) for g in got] == [(k + 1, k) for k in range(120) if k % 5]


def test_a_ping_log_of_many_splits(spark, tmp_path, small_splits):
    rows = []
    for k in range(150):
        if k % 50 == 0:
            rows.append(f"[2031-03-07 21:00:00.000] ===== Ping monitor started: 172.20.5.{k // 50} =====")
        rows.append(f"[2031-03-07 21:00:{k % 60:02}.500] no answer yet for icmp_seq={k}")
    (tmp_path / "p.log").write_text("\n".join(rows))
    got = logs.parse_ping(logs.read_lines(spark, str(tmp_path / "p.log"))).orderBy("source_line").collect()
    assert [(g.icmp_seq, g.target_host) for g in got] == [(k, f"172.20.5.{k // 50}") for k in range(150)]


# -- capture files -------------------------------------------------------------------------------

import random  # noqa: E402
import struct  # noqa: E402

from linkscope.plans.analyze import Capture, prepared  # noqa: E402
from linkscope.sources import capture  # noqa: E402


def frame(k, to_db=True, flags=0x18, seq=100, ack=200, payload=b"", options=b"", ttl=64, vlan=False):
    a, b, pa_, pb = ("10.1.0.7", "10.1.0.9", 41000, 5236) if to_db else ("10.1.0.9", "10.1.0.7", 5236, 41000)
    ip = lambda x: bytes(map(int, x.split(".")))
    tcp = struct.pack(">HHIIHHHH", pa_, pb, seq, ack, ((20 + len(options)) // 4 << 12) | flags, 1000 + k, 0, 0) + options + payload
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), k & 0xFFFF, 0, ttl, 6, 0) + ip(a) + ip(b)
    return b"\0" * 12 + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + head + tcp


def classic(frames, order="<", nano=False):
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)
    for k, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1700000000 + k, 250_000_000 if nano else 250_000, len(f), len(f)) + f
    return out


def of_blocks(frames, again=None):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    link = block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0))
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out = section + link
    for k, f in enumerate(frames):
        if k == again:
            out += section + link
        at = (1700000000 + k) * 10**9 + 250_000_000
        out += block(6, struct.pack("<IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def traffic(n):
    r, out = random.Random(n), []
    for k in range(n):
        kind = r.random()
        if kind < 0.1:
            out.append(b"\0" * 12 + b"\x08\x06" + b"\0" * 28)  # no IP
        else:
            out.append(frame(k, kind < 0.6, 0x18, 1000 + 10 * k, 5000 + k, bytes(r.randrange(256) for _ in range(r.randint(0, 60))), vlan=kind > 0.9))
    return out


def told(spark, path, split):
    p, status = capture.read(spark, str(path), split=split)
    return sorted(map(tuple, p.drop("capture_id").collect()), key=lambda x: x[0]), [tuple(x)[1:] for x in status.collect()]


@pytest.mark.parametrize("make", [classic, lambda f: classic(f, ">", True), of_blocks], ids=["classic", "big-endian nano", "blocks"])
def test_ranges_give_the_packets_of_one(spark, tmp_path, make):
    frames = traffic(150)
    (tmp_path / "x.cap").write_bytes(make(frames))
    whole, status = told(spark, tmp_path / "x.cap", 0)
    assert status == [(150, len(whole), False)] and len(whole) > 100
    assert [x[0] for x in whole] == [k + 1 for k, f in enumerate(frames) if f[12:14] != b"\x08\x06"] and whole[0][1] % 1 == 0.25
    for split in (700, 3001):
        assert told(spark, tmp_path / "x.cap", split) == (whole, status)


@pytest.mark.parametrize("make", [classic, of_blocks])
@pytest.mark.parametrize("lost", [1, 9, 40])
def test_a_cut_tail_is_told(spark, tmp_path, make, lost):
    (tmp_path / "x.cap").write_bytes(make(traffic(60))[:-lost])
    for split in (0, 900):
        packets, status = told(spark, tmp_path / "x.cap", split)
        assert status == [(59, len(packets), True)]


def test_a_capture_within_a_packet_misleads_no_range(spark, tmp_path):
    inner = classic([frame(k, payload=b"in") for k in range(30)])[24:]
    frames = [frame(k, payload=inner[300 * k : 300 * k + 1200]) for k in range(8)]
    (tmp_path / "x.cap").write_bytes(classic(frames))
    assert told(spark, tmp_path / "x.cap", 500) == told(spark, tmp_path / "x.cap", 0)
    assert told(spark, tmp_path / "x.cap", 500)[1] == [(8, 8, False)]


def test_interfaces_that_are_described_half_way(spark, tmp_path):
    (tmp_path / "x.cap").write_bytes(of_blocks(traffic(60), again=30))
    assert told(spark, tmp_path / "x.cap", 600) == told(spark, tmp_path / "x.cap", 0)


def test_what_is_no_capture_and_what_is_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        capture.files_of(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        capture.layout_of(b"plain text, no capture at all", "x")
    (tmp_path / "empty.cap").write_bytes(classic([]))
    assert told(spark, tmp_path / "empty.cap", 0) == ([], [(0, 0, False)])
    (tmp_path / "stub.cap").write_bytes(classic(traffic(1))[:30])
    with pytest.raises(RuntimeError):
        capture.read(spark, str(tmp_path / "stub.cap"))


def test_a_capture_is_analyzed(spark, tmp_path):
    """A handshake with scaled windows, relative numbers, and data sent three times."""
    scale = lambda n: b"\x03\x03" + bytes([n]) + b"\x01"
    rows = [frame(0, True, 2, 7_000, 0, options=scale(7)), frame(1, False, 18, 4_294_967_290, 7_001, options=scale(2)), frame(2, True, 16, 7_001, 4_294_967_291)]
    rows += [frame(3 + k, True, 24, 7_001, 4_294_967_291, b"data") for k in range(3)] + [frame(6, False, 24, 4_294_967_291, 7_005, b"0123456789"), frame(7, True, 16, 7_005, 5)]
    (tmp_path / "x.cap").write_bytes(classic(rows))
    p, _ = capture.read(spark, str(tmp_path / "x.cap"), 5236)
    got = p.orderBy("pkt_ord").collect()
    assert [(x.tcp_seq, x.tcp_ack) for x in got] == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 5), (5, 11)]
    assert [x.tcp_window for x in got] == [1000, 1001, 1002 * 128, 1003 * 128, 1004 * 128, 1005 * 128, 1006 * 4, 1007 * 128]
    c = Capture(prepared(p), 5236)
    assert [(x["count"], x.seq, x.tcp_len, x.expected_ack) for x in c.retransmissions.collect()] == [(3, 1, 4, 5)]
    h, s = c.handshakes.first(), c.sessions.first()
    assert h.complete and h.latency_ms == 1000.0 and (s.session_id, s.client_ip, s.server_port) == (-1, "10.1.0.7", 5236)
