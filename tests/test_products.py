"""Payload files, documents and batches, written and read again."""

import csv
import json
from pathlib import Path

import pytest
from test_sources import classic, frame, log

from linkscope import cli, config
from linkscope.operators import dual
from linkscope.sinks import exports


def test_payload_files_of_tasks_that_run_again(spark, tmp_path):
    rows = [(f"stream_{k % 3}/client_seq_{k}_len_4.bin", bytearray(f"p{k:03}".encode())) for k in range(40)]
    df = spark.createDataFrame(rows, "file_name string, payload binary").repartition(4)
    spark.dataSource.register(exports.PayloadSink)
    for _ in range(2):
        df.write.format("payloads").mode("append").save(str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found.pop("_SUCCESS") == b"40" and found == {n: bytes(b) for n, b in rows}


def test_a_failed_write_leaves_no_half_files(spark, tmp_path):
    rows = [("a/good.bin", bytearray(b"x")), ("../bad.bin", bytearray(b"y"))]
    spark.dataSource.register(exports.PayloadSink)
    with pytest.raises(Exception):
        spark.createDataFrame(rows, "file_name string, payload binary").coalesce(1).write.format("payloads").mode("append").save(f"{tmp_path}/out")
    left = [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()]
    assert left in ([], ["out/a/good.bin"])


def test_frames_of_all_that_could_be_meant(spark):
    kind = "session_id long, direction string, seq long, tcp_len int, hash string, ts double, frame long, ack long, ord long, n long"
    a = spark.createDataFrame([(1, "APP_TO_DB", 5, 4, None, 1.0, 11, 0, 1, 1)], kind)
    d = spark.createDataFrame([(2, "APP_TO_DB", 5, 4, "x", 1.0, 31, 0, 1, 1), (2, "APP_TO_DB", 5, 4, "y", 1.1, 29, 0, 2, 1)], kind)
    flows = spark.createDataFrame([("CF0001", 1, 2)], "correlation_id string, app_stream long, db_stream long")
    got = dual.match_segments(a, d, flows).collect()
    assert [(x.match_status, x.candidate_frames) for x in got] == [("AMBIGUOUS", [11, 29, 31])]


def test_default_thresholds(tmp_path, monkeypatch):
    monkeypatch.setenv("LINKSCOPE_HOME", str(tmp_path))
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "thresholds.json").write_text('{"retx_high_count": 7}')
    assert config.load(config.default_path()).retx_high_count == 7


def capture_bytes(shift):
    """A handshake and 40 packets of data, some sent three times."""
    rows = [frame(0, True, 2, 100, 0), frame(1, False, 18, 500, 101), frame(2, True, 16, 101, 501)]
    for k in range(10):
        rows += [frame(3 + k, True, 24, 101 + 4 * k, 501, b"%04d" % k, ttl=64 if shift else 60)] * (3 if k % 4 == 0 else 1)
        rows.append(frame(30 + k, False, 16, 501, 105 + 4 * k, ttl=60 if shift else 64))
    return classic(rows)


def read_csv(folder):
    return [r for p in sorted(Path(folder).glob("part-*")) for r in csv.DictReader(p.open(encoding="utf-8"))]


def test_a_batch_of_cases(spark, tmp_path):
    """One case that succeeds, one without a log, one whose capture is broken: three rows, and an exit code for the failures."""
    cases = tmp_path / "cases"
    for name in ("good", "nolog", "torn"):
        (cases / name).mkdir(parents=True)
        for side in ("app", "db"):
            (cases / name / f"{side}.pcap").write_bytes(capture_bytes(side == "db"))
    text = "\n".join(log(6)).replace("2031-03-07 22:", "2023-11-14 22:").replace("172.20.5.", "10.1.0.9 172.20.5.").replace("22:00:", "22:13:")
    for name in ("good", "torn"):
        (cases / name / "x.log").write_text(text)
    (cases / "good" / "p.log").write_text("[2023-11-14 22:13:20.000] 64 bytes from 10.1.0.9: icmp_seq=1 ttl=64 time=0.5 ms\n" * 3)
    (cases / "torn" / "db.pcap").write_bytes(capture_bytes(False)[:30])
    out = tmp_path / "out"
    code = cli.main(["batch", str(cases), "--port", "5236", "--server-ip", "10.1.0.9", "--out", str(out)])
    rows = {r["case_id"]: r for r in json.loads((out / "batch_summary.json").read_text())}
    assert code == 1 and {k: r["status"] for k, r in rows.items()} == {"good": "SUCCESS", "nolog": "MISSING_INPUT", "torn": "ANALYSIS_FAILED"}
    assert rows["good"]["jdbc_event_count"] == 4 and rows["good"]["ping_status"] == "PROVIDED" and "cut short" in rows["torn"]["error_message"]
    assert [r["case_id"] for r in csv.DictReader((out / "batch_summary.csv").open())] == ["good", "nolog", "torn"]
    page = (out / "batch_report.html").read_text()
    assert "good/report.html" in page and "MISSING_INPUT 1" in page
    told = json.loads((out / "good" / "dual_anomalies.json").read_text())
    assert told["correlated_flow_count"] == 1 and told["matched_both"] == 10
    correlations = read_csv(out / "good" / "jdbc_tcp_correlations.csv")
    assert len(correlations) == 4 and all(r["reason"] for r in correlations)
    assert json.loads((out / "torn" / "case_error.json").read_text())["stage"] == "analysis"


def test_one_capture_with_payloads(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(capture_bytes(True))
    assert cli.main(["single", str(tmp_path / "x.pcap"), "--port", "5236", "--out", f"{tmp_path}/out", "--save-payloads"]) == 0
    found = {p.name: p.read_bytes() for p in (tmp_path / "out" / "payload").rglob("*.bin")}
    assert found == {f"client_seq_{1 + 4 * k}_len_4.bin": b"%04d" % k for k in (0, 4, 8)}
    assert {r["sha256"] for r in read_csv(tmp_path / "out" / "payload_index.csv")} and (tmp_path / "out" / "report.html").is_file()
