"""Many cases in one plan, against the same cases one by one."""

import argparse
import csv
import json
import re
from pathlib import Path

from test_products import capture_bytes, read_csv
from test_sources import log

from linkscope import cli
from linkscope.operators import detectors
from linkscope.plans import many
from linkscope.sources import capture, roles


def faults(n):
    return re.sub(r"172\.20\.5\.\d+:5432", "10.1.0.9:5236", "\n".join(log(n)).replace("2031-03-07 22:00:0", "2023-11-14 22:13:2"))


def make(root):
    """Cases whose addresses, ports and file names are all alike, and ones that fail in different ways."""
    for name in ("good [1]", "nolog", "torn", "stub", "twin+x"):
        (root / name).mkdir(parents=True)
        for side in ("app", "db"):
            (root / name / f"{side}.pcap").write_bytes(capture_bytes(side == "db"))
        if name != "nolog":
            (root / name / "x.log").write_text(faults(9 if name == "twin+x" else 6))
    (root / "good [1]" / "p.log").write_text("[2023-11-14 22:13:20.000] 64 bytes from 10.1.0.9: icmp_seq=1 ttl=64 time=0.5 ms\n" * 3)
    (root / "torn" / "db.pcap").write_bytes(capture_bytes(False)[:30])
    (root / "stub" / "app.pcap").write_bytes(capture_bytes(False)[:12])
    (root / "bare").mkdir()
    return root


COMPARED = {
    "jdbc_tcp_candidates": ("event_id", "rank", "client_port", "server_port", "app_stream", "db_stream", "packets_near", "identity_score", "health_score"),
    "jdbc_tcp_correlations": ("event_id", "correlation_status", "server_port", "app_stream", "eligible_count", "flows_considered", "filtered_endpoint", "filtered_time"),
    "dual_segments": ("seq", "tcp_len", "app_frame", "db_frame", "match_status", "app_stream"),
    "jdbc_events": ("event_id", "event_type", "database_port", "group_id", "occurrence_count"),
}


def test_one_plan_equals_case_by_case(spark, tmp_path):
    root, out = make(tmp_path / "cases"), tmp_path / "many"
    assert cli.main(["many", str(root), "--port", "5236", "--server-ip", "10.1.0.9", "--out", str(out)]) == 1
    one = {r["case_id"]: r for r in json.loads((out / "batch_summary.json").read_text())}
    assert {k: (r["status"], r["jdbc_event_count"], r["ping_status"]) for k, r in one.items()} == {"bare": ("MISSING_INPUT", "", ""), "good [1]": ("SUCCESS", 4, "PROVIDED"), "nolog": ("MISSING_INPUT", "", ""), "stub": ("ANALYSIS_FAILED", "", ""), "torn": ("ANALYSIS_FAILED", "", ""), "twin+x": ("SUCCESS", 6, "NOT PROVIDED")}
    assert {k: r["error_code"] for k, r in one.items() if r["error_code"]} == {k: r["status"] for k, r in one.items() if r["status"] != "SUCCESS"}
    lost = read_csv(out / "quarantine.csv")
    assert sorted(r["case_id"] for r in lost) == ["bare", "nolog", "stub", "torn"] and all(r["stage"] for r in lost)
    assert [r["case_id"] for r in csv.DictReader((out / "batch_summary.csv").open())] == sorted(one)
    a = argparse.Namespace(port=5236, server_ip="10.1.0.9", max_packets=None, thresholds=None, log_timezone="UTC")
    alone = cli.case_of(spark, *[str(root / "twin+x" / n) for n in ("x.log", "app.pcap", "db.pcap")], None, a)
    tables = {"jdbc_tcp_candidates": alone.candidates, "jdbc_tcp_correlations": alone.correlations, "dual_segments": alone.dual.segments, "jdbc_events": alone.events}
    for name, columns in COMPARED.items():
        text = lambda x: str(float(x)) if x.replace(".", "").replace("-", "").isdigit() else x
        told = lambda rows: sorted(tuple(text("" if r[c] is None else str(r[c])) for c in columns) for r in rows)
        want = told(tables[name].collect())
        assert want and told(r for r in read_csv(out / f"{name}.csv") if r["case_id"] == "twin+x") == want, name
    alone.stage.close()


def test_events_without_a_host_stay_in_their_case(spark, tmp_path):
    """No host at all: an event may be any flow of its case, and of no other."""
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
        for side in ("app", "db"):
            (tmp_path / name / f"{side}.pcap").write_bytes(capture_bytes(side == "db"))
        (tmp_path / name / "x.log").write_text("[ERROR - 2023-11-14 22:13:25] tid:1 - [main] { c-1 } run\nacme.db.LinkException: lost\nCaused by: java.net.SocketException: Connection reset\n")
    cases = many.Cases(spark, [str(tmp_path / n) for n in "abc"], 5236)
    assert [(r.case_id, r.database_host) for r in cases.events.orderBy("case_id").collect()] == [(n, None) for n in "abc"]
    assert [(r.flows_considered, r.eligible_count) for r in cases.correlations.collect()] == [(1, 1)] * 3
    got = cases.candidates.collect()
    assert len(got) == 3 and all(r.event_id.split("/")[0] == r.correlation_id.split("/")[0] == str(many_case(r.app_stream)) for r in got)
    cases.stage.close()


def many_case(stream):
    return (stream + (1 << 31)) >> 32


def test_names_within_a_case(spark):
    rows = [(v, c) for v in (0, 7, -1, -3, 2**30) for c in (1, 2, 30_000)]
    df = spark.createDataFrame(rows, "v long, c long").withColumn("both", many.with_case(many.F.col("v"), many.F.col("c"), 32))
    got = df.select("v", "c", "both", many.case_of(many.F.col("both")).alias("case"), many.alone(many.F.col("both")).alias("own")).collect()
    assert all(r.case == r.c and r.own == r.v for r in got) and len({r.both for r in got}) == len(rows)


def test_sides_and_quality_of_each_capture(spark, tmp_path):
    for name, shift in (("x", True), ("y", False)):
        (tmp_path / f"{name}.pcap").write_bytes(capture_bytes(shift))
    packets, status = capture.read(spark, [str(tmp_path / "x.pcap"), str(tmp_path / "y.pcap")], 5236)
    each = {r.capture_id: r.asDict() for r in roles.probe_each(packets, "10.1.0.9", 5236).collect()}
    for name in ("x", "y"):
        path = str(tmp_path / f"{name}.pcap")
        want = roles.probe(capture.read(spark, path, 5236)[0], "10.1.0.9", 5236).first().asDict()
        assert {k: v for k, v in each[path].items() if k != "capture_id"} == want
    torn = status.withColumn("file_cut_short", status.capture_id.endswith("x.pcap"))
    got = {Path(r.capture_id).stem: (r.credibility, r.file_cut_short) for r in detectors.capture_quality(packets, cut_short=torn).collect()}
    assert got == {"x": ("DEGRADED", True), "y": ("HIGH", False)}
