"""Command line: one capture, two captures, a case, or a folder of cases.

Captures are capture files or field-text files of a dissector. Exit codes: 0 done, 1 failed, 2 done on a capture
of limited quality (or, for a batch, nothing to do).
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .plans import many
from .plans.analyze import Capture, Case, Dual, prepared
from .schemas import DB_PORTS
from .sinks import exports, reports, tables
from .sources import capture as capture_file
from .sources import discover, fieldtext, logs, roles
from .sources.lines import escaped
from .stages import Stage


def port_of(text: str) -> int:
    """A port number, or that of a database by name."""
    port = DB_PORTS.get(text.lower()) or (int(text) if text.isdigit() else 0)
    if not 1 <= port <= 65535:
        raise argparse.ArgumentTypeError(f"no port and no database: {text}")
    return port


def packets_of(spark: SparkSession, path: str, port: int | None = None, max_packets: int | None = None) -> tuple[DataFrame, bool]:
    """Packets of a capture file or a file of field text, with ttl where it is known, and whether the file is cut short."""
    if discover.kind_of(Path(path)) != "capture":
        return fieldtext.read(spark, escaped(path), port, max_packets).withColumn("ttl", F.lit(None).cast("int")), False
    packets, status = capture_file.read(spark, path, port, max_packets)
    # A look at the first packets alone is meant to stop there.
    return packets, max_packets is None and bool(status.agg(F.max("file_cut_short")).first()[0])


def capture(spark: SparkSession, path: str, name: str, a: argparse.Namespace) -> Capture:
    packets, cut_short = packets_of(spark, path, a.port, a.max_packets)
    packets = packets.drop("ttl").withColumn("capture_id", F.lit(name))
    c = Capture(prepared(packets), a.port, config.load(config.default_path(), a.thresholds), cut_short, Stage(spark, name))
    c.raw = packets
    return c


def case_of(spark: SparkSession, jdbc: str, app: str, db: str, ping: str | None, a: argparse.Namespace) -> Case:
    samples = logs.parse_ping(logs.read_lines(spark, escaped(ping)), a.log_timezone) if ping else None
    events = logs.parse_jdbc(logs.read_lines(spark, escaped(jdbc)), a.server_ip, a.port, a.log_timezone)
    return Case(Dual(capture(spark, app, "app", a), capture(spark, db, "db", a)), events, samples, default_host=a.server_ip, default_port=a.port)


def write(out: str, title: str, frames: dict[str, DataFrame], sections: list) -> None:
    for name, df in frames.items():
        tables.write_csv(df, f"{out}/{name}.csv")
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "report.md").write_text(reports.markdown(title, sections), encoding="utf-8")
    Path(out, "report.html").write_text(reports.page(title, sections), encoding="utf-8")


def quality_code(*captures: Capture) -> int:
    return 2 if any(c.quality.where("credibility <> 'HIGH'").limit(1).count() for c in captures) else 0


def run_case(spark: SparkSession, jdbc: str, app: str, db: str, ping: str | None, out: str, a: argparse.Namespace) -> dict:
    """Write all of a case; what a batch says of it comes back."""
    c = case_of(spark, jdbc, app, db, ping, a)
    frames = {
        "jdbc_events": c.events, "jdbc_tcp_correlations": exports.correlations_table(c.correlations), "jdbc_tcp_candidates": exports.candidates_table(c.candidates), "jdbc_timeline": c.timeline,
        "dual_flows": c.dual.flow_counts, "dual_segments": c.dual.segments, "unified_timeline": c.unified, "case_evidence": c.evidence,
    }
    if c.samples is not None:
        frames |= {"ping_events": c.samples, "ping_correlation": c.ping_statistics}
    write(out, "Case report", frames, reports.case_sections(c))
    exports.write_dual_anomalies(c.dual, out, a.key_seq)
    s = {r["correlation_status"]: r["count"] for r in c.correlations.groupBy("correlation_status").count().collect()}
    key = c.events.join(c.key_event.select("event_id"), "event_id").select("event_id", "event_type").join(c.correlations.select("event_id", "correlation_status", "eligible_count"), "event_id", "left").first()
    quality, code = c.dual.app.quality.first(), quality_code(c.dual.app, c.dual.db)
    said = {
        "jdbc_event_count": sum(s.values()), "primary_event_type": key["event_type"] if key else "", "correlation_status": key["correlation_status"] if key else "", "candidate_count": key["eligible_count"] if key else "",
        "tcp_health": c.dual.app.rollup.first()["tcp_health"] if quality else "", "capture_quality": quality["credibility"] if quality else "", "ping_status": "PROVIDED" if c.samples is not None else "NOT PROVIDED", "report_html": "report.html",
    }
    c.stage.close()
    return {"events": sum(s.values()), "correlation": s, "code": code, **said}


def run_auto(spark: SparkSession, folder: str, out: str, a: argparse.Namespace) -> dict:
    """A case from a folder; captures without a role in their names are told apart by their packets. Whatever fails is this case's result."""
    stage, status = "discovery", "ANALYSIS_FAILED"
    Path(out).mkdir(parents=True, exist_ok=True)
    try:
        d = discover.discover(folder, dict(x.split("=", 1) for x in a.role))
        if d["status"] == "READY" and "unknown" in d["roles"].values():
            stage = "roles"
            for path in [p for p, r in d["roles"].items() if r == "unknown"]:
                d["roles"][path] = roles.probe(packets_of(spark, path)[0], a.server_ip, a.port).first()["role"].lower()
            if sorted(d["roles"].values()) != ["app", "db"]:
                d["status"] = "INPUT_AMBIGUOUS"
        discover.write_manifest(d, f"{out}/input_manifest.json")
        if d["status"] != "READY" or a.dry_run:
            ready = d["status"] == "READY"
            return {"status": d["status"], "code": 0 if ready else 1, **({} if ready else {"error_code": d["status"], "error_message": ", ".join(d["missing"])})}
        side, stage = {r: p for p, r in d["roles"].items()}, "analysis"
        done = run_case(spark, d["jdbc"][0], side["app"], side["db"], next(iter(d["ping"]), None), out, a)
        return {"status": "SUCCESS_WITH_WARNINGS" if done["code"] == 2 else "SUCCESS", **done}
    except Exception as e:  # one case's failure must not end a batch
        error = {"stage": stage, "error_type": type(e).__name__, "message": str(e)[:500]}
        Path(out, "case_error.json").write_text(json.dumps(error, ensure_ascii=False), encoding="utf-8")
        return {"status": status, "code": 1, "error_code": status, "error_message": error["message"].replace("\n", " "), **error}


def run_batch(spark: SparkSession, folder: str, out: str, a: argparse.Namespace) -> int:
    """Every folder of a folder as a case. 2: there is none; 1: one failed."""
    rows = []
    for p in sorted(Path(folder).iterdir()):
        if p.is_dir() and p.resolve() != Path(out).resolve():
            done = run_auto(spark, str(p), f"{out}/{p.name}", a)
            rows.append({**done, "case_id": p.name, "case_path": str(p), "report_html": f"{p.name}/report.html" if done.get("report_html") else ""})
    if not rows:
        return 2
    exports.write_batch(rows, out)
    return int(any(not r["status"].startswith("SUCCESS") for r in rows))


def run_many(spark: SparkSession, folder: str, out: str, a: argparse.Namespace) -> int:
    """Every folder of a folder as a case, all in one plan (of many.MOST cases): tables that begin with case_id, and the summary of a batch. Exit codes as run_batch's."""
    folders = [str(p) for p in sorted(Path(folder).iterdir()) if p.is_dir() and p.resolve() != Path(out).resolve()]
    if not folders:
        return 2
    rows = []
    for k in range(0, len(folders), many.MOST):
        with Stage(spark, "cases") as stage:
            cases = many.Cases(spark, folders[k : k + many.MOST], a.port, a.server_ip, config.load(config.default_path(), a.thresholds), a.log_timezone, dict(x.split("=", 1) for x in a.role), stage=stage)
            shown = {"jdbc_tcp_correlations": exports.correlations_table, "jdbc_tcp_candidates": exports.candidates_table}
            for name, df in ({"quarantine": cases.quarantine} if a.dry_run else cases.tables()).items():
                tables.write_csv(shown[name](df, "case_id") if name in shown else df, f"{out}/{name}.csv" + (f"/plan={k // many.MOST}" if len(folders) > many.MOST else ""))
            rows += (cases.listed.select("case_no", "case_id", "case_path", "status").distinct() if a.dry_run else cases.summary).orderBy("case_no").collect()  # a row a case
    told = [{k: "" if v is None else v for k, v in r.asDict().items()} for r in rows]
    exports.write_batch([{**r, **({"error_code": r["status"], "error_message": r.get("message", "")} if r["status"] not in ("READY", "SUCCESS", "SUCCESS_WITH_WARNINGS") else {})} for r in told], out)
    return int(any(r["status"] not in ("READY", "SUCCESS", "SUCCESS_WITH_WARNINGS") for r in told))


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="linkscope", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--port", type=port_of, required=True)
    common.add_argument("--out", required=True)
    common.add_argument("--server-ip")
    common.add_argument("--thresholds")
    common.add_argument("--max-packets", type=int)
    common.add_argument("--log-timezone", default="UTC")
    common.add_argument("--role", action="append", default=[], help="file=app or file=db")
    common.add_argument("--dry-run", action="store_true")
    common.add_argument("--key-seq", type=int, action="append", default=[], help="sequence numbers of segments to list in dual_anomalies")
    common.add_argument("--save-payloads", action="store_true")
    kinds = top.add_subparsers(dest="kind", required=True)
    kinds.add_parser("single", parents=[common]).add_argument("file")
    two = kinds.add_parser("dual", parents=[common])
    two.add_argument("app"), two.add_argument("db")
    case = kinds.add_parser("case", parents=[common])
    case.add_argument("jdbc"), case.add_argument("app"), case.add_argument("db"), case.add_argument("--ping")
    kinds.add_parser("auto", parents=[common]).add_argument("folder")
    kinds.add_parser("batch", parents=[common], help="case by case, with a report of each").add_argument("folder")
    kinds.add_parser("many", parents=[common], help="all cases in one plan, as tables").add_argument("folder")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("linkscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.kind == "single":
        c = capture(spark, a.file, "capture", a)
        write(a.out, "Capture report", {"flows": tables.flows_table(c.summaries), "evidence": c.evidence, "anomalies": c.anomalies}, reports.capture_sections(c))
        if a.save_payloads:
            exports.write_payloads(tables.payload_rows(c.bytes_of, c.retransmissions), a.out)
        return quality_code(c)
    if a.kind == "dual":
        d = Dual(capture(spark, a.app, "app", a), capture(spark, a.db, "db", a))
        write(a.out, "Two captures", {"dual_flows": d.flow_counts, "dual_segments": d.segments}, reports.dual_sections(d))
        exports.write_dual_anomalies(d, a.out, a.key_seq)
        return quality_code(d.app, d.db)
    if a.kind == "case":
        return run_case(spark, a.jdbc, a.app, a.db, a.ping, a.out, a)["code"]
    if a.kind == "auto":
        return run_auto(spark, a.folder, a.out, a)["code"]
    if a.kind == "many":
        return run_many(spark, a.folder, a.out, a)
    return run_batch(spark, a.folder, a.out, a)


if __name__ == "__main__":
    sys.exit(main())
