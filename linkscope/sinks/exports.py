"""Documents of cases and pairs of captures, payload files, and summaries of batches."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..plans.analyze import Dual
from .tables import write_csv, write_json

# -- correlations --------------------------------------------------------------------------------


def correlations_table(correlations: DataFrame, *also: str) -> DataFrame:
    """One row an event as it is exported (behind the columns `also`), with the scores of its first candidate and the reason in words."""
    c = F.col
    counted = F.format_string("%d flows looked at, %d at other endpoints, %d at other times, %d fit", c("flows_considered"), c("filtered_endpoint"), c("filtered_time"), c("eligible_count"))
    points = F.format_string("%s is first with %.1f points of identity and %.1f of health", c("correlation_id"), c("identity_score"), c("health_score"))
    why = (
        F.when(c("correlation_status") == "NO_MATCH", F.lit("No flow is left: "))
        .when(c("correlation_status") == "AMBIGUOUS", F.concat(points, F.lit(", but others fit as well: ")))
        .otherwise(F.concat(points, F.lit("; without a client port in the log no more than STRONG: ")))
    )
    return correlations.select(
        *also, "event_id", "correlation_status", "evidence_level", c("correlation_id").alias("dual_correlation_id"), "client_ip", "client_port", "server_ip", "server_port", "app_stream", "db_stream", "event_timestamp", "flow_start", "flow_end",
        F.when(c("nearest_tcp_frame").isNotNull(), F.concat(F.lit("frame "), c("nearest_tcp_frame"))).alias("nearest_tcp_event"), c("nearest_tcp_time").alias("nearest_tcp_event_time"), "delta_seconds",
        c("eligible_count").alias("candidate_count"), "flows_considered", "filtered_endpoint", "filtered_time", "eligible_count", "identity_score", "health_score", F.concat(why, counted).alias("reason"),
    )


def candidates_table(candidates: DataFrame, *also: str) -> DataFrame:
    """The ranked candidates of every event, ten at most."""
    return candidates.select(*also, "event_id", "rank", F.col("correlation_id").alias("dual_correlation_id"), "client_ip", "client_port", "server_ip", "server_port", "app_stream", "db_stream", "app_start", "app_end", "packets_near", "distance", "identity_score", "health_score", "total_score", "anomaly_types")


# -- two captures --------------------------------------------------------------------------------


def dual_document(d: Dual) -> DataFrame:
    """One row: the clock, the number of flows, and of segments seen on both sides and on one."""
    s = d.segments.agg(F.count_if(F.col("match_status") == "MATCHED_BOTH_SIDES").alias("matched_both"), F.count_if(F.col("match_status").isin("ONLY_AT_APP_SIDE", "ONLY_AT_DB_SIDE")).alias("one_side_only"))
    f = d.flows.agg(F.count(F.lit(1)).alias("correlated_flow_count"))
    return d.clock.select(F.struct("*").alias("clock")).join(F.broadcast(s)).join(F.broadcast(f))  # a row each


def write_dual_anomalies(d: Dual, path: str, key_seqs: Sequence[int] = ()) -> None:
    """dual_anomalies.json, and beside it folders of flows and of the matched segments with the sequence numbers asked for."""
    row = dual_document(d).withColumn("db_port", F.lit(d.app.db_port)).first().asDict(recursive=True)
    Path(path).mkdir(parents=True, exist_ok=True)
    Path(path, "dual_anomalies.json").write_text(json.dumps({**row, "flows": "dual_anomalies_flows", "key_segments": "dual_anomalies_key_segments"}, ensure_ascii=False, indent=2), encoding="utf-8")
    write_json(d.flows, f"{path}/dual_anomalies_flows")
    write_json(d.segments.where(F.col("match_status") == "MATCHED_BOTH_SIDES").where(F.col("seq").isin(*key_seqs) if key_seqs else F.lit(False)), f"{path}/dual_anomalies_key_segments")


# -- payloads ------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: int


class PayloadWriter(DataSourceWriter):
    """One file a row (file_name, payload) under a folder.

    A task writes each file under a name of its own attempt and then moves it to its place, so a
    reader never sees half a file, and a task that runs again puts the same bytes at the same
    place. When all tasks are done, what lost attempts left goes and _SUCCESS says so.
    """

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.run = path.rstrip("/"), names, uuid.uuid4().hex

    def fs(self):
        found = pyarrow.fs.FileSystem.from_uri(self.path) if ":" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        return found

    def write(self, rows: Iterator[Row]) -> Written:
        fs, base = self.fs()
        mine, n = f"{base}/_attempts-{self.run}/{uuid.uuid4().hex}", 0
        fs.create_dir(mine, recursive=True)
        made = set()
        for row in rows:
            name, payload = row["file_name"], row["payload"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"no name for a payload: {name!r}")
            with fs.open_output_stream(f"{mine}/{n}") as f:
                f.write(bytes(payload or b""))
            folder = f"{base}/{name}".rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            fs.move(f"{mine}/{n}", f"{base}/{name}")
            n += 1
        return Written(n)

    def _clear(self) -> None:
        fs, base = self.fs()
        if fs.get_file_info(f"{base}/_attempts-{self.run}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{base}/_attempts-{self.run}")

    def commit(self, messages: list) -> None:
        self._clear()
        fs, base = self.fs()
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/_SUCCESS") as f:
            f.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        self._clear()


class PayloadSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "file_name string, payload binary"

    def writer(self, schema, overwrite: bool) -> PayloadWriter:
        return PayloadWriter(self.options["path"], schema.names)


def write_payloads(rows: DataFrame, path: str) -> None:
    """payload_rows() as files under path/payload, and what each holds as payload_index."""
    rows.sparkSession.dataSource.register(PayloadSink)
    rows.select("file_name", "payload").write.format("payloads").mode("append").save(f"{path}/payload")
    write_csv(rows.drop("payload"), f"{path}/payload_index.csv")


# -- batches -------------------------------------------------------------------------------------

SUMMARY = ("case_id", "case_path", "status", "jdbc_event_count", "primary_event_type", "correlation_status", "candidate_count", "tcp_health", "capture_quality", "ping_status", "report_html", "error_code", "error_message")
SHOWN = ("case_id", "status", "primary_event_type", "correlation_status", "candidate_count", "ping_status", "error_message")


def counts_of(rows: list[dict], name: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for r in rows:
        out[str(r.get(name) or "(none)")] = out.get(str(r.get(name) or "(none)"), 0) + 1
    return dict(sorted(out.items()))


def write_batch(rows: list[dict], out: str) -> None:
    """batch_summary.csv, batch_summary.json and batch_report.html: a row a case, and counts by status and by correlation."""
    import csv

    rows = [{k: r.get(k, "") for k in SUMMARY} for r in rows]
    Path(out).mkdir(parents=True, exist_ok=True)
    with Path(out, "batch_summary.csv").open("w", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, fieldnames=SUMMARY)
        w.writeheader()
        w.writerows(rows)
    Path(out, "batch_summary.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    link = lambda r: f"<td><a href=\"{html.escape(r['report_html'])}\">report</a></td>" if r["report_html"] else "<td></td>"
    body = "".join("<tr>" + "".join(cell(r[k]) for k in SHOWN) + link(r) + "</tr>" for r in rows)
    totals = "".join(f"<p>{title}: " + html.escape(", ".join(f"{k} {n}" for k, n in counts_of(rows, name).items())) + "</p>" for title, name in (("By status", "status"), ("By correlation", "correlation_status")))
    head = "".join(f"<th>{x.replace('_', ' ')}</th>" for x in (*SHOWN, "report"))
    page = f"<!doctype html><html><head><meta charset='utf-8'><title>Cases</title></head><body><h1>{len(rows)} cases</h1><p>Each case stands by itself; nothing is concluded across them.</p>{totals}<table border='1'><tr>{head}</tr>{body}</table></body></html>"
    Path(out, "batch_report.html").write_text(page, encoding="utf-8")
