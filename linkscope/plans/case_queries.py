"""Queries over two captures and over logs, and their DuckDB SQL. Log text is derived from events, too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logtext, packets as P
from ..operators import correlate, dual, grouping, ping, timeline
from ..sources import fieldtext, logs, roles
from ..stages import Stage
from . import views
from .analyze import Capture, Case, Dual
from .queries import ANOMALY, RESET, RETX, SESSION, SHAKE, STALL, SUMMARY, ZERO, pk, query


def pair(spark: SparkSession, sf_dir: str, kind: str = "") -> Dual:
    """Two captures, whose sessions, packets, findings, flows and segments are each written once."""
    stage = Stage(spark, "pair")
    return Dual(*[Capture(views.view(spark, sf_dir, side + kind), views.DB_PORT, stage=stage) for side in ("app", "db")], stage=stage)


def flat(name: str, alias: str) -> str:
    """Packets and sessions of a view as {alias}p and {alias}f, in DuckDB."""
    return f"""{pk(name, alias)}, {alias}f AS (
  SELECT session_id, min(pkt_ord) AS ord, min(timestamp) AS s, max(timestamp) AS e, arg_min(CASE WHEN direction = 'client_to_server' THEN src_ip ELSE dst_ip END, pkt_ord) AS cip, arg_min(CASE WHEN direction = 'client_to_server' THEN src_port ELSE dst_port END, pkt_ord) AS cport,
         arg_min(CASE WHEN (tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0 THEN tcp_seq END, CASE WHEN (tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0 THEN pkt_ord END) AS syn
  FROM {alias}p GROUP BY session_id)"""


# With a 4-tuple for each session, matching is a plain join; the greedy part is tested by brute force.
FLOWS = f"""{flat("app", "a")}, {flat("db", "d")},
fl AS (
  SELECT a.cip AS client_ip, a.cport AS client_port, a.session_id AS app_stream, d.session_id AS db_stream, a.s AS app_start, a.e AS app_end, d.s AS db_start, d.e AS db_end,
         CASE WHEN least(a.e, d.e) > greatest(a.s, d.s) THEN 'CONFIRMED' ELSE 'SUSPECTED' END AS confidence,
         'CF' || lpad(row_number() OVER (ORDER BY a.cip, a.cport)::VARCHAR, 4, '0') AS correlation_id
  FROM af a JOIN df d ON a.cip = d.cip AND a.cport = d.cport
  WHERE NOT coalesce(a.syn <> 0 AND d.syn <> 0 AND a.syn <> d.syn, false) AND (least(a.e, d.e) > greatest(a.s, d.s) OR abs(a.s - d.s) <= 600))"""


def segments_sql(app: str, db: str) -> str:
    """Bucket by bucket, by the rules in words: exact matches, then hashed against hashless, then conflicts and remainders."""
    flows = FLOWS.replace(flat("app", "a"), flat(app, "a")).replace(flat("db", "d"), flat(db, "d"))
    bucket = lambda x: f"""{x}b AS (
  SELECT session_id, CASE direction WHEN 'client_to_server' THEN 'APP_TO_DB' ELSE 'DB_TO_APP' END AS direction, tcp_seq AS seq, tcp_len AS len, CASE WHEN payload_known THEN payload_sha256 END AS h, arg_min(timestamp, pkt_ord) AS ts, min(pkt_ord) AS ord, count(*) AS n
  FROM {x}p WHERE tcp_len > 0 GROUP BY ALL)"""  # noqa: E731
    return f"""{flows}, {bucket("a")}, {bucket("d")},
a0 AS (SELECT correlation_id AS c, b.* FROM ab b JOIN fl ON b.session_id = app_stream), d0 AS (SELECT correlation_id AS c, b.* FROM db b JOIN fl ON b.session_id = db_stream),
ex AS (SELECT a.c, a.direction, a.seq, a.len, a.h, a.ts - d.ts AS delta, a.n AS an, d.n AS dn FROM a0 a JOIN d0 d ON a.c = d.c AND a.direction = d.direction AND a.seq = d.seq AND a.len = d.len AND a.h IS NOT DISTINCT FROM d.h),
au AS (SELECT * FROM a0 WHERE NOT EXISTS (SELECT 1 FROM d0 d WHERE a0.c = d.c AND a0.direction = d.direction AND a0.seq = d.seq AND a0.len = d.len AND a0.h IS NOT DISTINCT FROM d.h)),
du AS (SELECT * FROM d0 WHERE NOT EXISTS (SELECT 1 FROM a0 a WHERE d0.c = a.c AND d0.direction = a.direction AND d0.seq = a.seq AND d0.len = a.len AND d0.h IS NOT DISTINCT FROM a.h)),
g AS (
  SELECT c, direction, seq, len, count(*) FILTER (side = 'a' AND h IS NOT NULL) AS ahn, count(*) FILTER (side = 'a' AND h IS NULL) AS aln, count(*) FILTER (side = 'd' AND h IS NOT NULL) AS dhn, count(*) FILTER (side = 'd' AND h IS NULL) AS dln
  FROM (SELECT 'a' AS side, * FROM au UNION ALL SELECT 'd', * FROM du) GROUP BY ALL),
b1 AS (SELECT * FROM g WHERE ahn > 0 AND dln > 0 AND aln = 0), b2 AS (SELECT * FROM g WHERE dhn > 0 AND aln > 0 AND dln = 0),
sg AS (
  SELECT c, direction, seq, len, CASE WHEN h IS NULL THEN 'HASH_UNAVAILABLE' ELSE 'MATCHED_BOTH_SIDES' END AS status, CASE WHEN h IS NULL THEN 'STRONG' ELSE 'CONFIRMED' END AS level, delta, an AS na, dn AS nd, h IS NOT NULL AS same FROM ex
  UNION ALL
  SELECT c, direction, seq, len, CASE WHEN ahn > 1 THEN 'AMBIGUOUS' ELSE 'HASH_UNAVAILABLE' END, CASE WHEN ahn > 1 THEN 'SUSPECTED' ELSE 'STRONG' END, CASE WHEN ahn = 1 THEN (SELECT arg_min(ts, ord) FROM au WHERE (au.c, au.direction, au.seq, au.len) = (b1.c, b1.direction, b1.seq, b1.len)) - (SELECT min(ts) FROM du WHERE (du.c, du.direction, du.seq, du.len) = (b1.c, b1.direction, b1.seq, b1.len) AND h IS NULL) END,
         (SELECT arg_min(n, ord) FROM au WHERE (au.c, au.direction, au.seq, au.len) = (b1.c, b1.direction, b1.seq, b1.len)), (SELECT min(n) FROM du WHERE (du.c, du.direction, du.seq, du.len) = (b1.c, b1.direction, b1.seq, b1.len) AND h IS NULL), false FROM b1
  UNION ALL
  SELECT c, direction, seq, len, CASE WHEN dhn > 1 THEN 'AMBIGUOUS' ELSE 'HASH_UNAVAILABLE' END, CASE WHEN dhn > 1 THEN 'SUSPECTED' ELSE 'STRONG' END, CASE WHEN dhn = 1 THEN (SELECT min(ts) FROM au WHERE (au.c, au.direction, au.seq, au.len) = (b2.c, b2.direction, b2.seq, b2.len) AND h IS NULL) - (SELECT arg_min(ts, ord) FROM du WHERE (du.c, du.direction, du.seq, du.len) = (b2.c, b2.direction, b2.seq, b2.len)) END,
         (SELECT min(n) FROM au WHERE (au.c, au.direction, au.seq, au.len) = (b2.c, b2.direction, b2.seq, b2.len) AND h IS NULL), (SELECT arg_min(n, ord) FROM du WHERE (du.c, du.direction, du.seq, du.len) = (b2.c, b2.direction, b2.seq, b2.len)), false FROM b2
  UNION ALL
  SELECT au.c, au.direction, au.seq, au.len, CASE WHEN h IS NOT NULL AND dhn > 0 AND NOT (aln > 0 AND dln = 0) THEN 'AMBIGUOUS' ELSE 'ONLY_AT_APP_SIDE' END, CASE WHEN h IS NOT NULL AND dhn > 0 AND NOT (aln > 0 AND dln = 0) THEN 'UNKNOWN' WHEN h IS NOT NULL THEN 'STRONG' ELSE 'SUSPECTED' END, NULL, n, 0, false
  FROM au JOIN g USING (c, direction, seq, len) WHERE NOT (ahn > 0 AND dln > 0 AND aln = 0 AND h IS NOT NULL) AND NOT (dhn > 0 AND aln > 0 AND dln = 0 AND h IS NULL)
  UNION ALL
  SELECT du.c, du.direction, du.seq, du.len, 'ONLY_AT_DB_SIDE', CASE WHEN h IS NOT NULL THEN 'STRONG' ELSE 'SUSPECTED' END, NULL, 0, n, false
  FROM du JOIN g USING (c, direction, seq, len) WHERE NOT (ahn > 0 AND dln > 0 AND aln = 0 AND h IS NULL) AND NOT (dhn > 0 AND aln > 0 AND dln = 0 AND h IS NOT NULL))"""


@query(f"WITH {FLOWS} SELECT * FROM fl")
def flow_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(spark, sf_dir).flows.drop("server_ip", "server_port")


@query(f"""WITH RECURSIVE {flat("app_reuse", "a")}, {flat("db_reuse", "d")},
pr AS (
  SELECT a.cip, a.cport, a.session_id AS x, d.session_id AS y, a.ord AS ao, d.ord AS dord, a.s AS app_start, a.e AS app_end, d.s AS db_start, d.e AS db_end, greatest(0, least(a.e, d.e) - greatest(a.s, d.s)) AS overlap,
         (SELECT count(*) FROM af n WHERE n.cip = a.cip AND n.cport = a.cport) AS na, (SELECT count(*) FROM df n WHERE n.cip = a.cip AND n.cport = a.cport) AS nd
  FROM af a JOIN df d ON a.cip = d.cip AND a.cport = d.cport
  WHERE NOT coalesce(a.syn <> 0 AND d.syn <> 0 AND a.syn <> d.syn, false) AND (least(a.e, d.e) > greatest(a.s, d.s) OR abs(a.s - d.s) <= 600)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cip, cport ORDER BY CASE WHEN overlap > 0 THEN overlap ELSE 1 / (1 + abs(app_start - db_start)) END DESC, ao, dord) AS rn FROM pr),
walk AS (
  SELECT cip, cport, rn, [x] AS ux, [y] AS uy, true AS taken FROM rk WHERE rn = 1
  UNION ALL
  SELECT cip, cport, rn, CASE WHEN free THEN list_append(ux, x) ELSE ux END, CASE WHEN free THEN list_append(uy, y) ELSE uy END, free
  FROM (SELECT rk.cip, rk.cport, rk.rn, x, y, ux, uy, NOT list_contains(ux, x) AND NOT list_contains(uy, y) AS free FROM walk w JOIN rk ON rk.cip = w.cip AND rk.cport = w.cport AND rk.rn = w.rn + 1))
SELECT cip AS client_ip, cport AS client_port, '{views.SERVER_IP}' AS server_ip, {views.DB_PORT} AS server_port, x AS app_stream, y AS db_stream, app_start, app_end, db_start, db_end,
       CASE WHEN overlap <= 0 THEN 'SUSPECTED' WHEN na > 1 OR nd > 1 THEN 'STRONG' ELSE 'CONFIRMED' END AS confidence, 'CF' || lpad(row_number() OVER (ORDER BY cip, cport, rn)::VARCHAR, 4, '0') AS correlation_id
FROM rk JOIN walk USING (cip, cport, rn) WHERE taken""")
def flow_match_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(spark, sf_dir, "_reuse").flows


@query(f"WITH {FLOWS} SELECT session_id AS stream FROM af WHERE session_id NOT IN (SELECT app_stream FROM fl) UNION ALL SELECT session_id FROM df WHERE session_id NOT IN (SELECT db_stream FROM fl)")
def flow_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pair(spark, sf_dir)
    both = dual.unmatched(d.app.sessions, d.flows, "app_stream").union(dual.unmatched(d.db.sessions, d.flows, "db_stream"))
    return both.withColumnRenamed("session_id", "stream")


@query(f"WITH {segments_sql('app', 'db')} SELECT c AS correlation_id, direction, seq, len AS tcp_len, seq + len AS expected_ack, status AS match_status, level AS evidence_level, delta AS observed_delta, na AS retransmission_count_app, nd AS retransmission_count_db FROM sg")
def segment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(spark, sf_dir).segments.select("correlation_id", "direction", "seq", "tcp_len", "expected_ack", "match_status", "evidence_level", "observed_delta", "retransmission_count_app", "retransmission_count_db")


def clock_sql(app: str, db: str) -> str:
    return f"""WITH {segments_sql(app, db)}, m AS (SELECT count(*) AS samples, median(delta) AS median_delta, min(delta) AS min_delta, max(delta) AS max_delta FROM sg WHERE status = 'MATCHED_BOTH_SIDES'),
j AS (SELECT *, CASE WHEN samples < 3 THEN 'INSUFFICIENT' WHEN max_delta - min_delta > 2.0 OR (abs(median_delta) > 0.05 AND max_delta - min_delta > greatest(1.0, 10 * abs(median_delta))) THEN 'UNRELIABLE' ELSE 'OK' END AS status FROM m)
SELECT samples, round(median_delta, 6) AS median_delta, round(min_delta, 6) AS min_delta, round(max_delta, 6) AS max_delta, status, CASE WHEN status = 'OK' THEN round(median_delta, 6) END AS clock_offset FROM j"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select("samples", *[F.round(c, 6).alias(c) for c in ("median_delta", "min_delta", "max_delta")], "status", F.round("clock_offset", 6).alias("clock_offset"))


@query(clock_sql("app", "db"))
def clock_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pair(spark, sf_dir).clock)


@query(clock_sql("app_clock", "db_clock"))
def clock_alignment_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pair(spark, sf_dir, "_clock").clock)


@query(f"WITH {segments_sql('app', 'db')} SELECT correlation_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in dual.STATUSES) + " FROM fl LEFT JOIN sg ON c = correlation_id GROUP BY correlation_id")
def dual_flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(spark, sf_dir).flow_counts.select("correlation_id", *[s.lower() for s in dual.STATUSES])


# -- logs ------------------------------------------------------------------------------------

#: Kinds of faults by k % 8: what the log says, and how it is classed.
FAULTS = (
    ("java.net.SocketException", "Connection reset", "CONNECTION_RESET"),
    ("java.net.ConnectException", "Connection refused", "CONNECTION_REFUSED"),
    ("java.net.SocketTimeoutException", "Read timed out", "READ_TIMEOUT"),
    ("java.net.SocketTimeoutException", "connect timed out", "CONNECT_TIMEOUT"),
    ("java.io.IOException", "Broken pipe", "BROKEN_PIPE"),
    ("java.sql.SQLException", "Connection is closed", "CONNECTION_CLOSED"),
    ("java.io.EOFException", "I/O error writing request", "UNKNOWN_NETWORK_ERROR"),
    ("java.lang.IllegalStateException", "ORA-00942 table not found", "NOT_NETWORK"),
)


def by_fault(i: int) -> str:
    return "CASE k % 8 " + " ".join(f"WHEN {n} THEN '{f[i]}'" for n, f in enumerate(FAULTS)) + " END"


FAULT_ROWS = "SELECT event_id, user_id, t, k, 'log' || cast(user_id % 20 AS {str}) AS source_file, {cls} AS cls, {msg} AS msg, {kind} AS kind FROM ({base}) WHERE event_type = 'error'"


def fault_rows(d: dict) -> str:
    return FAULT_ROWS.format(str=d["str"], cls=by_fault(0), msg=by_fault(1), kind=by_fault(2), base=views.base(d))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines for each error event: a header, an exception, its cause, a stack frame."""
    rows = spark.sql(fault_rows(views.SPARK).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    at = F.date_format(F.timestamp_seconds(F.lit(1789549121) + F.floor("t")), "yyyy-MM-dd HH:mm:ss")
    head = F.concat(F.lit("[ERROR - "), at, F.lit("] tid:"), "user_id", F.lit(" - [pool-"), F.col("user_id") % 3, F.lit("] { conn-1 } execute(); host=10.9.0.1:5236 password=x [USED TIME]: "), "k", F.lit("ms;"))
    lines = F.array(head, F.lit("dm.jdbc.driver.DMException: wrapped"), F.concat(F.lit("Caused by: "), "cls", F.lit(": "), "msg"), F.lit("\tat a.b.C.d(E.java:1)"))
    return rows.select("source_file", "event_id", F.posexplode(lines).alias("i", "value")).select("source_file", (F.col("event_id") * 4 + F.col("i") + 1).cast("int").alias("line_no"), "value")


def jdbc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_jdbc(log_lines(spark, sf_dir))


PARSED = f"""e AS (
  SELECT *, 'JE' || lpad((row_number() OVER (PARTITION BY source_file ORDER BY event_id))::VARCHAR, 4, '0') AS event_no, 1789549121 + floor(t) AS ts
  FROM ({fault_rows(views.DUCK)}) WHERE kind <> 'NOT_NETWORK')"""


@query(f"WITH {PARSED} SELECT source_file, event_no AS event_id, ts::DOUBLE AS timestamp, 'ERROR' AS level, 'dm.jdbc.driver.DMException' AS exception_class, 'wrapped' AS message, kind AS event_type, user_id::VARCHAR AS tid, 'pool-' || user_id % 3 AS thread_name, '10.9.0.1' AS database_host, 5236 AS database_port, 'conn-1' AS connection_hint, k::DOUBLE AS used_time_ms, cls AS caused_by_class, msg AS caused_by_message, (event_id * 4 + 1)::INT AS start_line FROM e")
def jdbc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jdbc_events(spark, sf_dir).select("source_file", "event_id", "timestamp", "level", "exception_class", "message", "event_type", "tid", "thread_name", "database_host", "database_port", "connection_hint", "used_time_ms", "caused_by_class", "caused_by_message", "start_line")


@query(f"SELECT event_id, cls, msg, kind FROM ({fault_rows(views.DUCK)})")
def jdbc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(fault_rows(views.SPARK).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = rows.withColumns({"a": F.lit("dm.jdbc.driver.DMException"), "b": F.lit("wrapped")})
    return rows.select("event_id", "cls", "msg", logtext.classify("a", "b", "cls", "msg").alias("kind"))


@query(f"""WITH RECURSIVE {PARSED}, n AS (SELECT *, row_number() OVER (PARTITION BY source_file, kind, user_id % 3, msg ORDER BY event_id) AS rn FROM e),
walk AS (
  SELECT source_file, kind, user_id % 3 AS pool, msg, rn, event_no, [struct_pack(head := event_no, f := ts, l := ts)] AS gs, 1 AS place FROM n WHERE rn = 1
  UNION ALL
  SELECT n.source_file, n.kind, w.pool, n.msg, n.rn, n.event_no,
         CASE WHEN hit IS NULL THEN list_append(w.gs, struct_pack(head := n.event_no, f := n.ts, l := n.ts)) ELSE list_concat(list_concat(w.gs[1:hit - 1], [struct_pack(head := w.gs[hit].head, f := w.gs[hit].f, l := n.ts)]), w.gs[hit + 1:]) END,
         coalesce(hit, len(w.gs) + 1)
  FROM (SELECT w0.*, m.event_no AS en, m.ts AS ts2, list_max(list_transform(list_filter(range(1, len(w0.gs) + 1), lambda i: abs(m.ts - w0.gs[i].f) <= 3 AND abs(m.ts - w0.gs[i].l) <= 3), lambda i: i)) AS hit
        FROM walk w0 JOIN n m ON m.source_file = w0.source_file AND m.kind = w0.kind AND m.user_id % 3 = w0.pool AND m.msg = w0.msg AND m.rn = w0.rn + 1) w
  JOIN n ON n.source_file = w.source_file AND n.event_no = w.en)
SELECT source_file, event_no AS event_id, gs[place].head AS head, count(*) OVER (PARTITION BY source_file, gs[place].head) AS occurrence_count FROM walk""")
def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouping.assign_groups(jdbc_events(spark, sf_dir))
    head = g.where("is_group_primary").select("source_file", "group_id", F.col("event_id").alias("head"))
    return g.join(head, ["source_file", "group_id"]).select("source_file", "event_id", "head", "occurrence_count")


REDACTED = "'user=u' || user_id || ' password=p' || k || '; access_token: t' || k || ' Authorization: Bearer z' || event_id"


@query(f"SELECT event_id, 'user=u' || user_id || ' password=***; access_token:*** Authorization: Bearer ***' AS text FROM ({views.base(views.DUCK)})")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(views.base(views.SPARK).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.select("event_id", logtext.redact(F.expr(REDACTED)).alias("text"))


@query(f"SELECT event_id, sha256(CASE k % 3 WHEN 0 THEN 'p' || k WHEN 1 THEN 'zz' || k ELSE '' END) AS payload_sha256 FROM ({views.base(views.DUCK)})")
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(views.base(views.SPARK).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    shown = rows.withColumn("payload_hex", F.expr("CASE k % 3 WHEN 0 THEN hex('p' || k) WHEN 1 THEN 'zz' || k END"))
    return shown.select("event_id", P.payload_sha256().alias("payload_sha256"))


@query(f"SELECT frame_number, timestamp, src_ip, dst_ip, src_port, dst_port, tcp_flags, tcp_seq, tcp_ack, tcp_window, tcp_len, tcp_stream FROM ({views.cte('single')}) WHERE frame_number % 7 <> 0")
def field_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.view(spark, sf_dir, "single")
    shown = F.concat_ws("|", "frame_number", "timestamp", "frame_len", "cap_len", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_stream", F.concat(F.lit("0x"), F.lpad(F.hex("tcp_flags"), 4, "0")), F.when(F.col("frame_number") % 7 == 0, F.lit("bad")).otherwise(F.col("tcp_seq").cast("string")), "tcp_ack", "tcp_window", "tcp_len", F.lit("61:62"))
    return fieldtext.parse(p.select(F.lit("c0").alias("capture_id"), F.col("pkt_ord").alias("line_no"), shown.alias("value"))).select("frame_number", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_window", "tcp_len", "tcp_stream")


# -- events against connections --------------------------------------------------------------

EVENT_ROWS = "SELECT 'E' || cast(event_id AS {str}) AS event_id, event_id AS event_ord, t AS timestamp, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '10.9.0.2' ELSE '10.9.0.1' END AS database_host, CASE WHEN k % 7 = 0 THEN NULL ELSE 5236 END AS database_port, {kind} AS event_type, {cls} AS caused_by_class, {msg} AS caused_by_message FROM ({base}) WHERE event_type = 'error'"
"""The errors that serve as logged events of the correlation queries: every packet with an error."""


def event_rows(d: dict) -> str:
    return EVENT_ROWS.format(str=d["str"], kind=by_fault(2), cls=by_fault(0), msg=by_fault(1), base=views.base(d))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(event_rows(views.SPARK).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("exception_class", "message", "source_file", "thread_name", "connection_hint", "timestamp_raw", "start_line", "end_line")}).withColumn("source_file", F.lit("log"))


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Dual, DataFrame, DataFrame]:
    d, e = pair(spark, sf_dir), event_table(spark, sf_dir)
    counts = correlate.accounting(e, d.flows)
    return e, d, correlate.candidates(e, d.flows, d.app.directed, d.app.anomalies, counts=counts), counts


ELIGIBLE = f"""{FLOWS}, ev AS ({event_rows(views.DUCK)}),
ep AS (SELECT ev.event_id, ev.timestamp AS t0, database_host AS host, database_port AS port, fl.* FROM ev JOIN fl ON coalesce(database_host, '{views.SERVER_IP}') = '{views.SERVER_IP}'),
el AS (SELECT *, CASE WHEN host IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN port IS NOT NULL THEN 30 ELSE 0 END + 40 AS fixed FROM ep WHERE app_start - 5 <= t0 AND t0 <= app_end + 5),
near AS (
  SELECT event_id, app_stream, count(*) FILTER (abs(p.timestamp - t0) <= 10) AS n, min(abs(p.timestamp - t0)) AS d, arg_min(p.frame_number, (abs(p.timestamp - t0), p.pkt_ord)) AS frame
  FROM el JOIN ap p ON p.session_id = el.app_stream GROUP BY ALL)"""


SCORED = f"""{ELIGIBLE}, {", ".join([pk("app"), RETX, STALL, RESET, ZERO, SHAKE, SESSION, SUMMARY, ANOMALY])},
hl AS (SELECT session_id, count(DISTINCT type) AS kinds FROM an WHERE session_id IS NOT NULL GROUP BY ALL),
sc AS (
  SELECT el.*, n, d, frame, fixed + CASE WHEN n > 0 THEN greatest(0, 15 * (1 - least(d, 10) / 10)) + least(5, 0.1::DOUBLE * n) ELSE 0 END AS identity, coalesce(least(5, 1 + 0.25::DOUBLE * kinds), 0) AS health
  FROM el JOIN near USING (event_id, app_stream) LEFT JOIN hl ON hl.session_id = el.app_stream),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY identity DESC, d, health DESC, app_stream, db_stream) AS rank FROM sc)"""


@query(f"""WITH {SCORED} SELECT event_id, correlation_id, app_stream, n AS packets_near, round(d, 6) AS distance, frame AS nearest_frame, round(identity + 1e-7, 4) AS identity_score, health AS health_score,
round(identity + 0.01::DOUBLE * health + 1e-7, 4) AS total_score, rank FROM rk""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eligible flow of every error event, ranked."""
    d = pair(spark, sf_dir)
    c = correlate.every_candidate(event_table(spark, sf_dir), d.flows, d.app.directed, d.app.anomalies)
    rounded = lambda c, n: F.floor(c * 10**n + 0.5) / 10**n  # noqa: E731  halves as doubles have them, not as their decimal text
    points = lambda c: rounded(F.col(c) + 1e-7, 4).alias(c)
    return c.select("event_id", "correlation_id", "app_stream", "packets_near", rounded(F.col("distance"), 6).alias("distance"), F.col("nearest.frame_number").alias("nearest_frame"), points("identity_score"), "health_score", points("total_score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {ELIGIBLE}, c AS (SELECT event_id, count(*) AS n FROM ep GROUP BY ALL), l AS (SELECT event_id, count(*) AS n FROM el GROUP BY ALL)
SELECT ev.event_id, (SELECT count(*) FROM fl) AS flows_considered, (SELECT count(*) FROM fl) - coalesce(c.n, 0) AS filtered_endpoint, coalesce(c.n, 0) - coalesce(l.n, 0) AS filtered_time, coalesce(l.n, 0) AS eligible_count
FROM ev LEFT JOIN c USING (event_id) LEFT JOIN l USING (event_id)""")
def candidate_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.accounting(event_table(spark, sf_dir), pair(spark, sf_dir).flows)


@query(f"""WITH {SCORED},
st AS (SELECT event_id, count(*) AS n, max(identity) AS best, max(identity) FILTER (rank = 2) AS second, count(*) FILTER (identity >= 60) AS covering, arg_min(correlation_id, rank) AS correlation_id, arg_min(frame, rank) AS frame FROM rk GROUP BY ALL)
SELECT ev.event_id, CASE WHEN st.n IS NULL THEN 'NO_MATCH' WHEN st.n > 1 AND (best < 70 OR (second >= best - 8 AND second >= 60) OR covering > 1) THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS correlation_status,
       correlation_id, frame AS nearest_tcp_frame, round(best + 1e-7, 4) AS identity_score, coalesce(st.n, 0) AS eligible_count, least(coalesce(st.n, 0), 10) AS candidate_count
FROM ev LEFT JOIN st USING (event_id)""")
def correlation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, c, counts = scored(spark, sf_dir)
    out = correlate.correlate(e, c, counts)
    return out.select("event_id", "correlation_status", "correlation_id", "nearest_tcp_frame", F.round(F.col("identity_score") + 1e-7, 4).alias("identity_score"), "eligible_count", "candidate_count")


def chosen_rows(spark: SparkSession, sf_dir: str, key: DataFrame | None = None) -> tuple[DataFrame, Dual, DataFrame]:
    """Events (those of key, where it is given) tied to the flow of their own user, so that the timeline's SQL needs no ranking."""
    d, e = pair(spark, sf_dir), event_table(spark, sf_dir)
    if key is not None:
        e = e.join(F.broadcast(key.select("event_id")), "event_id", "left_semi")  # one row
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("E"), "event_id").alias("event_id"), "user_id")
    return e, d, e.join(ids, "event_id").join(d.flows, F.col("user_id") == F.col("app_stream")).withColumn("evidence_level", F.lit("STRONG"))


@query(f"""WITH {segments_sql('app', 'db')}, ev AS ({event_rows(views.DUCK)}), ch AS (SELECT ev.*, fl.* FROM ev JOIN events ON ev.event_id = 'E' || events.event_id JOIN fl ON app_stream = user_id),
mk AS (
  SELECT 'APP' AS side, session_id, timestamp AS ts, frame_number, tcp_flags FROM ap UNION ALL SELECT 'DB', session_id, timestamp, frame_number, tcp_flags FROM dp),
lb AS (SELECT *, CASE WHEN (tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0 THEN 'SYN' WHEN (tcp_flags & 2) <> 0 THEN 'SYN_ACK' WHEN (tcp_flags & 1) <> 0 THEN 'FIN' WHEN (tcp_flags & 4) <> 0 THEN 'RST' END AS label FROM mk)
SELECT event_id, ts AS timestamp, ts - timestamp AS relative_seconds, side || '_PCAP' AS source, label AS event_type, frame_number AS frame, correlation_id
FROM ch JOIN lb ON (side = 'APP' AND session_id = app_stream) OR (side = 'DB' AND session_id = db_stream)
WHERE label IS NOT NULL AND (abs(ts - timestamp) <= 30 OR (label IN ('SYN', 'SYN_ACK') AND abs(ts - timestamp) <= 120))
UNION ALL SELECT event_id, timestamp, 0.0, 'JDBC', event_type, NULL, NULL FROM ch""")
def timeline_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, chosen = chosen_rows(spark, sf_dir)
    t = timeline.timeline(e, chosen, {"APP": d.app.side(), "DB": d.db.side()}, d.segments)
    return t.where("source = 'JDBC' OR event_type IN ('SYN', 'SYN_ACK', 'FIN', 'RST')").select("event_id", "timestamp", "relative_seconds", "source", "event_type", "frame", "correlation_id")


@query()
def timeline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, chosen = chosen_rows(spark, sf_dir)
    return timeline.timeline(e, chosen, {"APP": d.app.side(), "DB": d.db.side()}, d.segments)


def kinds_sql(view: str) -> str:
    """Data sent again, and stalls, of a view, at the time of their first packet."""
    return f"""(WITH {pk(view)}, {RETX}, {STALL}
  SELECT r.session_id, 'DATA_RETRANSMISSION' AS kind, p.timestamp AS ts FROM r JOIN p ON p.pkt_ord = r.first_ord WHERE plane = 'data'
  UNION ALL SELECT s.session_id, 'ACK_STALLED', p.timestamp FROM s JOIN p ON p.session_id = s.session_id AND p.frame_number = s.frames[1])"""


EVIDENCE_SEGMENTS = f"""(WITH {segments_sql('app', 'db')} SELECT ex.c, a0.ts FROM ex JOIN a0 ON (a0.c, a0.direction, a0.seq, a0.len, a0.h) = (ex.c, ex.direction, ex.seq, ex.len, ex.h) WHERE ex.h IS NOT NULL)"""


def found_sql(view: str) -> str:
    """Findings of a view's sessions at the time of their first packet, or else in the middle of their session."""
    return f"""(WITH {", ".join([pk(view), RETX, STALL, RESET, ZERO, SHAKE, SESSION, SUMMARY, ANOMALY])}
  SELECT an.session_id, an.type, coalesce(p.timestamp, (f.start_time + f.end_time) / 2) AS ts FROM an JOIN f USING (session_id) LEFT JOIN p ON p.session_id = an.session_id AND p.frame_number = an.frames[1])"""


@query(f"""WITH {FLOWS}, ev AS ({event_rows(views.DUCK)}), ch AS (SELECT ev.event_id, ev.event_type, ev.timestamp AS t0, fl.* FROM ev JOIN events ON ev.event_id = 'E' || events.event_id JOIN fl ON app_stream = user_id),
en AS (
  SELECT event_id, 'JDBC' AS source, event_type, NULL AS correlation_id, 0.0 AS gap FROM ch
  UNION ALL SELECT event_id, side || '_PCAP', CASE WHEN (tcp_flags & 18) = 2 THEN 'SYN' WHEN (tcp_flags & 2) <> 0 THEN 'SYN_ACK' WHEN (tcp_flags & 1) <> 0 THEN 'FIN' ELSE 'RST' END AS label, correlation_id, timestamp - t0
    FROM ch JOIN (SELECT 'APP' AS side, * FROM ap UNION ALL SELECT 'DB', * FROM dp) m ON (side = 'APP' AND session_id = app_stream) OR (side = 'DB' AND session_id = db_stream)
    WHERE (tcp_flags & 7) <> 0 AND (abs(timestamp - t0) <= 30 OR ((tcp_flags & 2) <> 0 AND abs(timestamp - t0) <= 120))
  UNION ALL SELECT event_id, side || '_PCAP', type, correlation_id, ts - t0
    FROM ch JOIN (SELECT 'APP' AS side, * FROM {found_sql("app")} UNION ALL SELECT 'DB', * FROM {found_sql("db")}) k ON (side = 'APP' AND session_id = app_stream) OR (side = 'DB' AND session_id = db_stream) WHERE abs(ts - t0) <= 90
  UNION ALL SELECT event_id, 'DUAL', 'MATCHED_SEGMENT', correlation_id, ts - t0 FROM ch JOIN {EVIDENCE_SEGMENTS} g ON c = correlation_id WHERE abs(ts - t0) <= 30)
SELECT event_id, source, event_type, correlation_id, count(*) AS n, round(min(gap), 6) AS first_seconds, round(max(gap), 6) AS last_seconds FROM en GROUP BY ALL""")
def timeline_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the timeline of each event holds, by source, kind and flow."""
    e, d, chosen = chosen_rows(spark, sf_dir)
    t = timeline.timeline(e, chosen, {"APP": d.app.side(), "DB": d.db.side()}, d.segments).where("event_type <> 'CAPTURE_QUALITY'")
    return t.groupBy("event_id", "source", "event_type", "correlation_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("relative_seconds"), 6).alias("first_seconds"), F.round(F.max("relative_seconds"), 6).alias("last_seconds"))


# -- ping ------------------------------------------------------------------------------------

SAMPLES = "SELECT t AS timestamp, CASE WHEN k % 3 = 0 THEN NULL ELSE '10.9.0.1' END AS target_host, CASE k % 8 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'UNREACHABLE' WHEN 3 THEN 'ERROR' ELSE 'REPLY' END AS status, CASE WHEN k % 8 > 3 THEN k / 8.0D0 END AS rtt_ms, cast(event_id AS int) AS source_line FROM ({base}) WHERE event_type = 'view'"


def sample_rows(d: dict) -> str:
    return SAMPLES.format(base=views.base(d)).replace("8.0D0", "8.0D" if d is views.SPARK else "8.0::DOUBLE")


def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sample_rows(views.SPARK).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


PING = f"ev AS ({event_rows(views.DUCK)}), sa AS ({sample_rows(views.DUCK)}), nr AS (SELECT event_id, ev.timestamp AS t0, sa.* FROM ev JOIN sa ON abs(sa.timestamp - ev.timestamp) <= 30)"


@query(f"""WITH {PING}, i AS (SELECT event_id, count(*) AS samples, count(*) FILTER (status = 'REPLY') AS replies, count(*) FILTER (status = 'TIMEOUT') AS timeouts, min(rtt_ms) AS min_rtt_ms, max(rtt_ms) AS max_rtt_ms FROM nr GROUP BY ALL)
SELECT ev.event_id, coalesce(samples, 0) AS samples, coalesce(replies, 0) AS replies, coalesce(timeouts, 0) AS timeouts, min_rtt_ms, max_rtt_ms,
       (SELECT max(timestamp) FROM sa WHERE status = 'REPLY' AND sa.timestamp <= ev.timestamp) AS last_reply_before, (SELECT min(timestamp) FROM sa WHERE status = 'REPLY' AND sa.timestamp >= ev.timestamp) AS first_reply_after,
       (SELECT max(timestamp) FROM sa WHERE status = 'TIMEOUT' AND sa.timestamp <= ev.timestamp) AS nearest_timeout_before, (SELECT min(timestamp) FROM sa WHERE status = 'TIMEOUT' AND sa.timestamp >= ev.timestamp) AS nearest_timeout_after
FROM ev LEFT JOIN i USING (event_id)""")
def ping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ping.statistics(event_table(spark, sf_dir), sample_table(spark, sf_dir)).select("event_id", "samples", "replies", "timeouts", "min_rtt_ms", "max_rtt_ms", "last_reply_before", "first_reply_after", "nearest_timeout_before", "nearest_timeout_after")


@query(f"""WITH {PING}, o AS (SELECT *, sum(CASE WHEN status <> 'TIMEOUT' THEN 1 ELSE 0 END) OVER w AS run, count(*) FILTER (status = 'TIMEOUT') OVER w AS tn, max(CASE WHEN status = 'TIMEOUT' THEN timestamp END) OVER w AS lt FROM nr WINDOW w AS (PARTITION BY event_id ORDER BY timestamp, source_line))
SELECT event_id, min(timestamp) AS timestamp, 'PING_TIMEOUT' AS event_type, count(*) || ' consecutive ICMP timeout(s) starting' AS description FROM o WHERE status = 'TIMEOUT' GROUP BY event_id, run
UNION ALL SELECT event_id, min(timestamp), 'PING_RECOVERY', 'ICMP replies resumed after timeout(s)' FROM o WHERE status = 'REPLY' AND timestamp - lt <= 5 GROUP BY event_id, tn
UNION ALL SELECT event_id, min(timestamp) FILTER (status = 'REPLY'), 'PING_REPLY_STABLE', count(*) FILTER (status = 'REPLY') || ' ICMP replies in window (no timeouts)' FROM nr GROUP BY event_id HAVING count(*) FILTER (status = 'TIMEOUT') = 0 AND count(*) FILTER (status = 'REPLY') > 0""")
def ping_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ping.markers(event_table(spark, sf_dir), sample_table(spark, sf_dir)).select("event_id", "timestamp", "event_type", "description")


@query()
def unified_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key event's timeline with the different ping markers of all events."""
    every = event_table(spark, sf_dir)
    key = timeline.key_event(every)
    e, d, chosen = chosen_rows(spark, sf_dir, key)
    t = timeline.timeline(e, chosen, {"APP": d.app.side(), "DB": d.db.side()}, d.segments)
    return timeline.unified(t, ping.distinct_markers(every, sample_table(spark, sf_dir)), key)


@query(f"""WITH {SCORED},
st AS (SELECT event_id, count(*) AS n, max(identity) AS best, max(identity) FILTER (rank = 2) AS second, count(*) FILTER (identity >= 60) AS covering FROM rk GROUP BY ALL),
cs AS (SELECT event_id, best, CASE WHEN n > 1 AND (best < 70 OR (second >= best - 8 AND second >= 60) OR covering > 1) THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status FROM st),
way AS (SELECT rk.event_id, rk.t0, rk.correlation_id, rk.app_stream, rk.db_stream FROM rk JOIN cs USING (event_id) WHERE rank = 1 OR (status = 'AMBIGUOUS' AND rank BETWEEN 2 AND 4 AND identity >= best - 10)),
tm AS (
  SELECT event_id, correlation_id, kind, ts FROM way JOIN {kinds_sql("app")} k ON k.session_id = app_stream WHERE abs(ts - t0) <= 90
  UNION ALL SELECT event_id, correlation_id, kind, ts FROM way JOIN {kinds_sql("db")} k ON k.session_id = db_stream WHERE abs(ts - t0) <= 90
  UNION ALL SELECT event_id, correlation_id, 'MATCHED_SEGMENT', ts FROM way JOIN {EVIDENCE_SEGMENTS} g ON c = correlation_id WHERE abs(ts - t0) <= 30
  UNION ALL SELECT event_id, correlation_id, CASE WHEN (tcp_flags & 1) <> 0 THEN 'FIN' ELSE 'RST' END, timestamp
    FROM way JOIN (SELECT 'a' AS side, * FROM ap UNION ALL SELECT 'd', * FROM dp) m ON (side = 'a' AND session_id = app_stream) OR (side = 'd' AND session_id = db_stream)
    WHERE (tcp_flags & 2) = 0 AND (tcp_flags & 5) <> 0 AND abs(timestamp - t0) <= 30),
co AS (
  SELECT event_id, 0 AS place, NULL AS ts, 'FIRST_CANDIDATE' AS kind, correlation_id, 'AMBIGUOUS' AS confidence FROM rk JOIN cs USING (event_id) WHERE status = 'AMBIGUOUS' AND rank = 1
  UNION ALL SELECT rk.event_id, 1, rank, 'NEAR_TIE', rk.correlation_id, 'AMBIGUOUS' FROM rk JOIN cs USING (event_id) JOIN (SELECT event_id, identity + 0.01::DOUBLE * health AS top FROM rk WHERE rank = 1) t ON t.event_id = rk.event_id
    WHERE status = 'AMBIGUOUS' AND rank BETWEEN 2 AND 5 AND identity + 0.01::DOUBLE * health >= top - 10
  UNION ALL SELECT event_id, 2, ts, kind, correlation_id, 'CONFIRMED' FROM tm),
cut AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY place, ts, kind, correlation_id) AS item FROM co)
SELECT event_id, 'CORRELATED_EVIDENCE' AS evidence_class, kind, correlation_id, confidence, count(*) AS n FROM cut WHERE item <= 40 GROUP BY ALL
UNION ALL SELECT event_id, class, kind, NULL, confidence, n FROM ev, (VALUES ('CONFIRMED_FACTS', 'LOGGED_EVENT', 'CONFIRMED', 1), ('CONFIRMED_FACTS', 'APP_CAPTURE', 'CONFIRMED', 1), ('CONFIRMED_FACTS', 'DB_CAPTURE', 'CONFIRMED', 1), ('CONFIRMED_FACTS', 'PING_COUNTS', 'CONFIRMED', 1),
  ('SUPPORTING_EVIDENCE', 'PING_SUMMARY', 'SUPPORTING_EVIDENCE', 1), ('SUPPORTING_EVIDENCE', 'PING_CAUTION', 'SUPPORTING_EVIDENCE', 1), ('UNKNOWN', 'CAVEAT', NULL, 3)) v(class, kind, confidence, n)
UNION ALL SELECT event_id, 'CONFIRMED_FACTS', 'SELECTED_FLOW', correlation_id, 'STRONG', 1 FROM rk JOIN cs USING (event_id) WHERE status = 'MATCHED' AND rank = 1
UNION ALL SELECT event_id, 'UNKNOWN', 'NO_UNIQUE_FLOW', NULL, NULL, 1 FROM cs WHERE status = 'AMBIGUOUS'""")
def case_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every event, counted by kind and flow."""
    c = Case(pair(spark, sf_dir), event_table(spark, sf_dir), sample_table(spark, sf_dir))
    return c.all_evidence.groupBy("event_id", "evidence_class", "kind", "correlation_id", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH ev AS ({event_rows(views.DUCK)}) SELECT arg_max(event_id, (event_type = 'CONNECTION_RESET', event_ord)) AS key_event, arg_max(event_id, (event_type = 'CONNECTION_RESET', -event_ord)) AS first_key_event FROM ev""")
def key_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_table(spark, sf_dir)
    return timeline.key_event(e).select(F.col("event_id").alias("key_event")).join(timeline.key_event(e, first=True).select(F.col("event_id").alias("first_key_event")))


#: Hops that a packet has left, by its side: as captured at the database, so that its own packets still have what they began with.
TTL = "CASE WHEN src_ip = '{server}' THEN CASE WHEN event_id % 50 = 0 THEN 63 ELSE 64 END ELSE 57 - event_id % 3 END"
LOOKS = {"both": "true", "none": "false", "toward": "dst_ip = '{server}'"}


def looks_sql(look: str, ttl: bool) -> str:
    """Counts, times, usual hops and role of the packets of a look; ttl: whether hops are known."""
    s, where = views.SERVER_IP, LOOKS[look].format(server=views.SERVER_IP)
    usual = lambda at: f"(SELECT arg_max(ttl, n * 1e9 - o) FROM (SELECT ttl, count(*) AS n, min(pkt_ord) AS o FROM {{p}} WHERE ttl IS NOT NULL AND {at} = '{s}' GROUP BY ttl))"
    p = f"(SELECT *, {TTL.format(server=s) if ttl else 'NULL::INT'} AS ttl FROM (SELECT *, pkt_ord - 1 AS event_id FROM ({views.cte('single')})) WHERE {where})"
    return f"""SELECT '{look}' AS look, {str(ttl).lower()} AS hops, packets, to_server, from_server, time_start, time_end, server_ttl, client_ttl,
  CASE WHEN client_ttl IN (32, 64, 128, 255) AND client_ttl > server_ttl THEN 'APP' WHEN server_ttl IN (32, 64, 128, 255) AND server_ttl > client_ttl THEN 'DB' WHEN to_server = 0 AND from_server = 0 THEN 'AMBIGUOUS'
       WHEN to_server >= 3 AND to_server >= 2 * from_server THEN 'APP' WHEN from_server >= 3 AND from_server >= 2 * to_server THEN 'DB' ELSE 'AMBIGUOUS' END AS role
FROM (SELECT count(*) AS packets, count(*) FILTER (dst_ip = '{s}') AS to_server, count(*) FILTER (src_ip = '{s}') AS from_server, min(timestamp) AS time_start, max(timestamp) AS time_end, {usual("src_ip").format(p=p)} AS server_ttl, {usual("dst_ip").format(p=p)} AS client_ttl FROM {p})"""


@query(" UNION ALL ".join(looks_sql(look, ttl) for look in LOOKS for ttl in (True, False)))
def role_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of a capture by hops and by counts: of all packets, of those toward the server only, and of none."""
    parts = []
    for look, where in LOOKS.items():
        for ttl in (True, False):
            p = views.view(spark, sf_dir, "single").withColumn("event_id", F.col("pkt_ord") - 1).where(where.format(server=views.SERVER_IP))
            p = p.withColumn("ttl", (F.expr(TTL.format(server=views.SERVER_IP)) if ttl else F.lit(None)).cast("int"))
            parts.append(roles.probe(p, views.SERVER_IP, views.DB_PORT, max_packets=None).select(F.lit(look).alias("look"), F.lit(ttl).alias("hops"), "packets", "to_server", "from_server", "time_start", "time_end", "server_ttl", "client_ttl", "role"))
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT coalesce(nullif(concat_ws(',', CASE WHEN (tcp_flags & 2) <> 0 THEN 'SYN' END, CASE WHEN (tcp_flags & 16) <> 0 THEN 'ACK' END, CASE WHEN (tcp_flags & 1) <> 0 THEN 'FIN' END, CASE WHEN (tcp_flags & 4) <> 0 THEN 'RST' END, CASE WHEN (tcp_flags & 8) <> 0 THEN 'PSH' END), ''), '.') AS flags, count(*) AS packets, sum(tcp_len)::BIGINT AS bytes FROM ({views.cte('single')}) GROUP BY ALL")
def flags_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, "single").groupBy(P.flags_text().alias("flags")).agg(F.count(F.lit(1)).alias("packets"), F.sum("tcp_len").alias("bytes"))


@query(f"""WITH {SCORED},
st AS (SELECT event_id, count(*) AS n, max(identity) AS best, max(identity) FILTER (rank = 2) AS second, count(*) FILTER (identity >= 60) AS covering FROM rk GROUP BY ALL)
SELECT event_id, correlation_id, rank, round(identity + 1e-7, 4) AS identity_score FROM rk JOIN st USING (event_id)
WHERE st.n > 1 AND (best < 70 OR (second >= best - 8 AND second >= 60) OR covering > 1) AND rank BETWEEN 2 AND 4 AND identity >= best - 10""")
def near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of ambiguous events that come close to the first."""
    e, _, c, counts = scored(spark, sf_dir)
    close = correlate.near_ties(correlate.correlate(e, c, counts), c)
    return close.select("event_id", "correlation_id", F.col("rank").cast("long").alias("rank"), F.round(F.col("identity_score") + 1e-7, 4).alias("identity_score"))


@query(f"WITH {PARSED} SELECT source_file, count(*) AS events, count(DISTINCT kind) AS kinds, max(kind) FILTER (kind = 'CONNECTION_RESET') AS resets FROM e GROUP BY source_file")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = jdbc_events(spark, sf_dir)
    return e.groupBy("source_file").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("kinds"), F.max(F.when(F.col("event_type") == "CONNECTION_RESET", F.col("event_type"))).alias("resets"))
