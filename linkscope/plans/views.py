"""Packet-shaped views of the events table, once for Spark and once for DuckDB.

The tables at hand hold no packets, so the queries derive them: every event is a packet of the
stream of its user. SPARK and DUCK differ in three functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names of the functions that the two dialects spell differently.
SPARK = {"k": "int(get_json_object(props, '$.k'))", "us": "unix_micros(cast(ts AS timestamp))", "sha": lambda x: f"sha2(cast({x} AS binary), 256)", "str": "string"}
DUCK = {"k": "cast(json_extract(props, '$.k') AS int)", "us": "epoch_us(ts)", "sha": lambda x: f"sha256({x})", "str": "varchar"}

SERVER_IP, DB_PORT = "10.9.0.1", 5236


def base(d: dict) -> str:
    return f"SELECT event_id, user_id, event_type, ({d['us']} - 1704067200000000) / 3.6e9 AS t, {d['k']} AS k FROM events"


def packets(d: dict, capture: str = "c0", tag: str = "k % 5", known: str = "true", shift: str = "0.0", stream: str = "user_id", keep: str = "true", seq: str = "1000 + 100 * (k % 5)", ports: int = 1000000) -> str:
    """SQL of a packet view; tag names the payload."""
    client, port = f"'10.0.0.' || cast(user_id % 250 % {ports} AS {d['str']})", f"cast(40000 + user_id % {ports} AS int)"
    flags = "CASE event_type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 18 END WHEN 'error' THEN CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 17 WHEN 2 THEN 4 ELSE 16 END WHEN 'view' THEN 16 ELSE 24 END"
    sent = d["sha"](f"'p' || cast({tag} AS {d['str']})")
    return f"""
      SELECT '{capture}' AS capture_id, event_id + 1 AS pkt_ord, t - {shift} AS timestamp,
             CASE WHEN k % 2 = 1 THEN '{SERVER_IP}' ELSE {client} END AS src_ip, CASE WHEN k % 2 = 1 THEN {client} ELSE '{SERVER_IP}' END AS dst_ip,
             CASE WHEN k % 2 = 1 THEN {DB_PORT} ELSE {port} END AS src_port, CASE WHEN k % 2 = 1 THEN {port} ELSE {DB_PORT} END AS dst_port,
             {flags} AS tcp_flags, cast({seq} AS bigint) AS tcp_seq, cast(1000 + 50 * (k % 12) AS bigint) AS tcp_ack,
             cast(CASE WHEN k % 10 = 0 THEN 0 ELSE 65535 END AS bigint) AS tcp_window, CASE WHEN event_type IN ('click', 'purchase') THEN 10 + k % 3 ELSE 0 END AS tcp_len,
             event_id + 1 AS frame_number, {stream} AS tcp_stream, 100 AS frame_len, CASE WHEN k % 9 = 0 AND {known} THEN 64 ELSE 100 END AS cap_len,
             {sent} AS payload_sha256, {tag} IS NOT NULL AS payload_known
      FROM ({base(d)}) WHERE {keep}"""


RAW = "cast(k % 10 AS int)"
APP_TAG = f"CASE WHEN k % 9 = 0 THEN NULL ELSE {RAW} END"
DB_TAG = f"CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN {RAW} WHEN event_id % 11 = 0 THEN {RAW} + 100 ELSE {APP_TAG} END"
#: Views by name: arguments of packets(). Those of the dual pair share 4-tuples among sessions ("reuse") or give each its own.
VIEWS = {
    "single": {},
    "app": {"capture": "app", "tag": APP_TAG, "known": "false"},
    "db": {"capture": "db", "tag": DB_TAG, "known": "false", "shift": "1.5", "stream": "user_id + 1000", "keep": "event_id % 10 <> 3 AND user_id % 17 <> 0"},
    "app_reuse": {"capture": "app", "tag": APP_TAG, "known": "false", "ports": 40},
    "db_reuse": {"capture": "db", "tag": DB_TAG, "known": "false", "shift": "1.5", "stream": "user_id + 1000", "keep": "event_id % 10 <> 3 AND user_id % 17 <> 0 AND (user_id % 3 > 0 OR t > 100)", "ports": 40},
    "app_clock": {"capture": "app", "tag": "k % 5", "known": "false", "seq": "1000 + 20 * event_id"},
    "db_clock": {"capture": "db", "tag": "k % 5", "known": "false", "seq": "1000 + 20 * event_id", "shift": "1.5", "stream": "user_id + 1000", "keep": "event_id % 10 <> 3"},
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(packets(SPARK, **VIEWS[name]).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def cte(name: str) -> str:
    return packets(DUCK, **VIEWS[name])
