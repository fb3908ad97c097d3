"""Tables as CSV, JSON and payload files. Spark writes folders, so results of any size can go out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logtext import redact


def flat(df: DataFrame) -> DataFrame:
    """df with arrays joined by blanks and structs as JSON; nulls are written as empty."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.array_join(c.cast("array<string>"), " ") if kind == "array" else F.to_json(c) if kind in ("struct", "map") else c).alias(f.name))
    return df.select(out)


def write_csv(df: DataFrame, path: str, redacted: tuple[str, ...] = ("description", "message", "caused_by_message", "stack_summary", "raw_excerpt")) -> None:
    """One folder of CSV with a header; columns that hold log text are redacted."""
    df = flat(df)
    df.select([redact(c).alias(c) if c in redacted else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def flows_table(summaries: DataFrame) -> DataFrame:
    """Session summaries as they are exported: N/A for a latency that is unknown."""
    renamed = summaries.withColumnsRenamed({"rst_seen": "RST", "fin_seen": "FIN", "zero_window": "Zero_Window"})
    return renamed.withColumn("handshake_latency_ms", F.coalesce(F.col("handshake_latency_ms").cast("string"), F.lit("N/A"))).drop("session_ord")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def payload_rows(packets: DataFrame, retx: DataFrame) -> DataFrame:
    """The first packet of each data segment that was sent again and whose payload is known: a file name and its bytes, as captured."""
    keys = ["capture_id", "session_id", "direction", "tcp_seq", "tcp_len"]
    wanted = retx.where("plane = 'data'").select("capture_id", "session_id", "direction", F.col("seq").alias("tcp_seq"), "tcp_len").distinct()
    hex_ok = F.col("payload_hex").rlike("^([0-9A-Fa-f]{2})+$")
    cut = F.coalesce(F.col("cap_len") < F.col("frame_len"), F.lit(False))
    first = packets.where(hex_ok).join(wanted, keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct("payload_hex", "frame_number", cut.alias("truncated")), "pkt_ord").alias("p"))
    side = F.when(F.col("direction") == "client_to_server", "client").otherwise("server")
    name = F.format_string("stream_%d/%s_seq_%d_len_%d.bin", "session_id", side, "tcp_seq", "tcp_len")
    payload = F.unhex("p.payload_hex")
    return first.select(*keys, name.alias("file_name"), "p.frame_number", payload.alias("payload"), F.sha2(payload, 256).alias("sha256"), F.length(payload).alias("bytes_written"), "p.truncated")
