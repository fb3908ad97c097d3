"""Exception logs and ping logs as rows; lines come with their file and number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import logtext as L
from ..operators import scan
from ..stages import Stage
from .lines import numbered

#: The grammar of the logs.
HEADER = r"^\[(ERROR|WARN|INFO|DEBUG|SQL)\s*-\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]\s+tid:(\d+)\s+-\s+\[([^\]]+)\]\s*(.*)$"
EXCEPTION = r"(?U)^([\w.$]+(?:Exception|Error|Throwable))\s*:\s*(.*)$"
CAUSE = r"(?U)^Caused by:\s*([\w.$]+)\s*:\s*(.*)$"
#: What ends a line beside line feeds and carriage returns.
MORE_ENDS = r"[\x0B\f\x1C\x1D\x1E\x85\x{2028}\x{2029}]"
PING_LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\]\s*(.*)$"
LINUX_REPLY = r"(?i)\d+\s+bytes from ([\d.]+):\s*icmp_seq=(\d+)\s+ttl=(\d+)\s+time=([\d.]+)\s*ms"
WINDOWS_REPLY = r"(?i)Reply from ([\d.]+):\s*bytes=\d+\s*time(?:=|<)([\d.]+)ms\s*TTL=(\d+)"
NO_ANSWER = r"(?i)no answer yet for icmp_seq=(\d+)"
BANNER = r"(?i)Ping monitor started:\s*([\d.]+)|^PING\s+([\d.]+)"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, line_no and value of every line of the files under path, read in splits."""
    return numbered(spark, path, more_ends=MORE_ENDS)


def parse_jdbc(lines: DataFrame, default_host: str | None = None, default_port: int | None = None, timezone: str = "UTC", stage: Stage | None = None) -> DataFrame:
    """One row for each network fault: a header line of ERROR, or of WARN with an exception, and the lines up to the next header.

    Headers and events are counted in ranges of lines, so that a file of any size is many tasks.
    """
    stage = stage or Stage(lines.sparkSession, "log")
    lines = scan.ranged(lines, ["source_file"], ["line_no"], stage, "lines", readers=3)
    header = F.when(F.col("value").rlike(HEADER), 1).otherwise(0).cast("long")
    n = scan.running(lines, ["source_file"], ["line_no"], {"block": ("sum", header)}).drop(scan.PART).withColumn("is_header", F.col("value").rlike(HEADER)).where("block > 0")
    s = F.btrim("value", F.lit(" \t\r\x0b\f"))
    body = ~F.col("is_header") & (s != "")
    cause, exception = body & s.rlike(CAUSE), body & s.rlike(EXCEPTION) & ~s.startswith("at ") & ~s.rlike(CAUSE)
    n = n.withColumns({"s": s, "is_cause": cause, "is_exception": exception, "is_stack": body & (s.startswith("at ") | s.startswith("...") | s.startswith("Caused by:"))})
    first_exc = F.min(F.when(F.col("is_exception"), F.col("line_no"))).over(Window.partitionBy("source_file", "block"))
    n = n.withColumn("is_first", F.coalesce(F.col("line_no") == first_exc, F.lit(False)))
    bit = F.when(F.col("is_cause") | F.col("is_first"), F.substring(L.redact("s"), 1, 200)).when(F.col("is_stack"), F.substring(L.redact("s"), 1, 160))
    sort = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_no", c.alias("x")))), lambda x: x["x"])
    b = n.groupBy("source_file", "block").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by("value", "line_no").alias("header"), F.array_compact(sort(bit)).alias("bits"), sort(F.col("value")).alias("all_lines"),
        F.max_by("s", F.when(F.col("is_cause"), F.col("line_no"))).alias("cause_line"), F.min_by("s", F.when(F.col("is_first"), F.col("line_no"))).alias("exc_line"),
    )
    h, text = F.col("header"), F.array_join("all_lines", "\n")
    part = lambda i: F.regexp_extract(h, HEADER, i)
    # Hosts and ports named anywhere in the file serve events that name none.
    named = lines.where(F.col("value").contains("try connect success") | F.lower("value").contains("host=")).select("source_file", "line_no", L.host_port(F.col("value")).alias("hp"))
    fallback = named.groupBy("source_file").agg(F.min_by("hp.host", F.when(F.col("hp.host").isNotNull(), F.col("line_no"))).alias("g_host"), F.min_by("hp.port", F.when(F.coalesce(F.col("hp.port"), F.lit(0)) > 0, F.col("line_no"))).alias("g_port"))
    b = b.join(fallback, "source_file", "left").withColumns({"hp": L.host_port(part(5)), "block_hp": L.host_port(text)})
    lacks = F.col("hp.host").isNull() | F.col("hp.port").isNull()
    host = F.coalesce("hp.host", F.when(lacks, F.col("block_hp.host")), F.lit(default_host).cast("string"), "g_host")
    port = F.coalesce("hp.port", F.when(lacks, F.col("block_hp.port")), F.lit(default_port).cast("int"), "g_port")
    got = lambda line, pattern, i: F.when(F.col(line).isNotNull(), F.trim(F.regexp_extract(line, pattern, i)))
    e = b.select(
        "source_file", "start_line", "end_line", part(1).alias("level"), part(2).alias("timestamp_raw"), L.epoch(part(2), ("yyyy-MM-dd HH:mm:ss",), timezone).alias("timestamp"), part(3).alias("tid"), part(4).alias("thread_name"),
        got("exc_line", EXCEPTION, 1).alias("exception_class"), got("exc_line", EXCEPTION, 2).alias("raw_message"), got("cause_line", CAUSE, 1).alias("caused_by_class"), got("cause_line", CAUSE, 2).alias("raw_cause"),
        host.alias("database_host"), port.alias("database_port"), F.when(part(5).rlike(r"\{[^}]*\}"), F.trim(F.regexp_extract(part(5), r"\{\s*([^}]*)\}", 1))).alias("connection_hint"),
        L.found(part(5), r"(?i)\[USED TIME\]:\s*([\d.Ee+-]+)ms").try_cast("double").alias("used_time_ms"), F.array_join(F.slice("bits", 1, 12), " | ").alias("stack_summary"),
        F.substring(F.sha2(L.redact(F.array_join(F.slice("all_lines", 1, 40), "\n")), 256), 1, 16).alias("raw_excerpt_hash"), (text.contains("Exception") | text.contains("Caused by:")).alias("looks_thrown"),
    )
    e = e.where("level = 'ERROR' OR (level = 'WARN' AND looks_thrown AND (exception_class IS NOT NULL OR caused_by_class IS NOT NULL))")
    e = e.withColumn("event_type", L.classify("exception_class", "raw_message", "caused_by_class", "raw_cause")).where("event_type <> 'NOT_NETWORK'")
    e = e.withColumns({"message": L.redact("raw_message"), "caused_by_message": L.redact("raw_cause")}).drop("raw_message", "raw_cause", "looks_thrown")
    e = scan.ranged(e, ["source_file"], ["start_line"], stage, "faults", readers=2)
    e = scan.running(e, ["source_file"], ["start_line"], {"event_ord": ("sum", F.lit(1).cast("long"))}).drop(scan.PART)
    return e.withColumn("event_id", F.format_string("JE%04d", "event_ord"))


def parse_ping(lines: DataFrame, timezone: str = "UTC", stage: Stage | None = None) -> DataFrame:
    """One row a sample; its host is its own, or that of the last banner before it."""
    stage = stage or Stage(lines.sparkSession, "ping-log")
    lines = scan.ranged(lines, ["source_file"], ["line_no"], stage, "lines", readers=2)
    p = lines.withColumn("ts_raw", L.found(F.col("value"), PING_LINE)).where("ts_raw IS NOT NULL").withColumn("body", F.regexp_extract("value", PING_LINE, 2))
    banner = F.coalesce(L.found(F.col("body"), BANNER, 1), L.found(F.col("body"), BANNER, 2))
    p = scan.running(p.withColumn("banner", banner), ["source_file"], ["line_no"], {"default_host": ("last", F.col("banner"))})
    p = p.where("banner IS NULL AND NOT startswith(body, '=====') AND trim(body) <> ''")
    b, low = F.col("body"), F.lower("body")
    linux, windows, silent = b.rlike(LINUX_REPLY), b.rlike(WINDOWS_REPLY), b.rlike(NO_ANSWER)
    status = (
        F.when(linux | windows, "REPLY")
        .when(silent | low.contains("request timed out") | b.contains("请求超时") | b.contains("传输超时"), "TIMEOUT")
        .when((low.contains("destination") & low.contains("unreachable")) | b.contains("无法访问目标主机") | b.contains("目标主机无法访问"), "UNREACHABLE")
        .when(low.contains("general failure") | b.contains("一般故障"), "ERROR")
    )
    pick = lambda i, j: F.when(linux, F.regexp_extract(b, LINUX_REPLY, i)).when(windows, F.regexp_extract(b, WINDOWS_REPLY, j))
    seq = F.when(linux, F.regexp_extract(b, LINUX_REPLY, 2)).when(~windows & silent, F.regexp_extract(b, NO_ANSWER, 1))
    return p.withColumn("status", status).where("status IS NOT NULL").select(
        L.epoch(F.col("ts_raw"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.S", "yyyy-MM-dd HH:mm:ss"), timezone).alias("timestamp"), F.col("ts_raw").alias("timestamp_raw"), F.coalesce(pick(1, 1), "default_host").alias("target_host"), "status",
        pick(4, 2).try_cast("double").alias("rtt_ms"), pick(3, 3).try_cast("int").alias("ttl"), seq.try_cast("int").alias("icmp_seq"), "source_file", F.col("line_no").alias("source_line"), F.substring("value", 1, 240).alias("raw_excerpt"),
    )
