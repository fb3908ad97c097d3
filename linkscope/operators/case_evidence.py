"""What a case may claim: evidence in four classes, and the conclusion over one capture's findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The classes of evidence, and the kinds of timeline rows that count as correlated.
CONFIRMED, CORRELATED, SUPPORTING, UNKNOWN = "CONFIRMED_FACTS", "CORRELATED_EVIDENCE", "SUPPORTING_EVIDENCE", "UNKNOWN"
ON_TIMELINE = ("MATCHED_SEGMENT", "ACK_STALLED", "DATA_RETRANSMISSION", "RST", "FIN")
#: Correlated items of an event, points of total score between near ties and the first, and their last rank.
MOST_CORRELATED, TIE, LAST_RANK = 40, 10, 5
#: Fixed value: findings, and concerns, of a conclusion.
MOST_FINDINGS = 20
#: What no case of this kind can show, whatever its inputs.
CAVEATS = (
    "Which device on the path lost packets, if any did, is beyond captures, logs and echo replies.",
    "Echo replies tell of reachability, not of the health of a TCP session.",
    "The clocks of the hosts were aligned by wall time only; that they agree is not proven.",
)
CAUTION = "Echo samples support a finding; they neither choose a connection nor prove a cause."


def _items(df: DataFrame, cls: str, kind: str | Column, said: Column, confidence: Column | str | None = None, correlation: Column | None = None, at: Column | None = None, place: int = 0) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "event_id", F.lit(cls).alias("evidence_class"), lit(kind).cast("string").alias("kind"), lit(correlation).cast("string").alias("correlation_id"), said.alias("description"),
        lit(confidence).cast("string").alias("confidence"), F.lit(place).alias("place"), lit(at).cast("double").alias("at"),
    )


def evidence(key: DataFrame, events: DataFrame, correlations: DataFrame, candidates: DataFrame, entries: DataFrame, qualities: dict[str, DataFrame], pings: DataFrame | None, every: bool = False) -> DataFrame:
    """Items of evidence for each event of key (event_id): its class, kind, correlation, description and confidence, with item (from 1) in each class.

    entries: timeline rows; qualities: side to a one-row table; pings: ping statistics, None where the
    case has none. Without events there is no item but the captures' quality, which needs an event to
    stand by, so the result is empty. every: key holds all events, so no other table is cut down to it. Tables that grow
    with events are joined by sorting: broadcasts of so many joins at once would fill the driver. Of correlated items the first 40 stay, as reports ask for them.
    """
    c, unknown = F.col, F.lit("?")
    text = lambda *names: F.coalesce(*[c(n).cast("string") for n in names], unknown)
    keys = key.select("event_id").where("event_id IS NOT NULL")
    of = lambda df: df.where("event_id IS NOT NULL") if every else df.join(keys, "event_id", "left_semi")
    e, chosen = of(events), of(correlations)
    parts = [_items(e, CONFIRMED, "LOGGED_EVENT", F.format_string("Logged %s at %s (%s: %s), lines %s to %s", text("event_type"), text("timestamp_raw", "timestamp"), text("caused_by_class", "exception_class"), text("caused_by_message", "message"), text("start_line"), text("end_line")), "CONFIRMED")]
    for n, (side, q) in enumerate(qualities.items()):
        known = keys.join(F.broadcast(q.limit(1)))  # a row a capture
        parts.append(_items(known, CONFIRMED, f"{side}_CAPTURE", F.format_string(f"{side} capture: credibility %s, file cut short %s, truncated packets %s", text("credibility"), text("file_cut_short"), text("truncated_packets")), "CONFIRMED", place=1 + n))
    unclear = chosen.where("correlation_status = 'AMBIGUOUS'")
    way = F.format_string("%s (app stream %s, db stream %s, %s:%s to %s:%s)", text("correlation_id"), text("app_stream"), text("db_stream"), text("client_ip"), text("client_port"), text("server_ip"), text("server_port"))
    parts.append(_items(chosen.where("correlation_status <> 'AMBIGUOUS' AND correlation_id IS NOT NULL"), CONFIRMED, "SELECTED_FLOW", F.concat(F.lit("Flow "), way), c("evidence_level"), c("correlation_id"), place=3))
    parts.append(_items(unclear, UNKNOWN, "NO_UNIQUE_FLOW", F.format_string("The log names no client port, and %s flows fit the event: none can be singled out", text("candidate_count"))))
    parts.append(_items(unclear, CORRELATED, "FIRST_CANDIDATE", F.concat(F.lit("First of the ranked candidates, not a proven identity: "), way), c("evidence_level"), c("correlation_id")))
    ranked = candidates.join(unclear.select("event_id").hint("merge"), "event_id", "left_semi")
    best = ranked.where("rank = 1").select("event_id", c("total_score").alias("best"))
    ties = ranked.join(best.hint("merge"), "event_id").where((c("rank") > 1) & (c("rank") <= LAST_RANK) & (c("total_score") >= c("best") - TIE))
    parts.append(_items(ties, CORRELATED, "NEAR_TIE", F.concat(F.lit("Near tie "), way, F.format_string(", score %.1f", c("total_score"))), "AMBIGUOUS", c("correlation_id"), c("rank"), place=1))
    shown = of(entries).where(c("event_type").isin(*ON_TIMELINE)).join(chosen.select("event_id", (c("correlation_status") == "AMBIGUOUS").alias("unclear")).hint("merge"), "event_id")
    shown = shown.where("event_type <> 'MATCHED_SEGMENT' OR relative_seconds IS NOT NULL")
    when = F.coalesce(F.format_string(" at %+.3f s from the event", c("relative_seconds")), F.lit(""))
    said = F.concat(text("side"), F.lit(": "), text("description"), F.when(c("relative_seconds").isNotNull(), when).otherwise(""), F.when(c("unclear") & (c("event_type") == "MATCHED_SEGMENT"), "; its flow is one of several candidates").otherwise(""))
    parts.append(_items(shown, CORRELATED, c("event_type"), said, c("evidence_level"), c("correlation_id"), c("timestamp"), place=2))
    if pings is None:
        parts.append(_items(keys, UNKNOWN, "NO_PING", F.lit("The case holds no echo samples"), place=1))
    else:
        p = of(pings)
        counted = F.format_string("Echo samples around the event: %d, replies %d, timeouts %d, unreachable %d, target %s", c("samples"), c("replies"), c("timeouts"), c("unreachable"), text("target_host"))
        parts += [_items(p, CONFIRMED, "PING_COUNTS", counted, "CONFIRMED", place=4), _items(p, SUPPORTING, "PING_SUMMARY", ping_summary(), SUPPORTING), _items(p, SUPPORTING, "PING_CAUTION", F.lit(CAUTION), SUPPORTING, place=1)]
    parts += [_items(keys, UNKNOWN, "CAVEAT", F.lit(x), place=2 + n) for n, x in enumerate(CAVEATS)]
    order = Window.partitionBy("event_id", "evidence_class").orderBy("place", F.asc_nulls_last("at"), "kind", "correlation_id", "description")
    items = reduce(DataFrame.unionByName, parts)
    # Correlated items by themselves, so that the cut to 40 comes before rows of an event meet.
    numbered = lambda rows: rows.withColumn("item", F.row_number().over(order))
    first = numbered(items.where(c("evidence_class") == CORRELATED)).where(c("item") <= MOST_CORRELATED)
    return first.unionByName(numbered(items.where(c("evidence_class") != CORRELATED))).drop("place", "at")


def ping_summary() -> Column:
    """What the counts of ping statistics say of the window around an event."""
    n = F.col
    host = F.coalesce(n("target_host"), F.lit("the target"))
    trips = F.when(n("min_rtt_ms").isNotNull(), F.format_string(", round trips %.3f to %.3f ms", n("min_rtt_ms"), n("max_rtt_ms"))).otherwise("")
    return (
        F.when((n("timeouts") > 0) & (n("replies") > 0), F.format_string("%s answered some samples and not others (%d replies, %d timeouts): reachability was impaired", host, n("replies"), n("timeouts")))
        .when(n("timeouts") > 0, F.format_string("%s answered no sample (%d timeouts)", host, n("timeouts")))
        .when(n("replies") > 0, F.concat(F.format_string("%s answered (%d replies", host, n("replies")), trips, F.lit(")")))
        .when(n("samples") == 0, "No echo sample lies in the window")
        .otherwise(F.format_string("%d samples, none a reply or a timeout", n("samples")))
    )


def conclusion(found: DataFrame, quality: DataFrame) -> DataFrame:
    """One row a capture: verdict, color, tcp_health, findings and concerns (of each the first 20, as reports ask for them).

    Findings are all anomalies in the order of the capture's sessions. Concerns are the capture's own
    quality, then what is HIGH, what is WARNING, and what concerns the capture and not TCP. Ranks are
    cut to 20 before rows of a capture meet, so a capture of many anomalies is no hot key.
    """
    c = F.col
    of_capture = c("type").isin("PACKET_TRUNCATED", "CAPTURE_FILE_CUT_SHORT")
    grade = F.when(of_capture, 2).when(c("severity") == "HIGH", 0).when(c("severity") == "WARNING", 1).otherwise(3)
    by = [F.asc_nulls_first("session_id"), F.asc_nulls_first("first_ord"), "type", F.asc_nulls_first("seq"), F.asc_nulls_first("tcp_len"), "summary"]
    a = found.withColumn("grade", grade).select("capture_id", "grade", "session_id", "first_ord", "type", "seq", "tcp_len", "summary")
    counts = a.groupBy("capture_id").agg(*[F.count_if(c("grade") == g).alias(f"n{g}") for g in (0, 1, 2)])

    def first(rows: DataFrame, order: list, name: str) -> DataFrame:
        top = rows.withColumn("no", F.row_number().over(Window.partitionBy("capture_id").orderBy(*order))).where(c("no") <= MOST_FINDINGS)
        return top.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "summary"))), lambda x: x["summary"]).alias(name))

    j = quality.join(counts, "capture_id", "left").fillna(0, ["n0", "n1", "n2"])
    j = j.join(first(a, by, "findings"), "capture_id", "left").join(first(a.where("grade < 3"), ["grade", *by], "others"), "capture_id", "left")
    cut = (c("truncated_packets") > 0) | c("file_cut_short")
    own = F.format_string("capture quality: %d of %d packets truncated, credibility %s%s", c("truncated_packets"), c("total_packets"), c("credibility"), F.when(c("file_cut_short"), ", file cut short").otherwise(""))
    none = F.array().cast("array<string>")
    verdict = (
        F.when(c("n0") > 0, "HIGH_TCP_ANOMALY").when(c("n1") > 0, "TCP_ATTENTION").when(cut | (c("n2") > 0), "CAPTURE_QUALITY_ONLY").otherwise("NOTHING_OBSERVED")
    )
    return j.select(
        "capture_id", verdict.alias("verdict"), F.when(c("n0") > 0, "red").when(verdict == "NOTHING_OBSERVED", "green").otherwise("yellow").alias("color"),
        F.when(c("n0") > 0, "HIGH").when(c("n1") > 0, "WARNING").otherwise("INFO").alias("tcp_health"), F.coalesce("findings", none).alias("findings"),
        F.concat(F.when(cut, F.array(own)).otherwise(none), F.coalesce("others", none)).alias("concerns"), cut.alias("may_be_incomplete"),
    )


def server_mismatch(sessions: DataFrame, server_ip: str) -> DataFrame:
    """Sessions of each capture, and those whose server is another than the one given (or unknown): a note, never a filter."""
    other = ~F.col("server_ip").eqNullSafe(F.lit(server_ip))
    return sessions.groupBy("capture_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(other).alias("mismatched"))


def explained(stalls: DataFrame) -> DataFrame:
    """stalls with explanation, a sentence for readers of reports."""
    sender, peer = (F.when(F.col("send_direction") == "server_to_client", a).otherwise(b) for a, b in (("database", "application"), ("application", "database")))
    text = F.format_string(
        "The %s sent the same %d bytes (Seq=%d) %d times over %.1f ms; the %s should have acknowledged %d but never went beyond %d, so the capture shows no delivery of this data.",
        sender, F.col("tcp_len"), F.col("seq"), F.col("retransmission_count"), F.col("stall_duration_ms"), peer, F.col("expected_ack"), F.col("observed_ack"),
    )
    return stalls.withColumn("explanation", text)
