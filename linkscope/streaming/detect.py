"""Streaming forms: packets as a stream, findings as they become certain.

Retransmissions are a windowed aggregate under a watermark. Zero-window runs need the order of
packets within a session, so they keep state by session and take packets of a micro-batch in
order of pkt_ord.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import packets as P
from ..schemas import KEYS


def retransmissions(directed: DataFrame, window: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Segments sent twice or more within a window of event time; directed is a stream with session, direction and payload_sha256."""
    p = directed.where(P.advances_sequence()).withColumn("at", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))).withWatermark("at", late)
    g = p.groupBy(F.window("at", window), *KEYS, "direction", F.col("tcp_seq").alias("seq"), "tcp_len", "payload_sha256").agg(F.count(F.lit(1)).alias("count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    return g.where("count >= 2").select("window.start", *KEYS, "direction", "seq", "tcp_len", "payload_sha256", "count", F.round((F.col("last_ts") - F.col("first_ts")) * 1000, 3).alias("duration_ms"))


RUN = "capture_id string, session_id long, start_ts double, end_ts double, packets long"


def zero_windows(directed: DataFrame) -> DataFrame:
    """Zero-window runs that have ended; an open run stays in the session's state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        out = []
        for p in pd.concat(list(frames)).sort_values("pkt_ord").itertuples():
            zero = p.tcp_window == 0 and not p.tcp_flags & (P.FLAGS["RST"] | P.FLAGS["FIN"])
            if zero:
                start, n = (p.timestamp if start is None else start), n + 1
            elif start is not None:
                out.append((key[0], key[1], start, p.timestamp, n))
                start, n = None, 0
        state.update((start, n))
        yield pd.DataFrame(out, columns=["capture_id", "session_id", "start_ts", "end_ts", "packets"])

    return directed.select(*KEYS, "pkt_ord", "timestamp", "tcp_window", "tcp_flags").groupBy(*KEYS).applyInPandasWithState(run, RUN, "start double, n long", "append", GroupStateTimeout.NoTimeout)
