"""Whole analyses: one capture, two captures, a case with logs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..config import Thresholds
from ..functions.packets import payload_sha256
from ..operators import anomalies, case_evidence, correlate, detectors, dual, grouping, ping, sessions, timeline
from ..stages import Stage


def prepared(packets: DataFrame) -> DataFrame:
    """packets with the hash of their payload and whether it is known; the payload itself goes no further."""
    from pyspark.sql import functions as F

    return packets.withColumns({"payload_sha256": payload_sha256(), "payload_known": F.coalesce("payload_hex", F.lit("")) != ""}).drop("payload_hex")


class Staged:
    """What several branches read is written once where there is a stage; without one it is planned anew in each."""

    stage: Stage | None = None

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return df if self.stage is None else self.stage.keep(df, name)


@dataclass
class Capture(Staged):
    """Findings of one or more captures, each a DataFrame that is planned when first asked for."""

    packets: DataFrame
    db_port: int
    th: Thresholds = Thresholds()
    cut_short: bool = False
    stage: Stage | None = None
    raw: DataFrame | None = None

    @cached_property
    def bytes_of(self) -> DataFrame:
        """Packets with their payloads, sessions and directions, where the capture was given with its raw packets."""
        from pyspark.sql import functions as F

        payloads = self.raw.select("capture_id", "pkt_ord", "payload_hex").where(F.coalesce("payload_hex", F.lit("")) != "")
        return self.directed.join(payloads, ["capture_id", "pkt_ord"])

    @cached_property
    def keyed(self) -> DataFrame:
        return sessions.with_session(self.packets)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.kept(sessions.sessions(self.keyed, self.db_port), "sessions")

    @cached_property
    def directed(self) -> DataFrame:
        return self.kept(sessions.with_direction(self.keyed, self.sessions), "directed")

    @cached_property
    def handshakes(self) -> DataFrame:
        return sessions.handshakes(self.keyed)

    @cached_property
    def retransmissions(self) -> DataFrame:
        return detectors.retransmissions(self.directed, self.th)

    @cached_property
    def ack_stalls(self) -> DataFrame:
        return detectors.ack_stalls(self.directed, self.retransmissions, self.th)

    @cached_property
    def resets(self) -> DataFrame:
        return detectors.resets(self.directed, self.th)

    @cached_property
    def zero_windows(self) -> DataFrame:
        return detectors.zero_windows(self.directed)

    @cached_property
    def quality(self) -> DataFrame:
        return self.kept(detectors.capture_quality(self.packets, self.th, self.cut_short), "quality")

    @cached_property
    def summaries(self) -> DataFrame:
        return sessions.summaries(self.directed, self.sessions, self.handshakes, self.retransmissions, self.ack_stalls, self.resets, self.zero_windows, self.th)

    @cached_property
    def anomalies(self) -> DataFrame:
        return self.kept(anomalies.anomalies(self.sessions, self.handshakes, self.retransmissions, self.ack_stalls, self.resets, self.zero_windows, self.packets, self.quality, self.th), "anomalies")

    @cached_property
    def evidence(self) -> DataFrame:
        return anomalies.frame_evidence(self.directed, self.anomalies)

    @cached_property
    def rollup(self) -> DataFrame:
        return anomalies.rollup(self.summaries, self.anomalies, self.quality)

    @cached_property
    def conclusion(self) -> DataFrame:
        return case_evidence.conclusion(self.anomalies, self.quality)

    def side(self) -> dict[str, DataFrame]:
        return {"packets": self.directed, "anomalies": self.anomalies, "sessions": self.sessions, "quality": self.quality}


@dataclass
class Dual(Staged):
    """Two captures of the same traffic."""

    app: Capture
    db: Capture
    stage: Stage | None = None

    @cached_property
    def flows(self) -> DataFrame:
        with_syn = lambda c: c.sessions.join(dual.relative_syn(c.keyed), ["capture_id", "session_id"], "left")
        return self.kept(dual.match_flows(with_syn(self.app), with_syn(self.db), self.stage), "flows")

    @cached_property
    def segments(self) -> DataFrame:
        return self.kept(dual.match_segments(dual.buckets(self.app.directed), dual.buckets(self.db.directed), self.flows), "segments")

    @cached_property
    def clock(self) -> DataFrame:
        return dual.clock_alignment(self.segments, self.stage)

    @cached_property
    def flow_counts(self) -> DataFrame:
        return dual.status_counts(self.flows, self.segments)


@dataclass
class Case(Staged):
    """Logged events against two captures, with optional ping samples. Its tables are staged: each is written once, for all that read it."""

    dual: Dual
    raw_events: DataFrame
    samples: DataFrame | None = None
    window: float = correlate.WINDOW
    timeline_window: float = 30.0
    grace: float = correlate.GRACE
    default_host: str | None = None
    default_port: int | None = None
    strict_compat: bool = False
    stage: Stage | None = None

    def __post_init__(self):
        self.stage = self.stage or Stage(self.raw_events.sparkSession, "case")
        for part in (self.dual, self.dual.app, self.dual.db):
            part.stage = part.stage or self.stage

    @cached_property
    def events(self) -> DataFrame:
        return self.kept(grouping.assign_groups(self.raw_events, stage=self.stage), "events")

    @cached_property
    def accounting(self) -> DataFrame:
        return self.kept(correlate.accounting(self.events, self.dual.flows, self.grace, self.default_host, self.default_port, self.stage), "accounting")

    @cached_property
    def candidates(self) -> DataFrame:
        found = correlate.candidates(self.events, self.dual.flows, self.dual.app.directed, self.dual.app.anomalies, self.window, self.grace, self.default_host, self.default_port, self.accounting, self.stage)
        return self.kept(found, "candidates")

    @cached_property
    def correlations(self) -> DataFrame:
        return self.kept(correlate.correlate(self.events, self.candidates, self.accounting, self.default_host, self.default_port), "correlations")

    def entries(self, of: DataFrame | None = None) -> DataFrame:
        """The timeline of all events, or of those of `of` (event_id) alone: the chosen flow's rows, and those of near ties."""
        from pyspark.sql import functions as F

        only = (lambda df: df) if of is None else lambda df: df.join(of.select("event_id"), "event_id", "left_semi")
        sides = {"APP": self.dual.app.side(), "DB": self.dual.db.side()}
        made = lambda chosen: timeline.timeline(only(self.events), only(chosen), sides, self.dual.segments, self.timeline_window, self.strict_compat)
        others = correlate.near_ties(self.correlations, self.candidates).withColumn("evidence_level", F.lit("AMBIGUOUS"))
        return timeline.with_near_ties(made(self.correlations), made(others))

    @cached_property
    def timeline(self) -> DataFrame:
        return self.kept(self.entries(), "timeline")

    @cached_property
    def ping_statistics(self) -> DataFrame | None:
        return None if self.samples is None else self.kept(ping.statistics(self.events, self.samples, self.timeline_window, stage=self.stage), "ping")

    @cached_property
    def key_event(self) -> DataFrame:
        return self.kept(timeline.key_event(self.events), "key")

    @cached_property
    def key_timeline(self) -> DataFrame:
        return self.kept(self.entries(self.key_event), "key-timeline")

    def evidence_of(self, key: DataFrame, entries: DataFrame, every: bool = False) -> DataFrame:
        qualities = {"APP": self.dual.app.quality, "DB": self.dual.db.quality}
        return case_evidence.evidence(key, self.events, self.correlations, self.candidates, entries, qualities, self.ping_statistics, every)

    @cached_property
    def evidence(self) -> DataFrame:
        """What the case may claim of its key event, in four classes."""
        return self.kept(self.evidence_of(self.key_event, self.key_timeline), "evidence")

    @cached_property
    def all_evidence(self) -> DataFrame:
        """The same of every event."""
        return self.evidence_of(self.events, self.timeline, every=True)

    @cached_property
    def unified(self) -> DataFrame:
        spark = self.raw_events.sparkSession
        none = spark.createDataFrame([], "event_id string, timestamp double, event_type string, description string, target_host string")
        key = self.events.join(self.key_event.select("event_id"), "event_id", "left_semi")
        marks = none if self.samples is None else ping.markers(key, self.samples, self.timeline_window, stage=self.stage)
        return timeline.unified(self.key_timeline, marks, self.key_event)
