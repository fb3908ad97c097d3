"""Thresholds of the detectors, and their JSON overlay."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

SEVERITIES = ("INFO", "WARNING", "HIGH")


@dataclass(frozen=True)
class Thresholds:
    """Defaults as documented; severities that are no severity fall back to the rule's own default."""

    retx_single_severity: str = "INFO"
    retx_burst_warn_count: int = 2
    retx_high_count: int = 3
    retx_high_duration_ms: float = 1000.0
    zero_window_warn_count: int = 1
    zero_window_crit_count: int = 5
    ack_stall_ms: float = 1000.0
    rst_after_syn_severity: str = "WARNING"
    rst_during_data_severity: str = "HIGH"
    ack_to_rst_severity: str = "WARNING"
    rst_after_fin_severity: str = "INFO"
    truncated_warn_ratio: float = 0.05
    truncated_high_ratio: float = 0.30
    handshake_warn_ms: float = 100.0
    handshake_crit_ms: float = 500.0
    rtt_warn_ms: float = 50.0
    rtt_crit_ms: float = 100.0
    retx_rate_warn_pct: float = 2.0
    retx_rate_crit_pct: float = 5.0
    rst_short_flow_packet_threshold: int = 50

    def severity(self, name: str, default: str) -> str:
        value = str(getattr(self, name)).upper()
        return value if value in SEVERITIES else default


def default_path() -> str | None:
    """config/thresholds.json under the folder that LINKSCOPE_HOME names, or in one of the four folders above this file."""
    home = os.environ.get("LINKSCOPE_HOME")
    places = [Path(home)] if home else []
    found = (p / "config" / "thresholds.json" for p in [*places, *list(Path(__file__).resolve().parents)[:4]])
    return next((str(p) for p in found if p.is_file()), None)


def load(*paths: str | None) -> Thresholds:
    """Defaults under each JSON file in turn; an unknown key or unreadable file leaves the defaults alone."""
    own, known = Thresholds(), {f.name for f in fields(Thresholds)}
    for path in filter(None, paths):
        try:
            given = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        if not isinstance(given, dict) or set(given) - known:
            return Thresholds()
        own = replace(own, **given)
    return own
