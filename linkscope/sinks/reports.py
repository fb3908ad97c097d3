"""Reports in Markdown and HTML. They show small tables: each is limited before it is collected, and says so."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from ..operators import case_evidence
from ..plans.analyze import Capture, Case, Dual
from .tables import flat

ROWS = 50
#: What a report must never claim.
LIMITS = (
    "A reset names the endpoint that sent it, never the device that caused it.",
    "A log without client ports supports a connection as STRONG at most.",
    "Ping supports a finding; it neither makes nor ranks one.",
    "Capture quality is no TCP health.",
)


def rows_of(df: DataFrame, limit: int = ROWS) -> tuple[list[str], list[list[str]], bool]:
    """Header and at most `limit` rows as text, and whether there are more."""
    got = flat(df).limit(limit + 1).collect()
    return df.columns, [["" if v is None else str(v) for v in r] for r in got[:limit]], len(got) > limit


def markdown_table(df: DataFrame, limit: int = ROWS) -> str:
    head, rows, more = rows_of(df, limit)
    if not rows:
        return "_none_\n"
    clean = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(clean, r)) + " |" for r in rows)]
    return "\n".join(lines) + (f"\n\n_first {limit} rows_" if more else "") + "\n"


def html_table(df: DataFrame, limit: int = ROWS) -> str:
    head, rows, more = rows_of(df, limit)
    cells = lambda tag, xs: "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>" + (f"<p>first {limit} rows</p>" if more else "")


def capture_sections(c: Capture) -> list[tuple[str, DataFrame]]:
    return [
        ("Conclusion", c.conclusion), ("Rollup", c.rollup), ("Capture quality", c.quality), ("Sessions", c.summaries.orderBy("severity", "session_ord")), ("Retransmissions", c.retransmissions.orderBy("session_id", "first_ord")),
        ("Stalled acknowledgements", case_evidence.explained(c.ack_stalls)), ("Resets", c.resets), ("Zero windows", c.zero_windows), ("Findings", c.anomalies.orderBy("session_id", "first_ord")),
    ]


def dual_sections(d: Dual) -> list[tuple[str, DataFrame]]:
    return [("Flows", d.flow_counts.orderBy("correlation_id")), ("Clock", d.clock), ("Segments", d.segments.orderBy("correlation_id", "direction", "seq", "tcp_len", "match_status"))]


def case_sections(c: Case) -> list[tuple[str, DataFrame]]:
    ping = [("Ping around events", c.ping_statistics)] if c.samples is not None else []
    return [("Key event", c.key_event), ("Events", c.events.orderBy("event_ord")), ("Correlation", c.correlations.orderBy("event_id")), *dual_sections(c.dual), *ping, ("What the case may claim", c.evidence.orderBy("evidence_class", "item")), ("Unified timeline", c.unified.orderBy("timestamp", "source", "event_type"))]


def markdown(title: str, sections: list[tuple[str, DataFrame]], limit: int = ROWS) -> str:
    body = "\n".join(f"## {name}\n\n{markdown_table(df, limit)}" for name, df in sections)
    return f"# {title}\n\n{body}\n## Limits\n\n" + "\n".join(f"- {x}" for x in LIMITS) + "\n"


def page(title: str, sections: list[tuple[str, DataFrame]], limit: int = ROWS) -> str:
    """A page that needs no other file; all text is escaped."""
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px;text-align:left}"
    body = "".join(f"<h2>{html.escape(name)}</h2>{html_table(df, limit)}" for name, df in sections)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}<h2>Limits</h2><ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in LIMITS) + "</ul></body></html>"
