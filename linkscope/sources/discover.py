"""The files of a case folder by what is in them. Only listings and short heads reach the driver."""

from __future__ import annotations

import json
from pathlib import Path

#: First bytes of capture files, and words that tell logs.
CAPTURE_MAGICS = (b"\xa1\xb2\xc3\xd4", b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\x3c\x4d", b"\x4d\x3c\xb2\xa1", b"\x0a\x0d\x0d\x0a")
JDBC_WORDS = ("tid:", "exception", "caused by:", "jdbc")
PING_WORDS = ("icmp_seq", "bytes from", "ping monitor", "reply from", "request timed out")
FIELD_BARS = 13
HEAD = 200_000


def kind_of(path: Path) -> str:
    """capture, fields, jdbc, ping or other."""
    with path.open("rb") as f:
        head = f.read(HEAD)
    if head[:4] in CAPTURE_MAGICS:
        return "capture"
    text = head.decode("utf-8", errors="replace").lower()
    first = next((line for line in text.splitlines() if line.strip()), "")
    if first.count("|") >= FIELD_BARS:
        return "fields"
    score = {"jdbc": sum(w in text for w in JDBC_WORDS), "ping": sum(w in text for w in PING_WORDS)}
    best = max(score, key=score.get)
    return best if score[best] >= 2 else "other"


def discover(folder: str, overrides: dict[str, str] | None = None) -> dict:
    """The case's files by role, and READY, MISSING_INPUT or INPUT_AMBIGUOUS.

    The two captures are told apart by overrides (file name or stem: app or db), or by roles in
    their names; else they are "unknown", and the packets' own roles must decide.
    """
    found: dict[str, list[str]] = {k: [] for k in ("capture", "fields", "jdbc", "ping", "other")}
    for p in sorted(Path(folder).iterdir()):
        if p.is_file():
            found[kind_of(p)].append(str(p))
    captures, roles = found["fields"] + found["capture"], {}
    for path in captures:
        p = Path(path)
        given = next((r for n, r in (overrides or {}).items() if n in (p.name, p.stem, path)), None)
        roles[path] = given or ("app" if "app" in p.stem.lower() else "db" if "db" in p.stem.lower() else "unknown")
    missing = [k for k, n in (("jdbc", found["jdbc"]), ("captures", captures)) if not n] + (["second capture"] if len(captures) == 1 else [])
    ambiguous = len(found["jdbc"]) > 1 or len(captures) > 2 or sorted(roles.values()) == ["app", "app"] or sorted(roles.values()) == ["db", "db"]
    return {"folder": folder, "status": "MISSING_INPUT" if missing else "INPUT_AMBIGUOUS" if ambiguous else "READY", "missing": missing, "roles": roles, **found}


def write_manifest(result: dict, path: str) -> None:
    Path(path).write_text(json.dumps(result, ensure_ascii=False, indent=2), encoding="utf-8")
