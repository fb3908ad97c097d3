"""Secret scan over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that any match must
contain. The index holds the postings (trigram, document) of the trigrams that the queries
name; intersecting them gives the candidates of a rule, which alone are verified with the
expression. A rule from which no trigram follows (a run of hex digits) scans every text.

Postings are of lower-cased text, so they serve case-sensitive rules as a superset.

Defined cases: null texts count as empty; rows that share an id share postings and are each
verified on their own text; null ids are matched as equal; ties of spans go by rule order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A span is a match whose group `group` has at least `least` characters. pattern must mean the same in Java and Python."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are fixed by the contract; the others add spans. {24,} and {16,} stand for the base runs with their least length: both end where the run of the class ends.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,80}:[^\s:/@]{3,80}@"),
)
BASE_KINDS = ("assign", "access", "hex")
_MAX_STRINGS = 64


def quoted(text: str) -> str:
    """text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Boolean query of lower-case trigrams: an AND of ORs of ANDs. Empty: no trigram is mandatory."""
    ands: list[list[list[str]]] = []

    def flush(strings: set[str]) -> set[str]:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if grams and all(grams):  # an alternative that asks for more than another adds nothing
            ands.append(sorted(sorted(g) for g in grams if not any(h < g for h in grams)))
        return {""}

    def walk(nodes, open_: set[str]) -> set[str]:
        """open_: every text that may stand right before, up to the last point where anything may stand."""
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                open_ = {s + chr(arg).lower() for s in open_}
            elif name == "SUBPATTERN":
                open_ = walk(arg[3], open_)
            elif name == "BRANCH":
                parts = [exact(alternative) for alternative in arg[1]]
                open_ = {s + t for s, t in product(open_, set().union(*parts))} if all(parts) else flush(open_)
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) * len(open_) <= _MAX_STRINGS:
                open_ = {s + chr(c).lower() for s in open_ for _, c in arg}
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1) and (part := exact(arg[2])):
                open_ = open_ | {s + t for s, t in product(open_, part)}
            elif name != "AT":
                open_ = flush(open_)
            if len(open_) > _MAX_STRINGS:
                open_ = flush(open_)
        return open_

    def exact(nodes) -> set[str]:
        """All texts that nodes can match, empty if they aren't few literals."""
        before = len(ands)
        found = walk(nodes, {""})
        closed = len(ands) == before and "" not in found
        del ands[before:]
        return found if closed else set()

    flush(walk(re._parser.parse(pattern), {""}))
    return ands


#: Lengths are added up in groups of so many, and in groups of groups, so that the place of a match is the sum of few numbers.
GROUP = 128


def running_sum(steps: str, groups: str, larger: str, i: str) -> str:
    """SQL: the sum of steps up to place i (from 0), given the sums of groups of GROUP and of GROUP groups."""
    total = lambda array, first, n: f"aggregate(slice({array}, {first} + 1, {n}), 0, (a, y) -> a + y)"
    g, h = f"int({i} div {GROUP})", f"int({i} div {GROUP * GROUP})"
    return f"{total(larger, '0', h)} + {total(groups, f'{h} * {GROUP}', f'{g} % {GROUP}')} + {total(steps, f'{g} * {GROUP}', f'{i} % {GROUP} + 1')}"


def grouped(array: str) -> str:
    """SQL: the sums of groups of GROUP numbers."""
    return f"transform(sequence(0, int(size({array}) div {GROUP})), k -> aggregate(slice({array}, k * {GROUP} + 1, {GROUP}), 0, (a, y) -> a + y))"


def spans_sql(rule: Rule, no: int) -> str:
    """SQL for the spans of a rule in txt: places follow from the lengths of the matches and of what lies between."""
    p = quoted(rule.pattern)
    return f"""
    transform(array(named_struct('m', regexp_extract_all(txt, {p}, 0), 'g', regexp_extract_all(txt, {p}, {rule.group}), 'b', split(txt, {p}))), r ->
      transform(array(transform(r.m, (x, i) -> length(r.b[i]) + IF(i = 0, 0, length(r.m[i - 1])))), steps ->
        transform(array({grouped("steps")}), groups ->
          transform(array({grouped("groups")}), larger ->
            filter(
              transform(r.m, (x, i) -> named_struct('at', {running_sum("steps", "groups", "larger", "i")}, 'no', {no}, 'kind', '{rule.kind}', 'chars', length(x), 'good', length(r.g[i]) >= {rule.least})),
              x -> x.good))[0])[0])[0])[0]"""


NO_SPANS = "cast(array() AS array<struct<at: int, no: int, kind: string, chars: int, good: boolean>>)"


def postings(docs: DataFrame, queries: dict[str, list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (gram, doc_id) of the trigrams that the queries name."""
    grams = sorted({g for ands in queries.values() for ors in ands for g in sum(ors, [])})
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("low"))
    has = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return low.select("doc_id", F.explode(has).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """doc_id and the rules whose Boolean query its postings satisfy."""
    met = {k: " AND ".join("(" + " OR ".join("(" + " AND ".join(f"array_contains(grams, {quoted(g)})" for g in alternative) + ")" for alternative in ors) + ")" for ors in ands) for k, ands in queries.items()}
    named = F.filter(F.array(*[F.expr(f"CASE WHEN {q} THEN '{k}' END") for k, q in met.items()]), lambda k: k.isNotNull())
    return index.groupBy("doc_id").agg(F.collect_set("gram").alias("grams")).select("doc_id", named.alias("rules")).where(F.size("rules") > 0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id and spans (at, no, kind, chars) of every row, sorted by place, then by rule order."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    found = candidates(postings(docs, queries, id_col, text_col), queries).withColumnRenamed("doc_id", "found_id")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    d = d.join(found, d.doc_id.eqNullSafe(found.found_id), "left")
    # A scanned rule first asks whether it matches at all, which needs no list of matches.
    asks = {r.kind: f"array_contains(rules, '{r.kind}')" if r.kind in queries else f"rlike(txt, {quoted(r.pattern)})" for r in rules}
    parts = [F.expr(f"CASE WHEN {asks[r.kind]} THEN {spans_sql(r, i)} ELSE {NO_SPANS} END") for i, r in enumerate(rules)]
    return d.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets()."""
    said = lambda spans: f"array_join(transform({spans}, x -> concat(x.kind, ':', x.at, ':', x.at + x.chars)), ',')"
    base = f"filter(spans, x -> x.kind IN {BASE_KINDS!r})"
    return found.select(
        "doc_id",
        *[F.expr(f"bigint(size(filter(spans, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in BASE_KINDS],
        F.expr(f"sha2({said(base)}, 256)").alias("base_sha256"),
        F.expr(said("spans")).alias("spans"),
    )
