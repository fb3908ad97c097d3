"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Measures of each text come first, as the result carries them for every row. The rules beyond
the base ones follow as one CASE chain: Spark evaluates its branches in order and stops at the
first that holds, so a row pays only for the rules up to its rejection. A bounded sample gives
each rule's selectivity and the work it does (characters, words or lines that it touches times
a unit cost); the chain runs in descending order of rejections per unit of work. The order
decides the cost and which rule is named first, never which rows are kept.

Defined cases: null and empty texts have no words, so they fail the base rule; a repeated row
is measured as often as it occurs; an empty table gives an empty result; columns other than the
id and the text are ignored; null ids pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, words

SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """A rule rejects a row where `rejects` holds; its work on a row is `unit` times `work`."""

    name: str
    rejects: str
    work: str
    unit: float


#: Over columns of measures(). Letters in either case are counted only when a rule gets to run.
RULES = (
    Rule("symbols", "10 * n_symbols > 4 * n_words", "1", 1.0),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines", "1", 1.0),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", "1", 1.0),
    Rule("capitals", r"10 * length(regexp_replace(txt, '[^\\p{Lu}]+', '')) > 6 * length(regexp_replace(txt, '[^\\p{L}]+', ''))", "length(txt)", 2.0),
    Rule("letters", r"10 * length(regexp_replace(txt, '[^\\p{L}]+', '')) < 5 * word_chars", "length(txt)", 1.0),
    Rule("exclamations", r"10 * size(filter(ws, w -> endswith(w, '!!'))) > 3 * n_words", "n_words", 1.0),
)


def repeat_words(ws: str, win: str) -> str:
    """SQL for the number of word places in windows of three that occur twice or more.

    win holds the windows in text order. Sorted with their places, equal windows are
    neighbours; the places of those that have an equal neighbour cover min(3, gap) words each.
    Words hold no white space, so a blank and a line feed delimit them without doubt.
    """
    return f"""
    CASE WHEN size(array_distinct({win})) = size({win}) THEN 0L ELSE
      aggregate(
        transform(
          array(sort_array(transform({win}, (x, i) -> concat(x, '\\n', lpad(string(i), 9, '0'))))),
          s -> transform(array(transform(s, x -> substring_index(x, '\\n', 1))),
            k -> transform(array(zip_with(k, slice(k, 2, size(k)), (a, b) -> a <=> b)),
              e -> transform(
                array(sort_array(filter(
                  transform(s, (x, i) -> CASE WHEN e[i] OR (i > 0 AND e[greatest(i - 1, 0)]) THEN int(substring_index(x, '\\n', -1)) END),
                  p -> p IS NOT NULL))),
                p -> aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (t, x) -> t + x)
              )[0])[0])[0]),
        0L, (t, x) -> t + x)
    END"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, txt, ws and the base measures of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    d = d.select("doc_id", "txt", once(words(F.col("txt"))).alias("ws"))
    win = F.expr("CASE WHEN size(ws) < 3 THEN cast(array() AS array<string>) ELSE transform(slice(ws, 1, size(ws) - 2), (w, i) -> concat(w, ' ', ws[i + 1], ' ', ws[i + 2])) END")
    lines = F.expr(r"filter(split(txt, '\n'), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))")
    d = d.select("doc_id", "txt", "ws", once(F.struct(win.alias("win"), lines.alias("lines"))).alias("s")).select("doc_id", "txt", "ws", "s.win", "s.lines")
    counts = F.struct(
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("txt", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat_words("ws", "win")).alias("n_repeat_words"),
    )
    return d.select("doc_id", "txt", "ws", once(counts).alias("m")).select("doc_id", "txt", "ws", "m.*")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def plan_cascade(measured: DataFrame, n_rows: int, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in descending order of rejections per unit of work, on about sample_rows rows chosen by a hash."""
    keep = max(1, int(2**31 * min(1.0, sample_rows / max(1, n_rows))))
    sample = measured.where(F.xxhash64("doc_id").bitwiseAND(F.lit(2**31 - 1)) < keep).where(~base_failed())
    got = sample.agg(*[F.sum(F.expr(f"IF({r.rejects}, 1D, 0D)")).alias(f"hit_{r.name}") for r in rules], *[F.sum(F.expr(f"double({r.work})")).alias(f"work_{r.name}") for r in rules]).first()
    gain = {r.name: (got[f"hit_{r.name}"] or 0.0) / max(1e-9, (got[f"work_{r.name}"] or 0.0) * r.unit) for r in rules}
    return sorted(rules, key=lambda r: (-gain[r.name], r.unit, r.name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule in order that rejects the row; null where none does."""
    return F.expr("CASE WHEN base_failed THEN 'base' " + " ".join(f"WHEN {r.rejects} THEN '{r.name}'" for r in rules) + " END")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs: id, measures, base_failed, kept and rejected_by (null where kept)."""
    measured = measures(docs, id_col, text_col)
    order = plan_cascade(measured, docs.count(), rules, sample_rows)
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", cascade(order))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))
