"""Line dedup: an edit-distance join of all distinct lines by segment partition.

A line goes when an equal line stands earlier, whatever its length, or when it has at least
`min_chars` characters and a line of as many, within `edits` edits of it, stands earlier; earlier
means a smaller (document id, line number) at first occurrence. Blank lines stay.

Method: every distinct line is cut into edits + 1 even segments. If two lines are within
`edits` edits, a segment of the shorter one occurs in the longer one, displaced by no more than
the edits allow. So each line enters an index under (its length, segment number, hash of the
segment) and probes it with the substrings of itself that may match, for each length down to
its own less `edits`: lengths are part of the key, and the displacements tried are those that
leave enough edits for either side (multi-match-aware selection). An index entry's key is also a
probe of its own line, so each key of a line is sent once, with its part in it.

Distinct lines bear a number in the order of their first places, so only earlier lines answer.
First each line is held against the earliest line of each of its keys; lines so found are done
with. The others meet all earlier lines of their keys, in a join whose condition compares 64-bit
signatures: the parity of the number of each character, of which an edit changes two at most.
What passes is verified by a banded bit-parallel edit distance: the band of 2 * edits + 1
diagonals fits one long. So lines that merely share a segment never leave the join as pairs.

Lines are known by two 64-bit hashes. Whole texts are shuffled once for the keys, which only
first occurrences enter, and once for the result; all else is hashes, places, and the lines that
share a key with another one.

Defined cases: null texts stay null and have no lines; empty lines stay; rows that share an id
and line number tie and both count as first; null ids sort first; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, once

EDITS = 2
#: Characters of a line from which near lines are sought; two edits make another line of a short one.
MIN_CHARS = 25
#: Places of lines to fetch again that are broadcast, at about 50 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def segment(length: str, i: int, parts: int) -> tuple[str, str]:
    """Start (from 1) and length of segment i (from 0) of a line of that length, in SQL."""
    lo, hi = f"div({i} * ({length}), {parts})", f"div({i + 1} * ({length}), {parts})"
    lo, hi = lo.replace("div(", "int(floor(").replace(f", {parts})", f" / {parts}))"), hi.replace("div(", "int(floor(").replace(f", {parts})", f" / {parts}))")
    return f"({lo} + 1)", f"({hi} - {lo})"


def keys_of(edits: int) -> str:
    """SQL: the keys of a line, with part 3 where they are its index entries (and probes), 2 where they are probes only."""
    keys = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            p, n = segment(f"(len - {less})", i, edits + 1)
            for by in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                keys.append(f"struct(xxhash64(substring(line, {p} + {by}, {n}), len - {less}, {i}) AS key, {2 if less or by else 3} AS part)")
    return "array(" + ", ".join(keys) + ")"


#: SQL: one bit for each character number modulo 64, set if such characters are odd in number.
SIGNATURE = "aggregate(split(line, ''), 0L, (s, c) -> s ^ shiftleft(1L, ascii(c) % 64))"


def banded_distance(a: str, b: str, edits: int) -> str:
    """SQL: the edit distance of the strings a and b if it is at most `edits`, else a larger number.

    Column j of the dynamic-programming table is kept only at rows j - edits to j + edits, as
    bits of vertical differences (vp: +1, vn: -1) in a word that moves down the diagonal by one
    with each character of b. Bit r is row j - edits + r; the score follows the diagonal that
    ends in the corner of the table (bit edits + length(a) - length(b)).
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    match = " | ".join(f"IF(get(p, j - {edits} + {r}) <=> c, {1 << r}L, 0L)" for r in range(width))
    return f"""
    CASE WHEN abs(length({a}) - length({b})) > {edits} THEN {edits + 1} ELSE
    transform(array(named_struct('p', split({a}, ''), 't', filter(split({b}, ''), c -> c <> ''), 'corner', {edits} + length({a}) - length({b}))), z ->
      transform(array(z.p), p ->
        aggregate(
          transform(z.t, (c, j) -> {match}),
          named_struct('vp', {full ^ ((1 << edits) - 1)}L, 'vn', 0L, 'd', greatest(0, z.corner - {edits})),
          (s, m) ->
            transform(array((((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {full}L)), d0 ->
              transform(array(named_struct('hp', s.vn | (~(d0 | s.vp) & {full}L), 'hn', d0 & s.vp)), h ->
                named_struct(
                  'vp', (h.hn | ~(shiftright(d0, 1) | h.hp)) & {full}L,
                  'vn', shiftright(d0, 1) & h.hp,
                  'd', s.d + IF(shiftright(d0, z.corner) & 1L = 1L, 0, 1)))[0])[0],
          s -> s.d))[0])[0] END"""


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, no, the hashes and is_long (for the near search) of all lines that are not blank; docs has doc_id and text."""
    d = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return d.select("doc_id", "no", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), (F.length("line") >= min_chars).alias("is_long"))


def texts_of(places: DataFrame, docs: DataFrame, few: bool = False) -> DataFrame:
    """ord and line of places (doc_id, no, h1, ord); few: they may be broadcast."""
    asked = places.groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_list(F.struct("no", "h1", "ord")).alias("asked"))
    both = docs.join(F.broadcast(asked) if few else asked, F.col("doc_id").eqNullSafe(F.col("asked_id")))
    # A text is split once, not anew for each of its lines that are asked for.
    split = both.select("asked", once(F.split("text", "\n")).alias("ls"))
    lines = split.select(F.explode(F.expr("transform(asked, x -> struct(x.ord, x.h1, get(ls, x.no) AS line))")).alias("x")).select("x.*")
    # Rows that share an id are told apart by the hash; equal ones among them give a line twice.
    return lines.where(F.xxhash64("line") == F.col("h1")).select("ord", "line")


def alike(x: Column, y: Column, edits: int) -> Column:
    """Whether signatures allow so many edits."""
    return F.bit_count(x.bitwiseXOR(y)) <= 2 * edits


def within(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """x of the pairs (x, y) of line numbers that are within `edits` edits; lines: ord, line, sig."""
    side = lambda x: lines.select(F.col("ord").alias(x), F.col("line").alias(f"line_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where(alike(F.col("sig_x"), F.col("sig_y"), edits))
    return both.where(F.expr(f"{banded_distance('line_x', 'line_y', edits)} <= {edits}")).select("x").distinct()


def near_lines(first: DataFrame, docs: DataFrame, edits: int, scratch: Scratch) -> DataFrame:
    """ord of each line that has an earlier one within `edits` edits; first: ord, h1, doc_id, no of each distinct line."""
    keyed = texts_of(first, docs).withColumn("len", F.length("line"))
    each = keyed.select("ord", F.explode(F.expr(keys_of(edits))).alias("k")).select("ord", "k.key", "k.part")
    of_key, entry = Window.partitionBy("key"), F.when(F.col("part") == 3, F.col("ord"))
    met = each.select(
        "key", "part", "ord", F.min("ord").over(of_key).alias("least"), F.max("ord").over(of_key).alias("most"),
        F.min(entry).over(of_key).alias("least_entry"), F.max(entry).over(of_key).alias("most_entry"),
    )
    other = lambda lo, hi: (F.col(lo) != F.col("ord")) | (F.col(hi) != F.col("ord"))
    met = met.where(other("least_entry", "most_entry") | ((F.col("part") == 3) & other("least", "most")))
    met = scratch.keep(met.select("key", "part", "ord", "least", "least_entry").distinct(), "met")
    asked = first.join(met.select("ord").distinct(), "ord", "left_semi")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lines = scratch.keep(texts_of(asked, docs, few).dropDuplicates(["ord"]).withColumn("sig", F.expr(SIGNATURE)), "texts")
    tried = met.select(F.col("ord").alias("x"), F.explode(F.array("least_entry", F.when(F.col("part") == 3, F.col("least")))).alias("y")).where("y < x").distinct()
    near = scratch.keep(within(tried, lines, edits), "near")
    signed = met.join(lines.select("ord", "sig"), "ord")
    x = signed.join(near, signed.ord == near.x, "left_anti").where("ord > least").select("key", F.col("ord").alias("x"), F.col("part").alias("part_x"), F.col("sig").alias("sig_x"), "least", "least_entry")
    y = signed.select("key", F.col("ord").alias("y"), F.col("part").alias("part_y"), F.col("sig").alias("sig_y"))
    new = "y < x AND ((part_y = 3 AND y <> least_entry) OR (part_x = 3 AND y <> least AND NOT (part_y = 3 AND y = least_entry)))"
    pairs = x.join(y, (x.key == y.key) & F.expr(new) & alike(F.col("sig_x"), F.col("sig_y"), edits)).select("x", "y").distinct()
    return near.union(within(pairs, lines, edits))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, no and near (false: an equal line stands earlier) of every line that goes."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    at = scratch.keep(lines_of(own, min_chars), "lines")
    first = at.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("is_long").alias("is_long"))
    unordered = scratch.keep(first.select("h1", "h2", "first.doc_id", "first.no", "n", "is_long"), "distinct")
    # Numbers ascend with the places, as the partitions are ranges of them.
    first = scratch.keep(unordered.repartitionByRange("doc_id", "no").sortWithinPartitions("doc_id", "no").withColumn("ord", F.monotonically_increasing_id()), "first")
    scratch.drop(unordered)
    near = near_lines(first.where("is_long").select("ord", "h1", "doc_id", "no"), own, edits, scratch)
    near = near.withColumn("near", F.lit(True))
    gone = first.join(near, first.ord == near.x, "left").where("n > 1 OR near").select("h1", "h2", F.col("doc_id").alias("f_id"), F.col("no").alias("f_no"), F.coalesce("near", F.lit(False)).alias("near"))
    is_first = F.col("f_id").eqNullSafe(F.col("doc_id")) & (F.col("f_no") == F.col("no"))
    found = at.join(gone, ["h1", "h2"]).where(F.col("near") | ~is_first).select("doc_id", "no", (F.col("near") & is_first).alias("near"))
    found = scratch.keep(found, "gone")
    scratch.drop_all_but(found)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines that go taken out of the text, and the columns n_lines, n_exact and n_near (long).

    A text of which no line stays is empty. Other columns are kept, but for ones of these three names.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    ids, nos, exact, near = (next(n for n in (f"_gone{'_' * k}_{x}" for k in range(len(rest) + 1)) if n not in rest) for x in ("id", "nos", "exact", "near"))
    found = repeated_lines(docs, id_col, text_col, edits, min_chars)
    gone = found.groupBy(F.col("doc_id").alias(ids)).agg(F.collect_set("no").alias(nos), F.count_if(~F.col("near")).alias(exact), F.count_if("near").alias(near))
    out = docs.select(rest).join(gone, F.col(id_col).eqNullSafe(F.col(ids)), "left")
    text = F.when(F.col(nos).isNull(), F.col(text_col)).otherwise(F.expr(f"transform(array(split(`{text_col}`, '\\n')), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), `{nos}`), i -> get(ls, i)), '\\n'))[0]"))
    return out.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in rest],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(text_col, "\n"))).cast("long").alias("n_lines"),
        F.coalesce(exact, F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(near, F.lit(0)).cast("long").alias("n_near"),
    )
