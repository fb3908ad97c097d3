"""Benchmark decontamination by spaced seeds.

A mask such as 1111011 hashes the words under its ones and ignores those under its zeros, so a
substituted word under a zero does no harm. The two masks were chosen by enumeration: each pattern
of substitutions that `similarity` allows in `window` words leaves some place of some mask whole
(a test enumerates them). Items that a mask may not fit are sought whole as well, by a mask of all
their words, so any item that a document holds verbatim is found. Hashes of every place of every benchmark item meet
those of every place of every document; each hit fixes an alignment, which is verified on the
words themselves: some window of `window` aligned words around the hit must agree in at least
`similarity` of its places.

Items of equal words are one while hits are sought and verified; their ids come to what is left of a document. Texts are
cut into pieces that overlap by the longest item, so what a task holds at once are the hits of a piece, and a hit takes
along the words opposite its item, never the text.

Words are maximal runs of letters and digits of the lower-cased text, so case and punctuation
do not matter. Defined cases: null and empty texts have no words and match nothing; items of fewer
words than a mask spans are found if the text has all their words in a row (of 11 and 12 words,
some patterns of two substitutions are missed, of 10 and fewer most); rows that share a doc_id or
an item_id give one row for each pair of ids; null ids are ids like others; ties take the earliest
place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

#: Six words each. Of the 78 patterns of two substitutions in 13 words, each leaves a hit.
MASKS = ("1010001111", "1111011")
WINDOW = 13
SIMILARITY = 0.8
#: Up to this number the seeds of a benchmark are broadcast (hash, id, hash of the item and place each), and apart from
#: them the words of its items, fewer than eight for each seed; beyond it both are shuffled. The result is the same.
BROADCAST_SEEDS = 400_000
#: Places of a piece of a text; an item that is longer makes longer pieces.
PIECE = 1024


def words_sql(text: str) -> str:
    return f"array_remove(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')"


def seed_sql(ws: str, i: str, mask: str) -> str:
    """SQL for the hash of a mask at place i (from 0) of the words; the mask is part of the hash, and null where it does not fit."""
    picked = ", ".join(f"{ws}[{i} + {k}]" for k, c in enumerate(mask) if c == "1")
    return f"CASE WHEN {i} + {len(mask)} <= size({ws}) THEN xxhash64({picked}, '{mask}') END"


def seeds_of(rows: DataFrame, ws: str, masks: tuple[str, ...], place: str, first: str = "0", end: str | None = None) -> DataFrame:
    """rows with the columns place, mask (its number) and h, for each place of each mask, from first up to and without end (all).

    Places are rows before they are hashed, so that the hashes are compiled code, not lambdas over arrays.
    """
    each = rows.where(f"size({ws}) >= {min(map(len, masks))}").select("*", F.explode(F.expr(f"sequence({first}, {end or f'size({ws})'} - 1)")).alias(place))
    hashes = F.array(*[F.expr(seed_sql(ws, place, m)) for m in masks])
    return each.select("*", F.posexplode(hashes).alias("mask", "h")).where("h IS NOT NULL")


def pieces_of(texts: DataFrame, reach: int, size: int = PIECE) -> DataFrame:
    """Rows with words ws as pieces: piece (its number), start (its first word's place), ws, and places first up to and without end, which no other piece has.

    Around these places a piece has `reach` words more of the text on either side.
    """
    n = max(size, reach)
    begins = f"greatest(k * {n} - {reach}, 0)"
    # A lambda is not compiled, so rows come out of here one by one: compiled code would gather all hits of a text first.
    cut = f"transform(sequence(0, (size(ws) - 1) div {n}), k -> named_struct('piece', k, 'start', {begins}, 'first', k * {n} - {begins}, 'end', least((k + 1) * {n}, size(ws)) - {begins}, 'ws', slice(ws, {begins} + 1, (k + 1) * {n} + {reach} - {begins})))"
    others = [c for c in texts.columns if c != "ws"]
    return texts.where("size(ws) > 0").select(*others, F.explode(F.expr(cut)).alias("_cut")).select(*others, "_cut.*")


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item (its words) and item_h (their hash, which tells items of one id apart)."""
    return benchmark.select(F.col(id_col).alias("item_id"), once(F.expr(words_sql(f"`{text_col}`"))).alias("item")).distinct().withColumn("item_h", F.xxhash64("item"))


def masks_for(items: DataFrame, masks: tuple[str, ...]) -> tuple[str, ...]:
    """The masks, and one of all words for each length of items that a mask may not fit."""
    short = items.where(F.size("item").between(1, max(map(len, masks)) - 1)).select(F.size("item").alias("n")).distinct().collect()  # fewer lengths than a mask is long
    return (*masks, *("1" * r.n for r in sorted(short)))


def aligned_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", masks: tuple[str, ...] = MASKS, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, text_h, same_id, item_h, first_word, q, item and opposite (the text's words there, null beyond its ends) of each hit; items are those of different_items()."""
    masks = masks_for(items, masks)
    reach = max(items.agg(F.max(F.size("item"))).first()[0] or 0, *map(len, masks))
    # A mask of all words of a short item is for items of that length only.
    seeds = seeds_of(items, "item", masks, "q").where(F.expr(" AND ".join([f"(mask <> {k} OR size(item) = {len(m)})" for k, m in enumerate(masks) if "0" not in m] or ["true"])))
    seeds = seeds.select("h", "same_id", "item_h", "q", F.size("item").alias("n"))
    small = seeds.select("h").limit(broadcast_seeds + 1).count() <= broadcast_seeds
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_h"), once(F.expr(words_sql(f"`{text_col}`"))).alias("ws"))
    d = pieces_of(d, reach)
    sought = items.select(F.col("same_id").alias("i_id"), F.col("item_h").alias("i_h"), "item")
    same_item = F.col("same_id").eqNullSafe(F.col("i_id")) & (F.col("item_h") == F.col("i_h"))
    placed = seeds_of(d, "ws", masks, "p", "first", "end")
    if small:
        hits = placed.join(F.broadcast(seeds), "h")
    else:
        # Words stay behind: rows of hashes meet, and AQE splits those of a seed that many texts have.
        found = placed.select(F.col("doc_id").alias("d_id"), F.col("text_h").alias("d_h"), F.col("piece").alias("d_piece"), "p", "mask", "h").join(seeds.hint("merge"), "h").drop("h").distinct()
        # Estimates of sizes know nothing of exploded places and arrays of words, so the hints: none of these is ever broadcast.
        hits = found.join(d.hint("merge"), F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_h") == F.col("text_h")) & (F.col("d_piece") == F.col("piece")))
    part = once(F.expr("slice(ws, greatest(p - q, 0) + 1, n + least(p - q, 0))")).alias("part")
    hits = hits.select("doc_id", "text_h", "same_id", "item_h", (F.col("start") + F.col("p") - F.col("q")).alias("first_word"), "q", F.greatest(F.col("q") - F.col("p"), F.lit(0)).alias("lacks"), part)
    return hits.join(F.broadcast(sought) if small else sought.hint("merge"), same_item).drop("i_id", "i_h")


def verified(hits: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_h, same_id, item_h, item_words, first_word, agreeing of each of aligned_hits() that is verified."""
    eq = once(F.expr("transform(item, (w, j) -> int(coalesce(get(part, j - lacks) = w, false)))")).alias("eq")
    aligned = hits.select("doc_id", "text_h", "same_id", "item_h", "first_word", "q", F.size("item").alias("item_words"), eq)
    w, span = f"least({window}, item_words)", min(len(m) for m in masks if "0" in m)
    good = aligned.where(F.expr(f"exists(sequence(greatest(0, q + least({span}, {w}) - {w}), greatest(0, least(q, item_words - {w}))), s -> aggregate(slice(eq, s + 1, {w}), 0, (a, x) -> a + x) >= {similarity} * {w})"))
    return good.select("doc_id", "text_h", "same_id", "item_h", "item_words", "first_word", F.expr("aggregate(eq, 0, (a, x) -> a + x)").alias("agreeing"))


def different_items(items: DataFrame) -> DataFrame:
    """Items of different words: same_id (the least of their ids), item_h, item."""
    return items.where("size(item) > 0").groupBy("item", "item_h").agg(F.min("item_id").alias("same_id"))


def verified_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Verified hits of items of different words."""
    return verified(aligned_hits(docs, items, id_col, text_col, masks, broadcast_seeds), masks, window, similarity)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row for each (document, item) with a verified overlap: doc_id, item_id, item_words, n_hits, first_word, agreeing.

    first_word is the place in the document where the earliest aligned item would begin (negative
    if the document starts inside the item); agreeing counts equal places of the best alignment;
    n_hits counts a place of an item at a place of a row once for each mask that finds it.
    """
    items = items_of(benchmark, item_id_col, item_text_col)
    different, most = different_items(items), options.get("broadcast_seeds", BROADCAST_SEEDS)
    best = lambda n_hits: [F.max("item_words").cast("long").alias("item_words"), n_hits.alias("n_hits"), F.min("first_word").cast("long").alias("first_word"), F.max("agreeing").cast("long").alias("agreeing")]
    found = verified_hits(docs, different, **options).groupBy("doc_id", "same_id", "item_h").agg(*best(F.count(F.lit(1))))
    names = items.join(different.select("item", "same_id"), "item").select("item_id", F.col("same_id").alias("i_id"), F.col("item_h").alias("i_h"))
    few = items.select("item_h").limit(most + 1).count() <= most
    named = found.join(F.broadcast(names) if few else names.hint("merge"), F.col("same_id").eqNullSafe(F.col("i_id")) & (F.col("item_h") == F.col("i_h")))
    return named.groupBy("doc_id", "item_id").agg(*best(F.sum("n_hits")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that have a verified overlap; other texts of their ids stay."""
    items = different_items(items_of(benchmark, item_id_col, item_text_col))
    bad = verified_hits(docs, items, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_h").alias("bad_h")).distinct()
    same = docs[options.get("id_col", "doc_id")].eqNullSafe(bad.bad_id) & (F.xxhash64(docs[options.get("text_col", "text")]) == bad.bad_h)
    return docs.join(bad, same, "left_anti")
