"""Passages of WINDOW words that stand anywhere else too, by compaction of a De Bruijn graph.

An edge of the graph is a window of WINDOW consecutive words, its nodes are the first and the last
WINDOW - 1 of them. Edges that occur twice are repeated; a maximal path of repeated edges that no
occurrence enters, leaves or branches off from within is compacted to one span, known by the
digest of its words.

1. Equal texts become one row with a count, in a table bucketed by the key of the text: later passes join
   what they learn to the texts without moving these again.
2. Seeds: of each SEED-word sequence only the smallest hash among SPAN neighbours is sent, about one
   word in ten. A window holds SPAN of them, so two equal windows have the same seed in the same
   place; windows without a seed that occurs twice are no further looked at. None is lost.
3. Edges: the windows left, as (hash of 64 bits, word before, word after). Grouped, they give counts and
   whether all occurrences go on, and come, alike; a node between two edges is nonbranching if the
   edge before it always goes on alike and the one after it always comes alike. A join tells the
   texts which of their windows are not repeated or stand at a branching node; all others need no
   message.
4. Spans: each text cuts its runs of repeated windows at branching nodes, so that all occurrences of
   a path are cut alike, and sends (source, first word, words, digest of the words of 128 bits). A span whose
   digest occurs twice is verified.
5. Spans that fail (two edges of one hash) go edge by edge, under two hashes, against all occurrences.

Counts are made before a shuffle, and joins on hashes meet at most one row for each on the other
side, which Spark splits where a hash is hot: no pairs of occurrences, no groups in one place.
A text is worked on as a whole in one task, with memory in proportion to BLOCK bytes or to the text.

Defined cases: null and empty texts have no words; a text with fewer words than a window is
left as it is; of repeated texts nothing is left if they have a window (each stands elsewhere). Ids
may repeat or be null: rows are told apart by their texts. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW, SEED = 35, 18
#: Seeds of a window.
SPAN = WINDOW - SEED + 1
#: Bytes of text that are worked on at a time, unless one text is longer.
BLOCK = 1 << 21
KEY = ["t1", "t2"]
#: Multipliers of polynomials (any odd numbers of 64 bits will do): letters, words, words of the second hash.
LETTER, FIRST, SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
FULL = np.uint64(2**64 - 1)

_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of LETTER, as many as the longest word so far has bytes."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.ones(2 * n, dtype=np.uint64)
        np.multiply.accumulate(np.full(2 * n - 1, LETTER), out=_POWERS[1:])
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers under which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """For each place, the polynomial of the n words from there on; by doubling. Places where fewer follow are not to be used."""
    out, done, part, size, power = None, 0, h, 1, base
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                moved = part if not done else shifted(part, done)
                out = moved if out is None else out + moved * np.uint64(pow(int(base), done, 1 << 64))
                done += size
            if 2 * size > n:
                return mixed(out)
            part = part + shifted(part, size) * power
            size, power = 2 * size, power * power


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


class Words:
    """The words of some texts in a row: their bytes, hashes, and places within the texts."""

    def __init__(self, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        self.bounds = offsets - offsets[0]
        inner = self.bounds[:-1][(self.bounds[:-1] < self.bounds[1:])]
        word = ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))
        before, after = np.r_[False, word[:-1]][: len(word)], np.r_[word[1:], False][: len(word)]
        before[inner] = False
        after[self.bounds[1:][self.bounds[:-1] < self.bounds[1:]] - 1] = False
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        lengths = self.ends - self.starts
        n = len(lengths)
        with np.errstate(over="ignore"):
            if n:
                first = np.cumsum(lengths) - lengths
                offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
                value = (self.data[word].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[offset]
                self.hash = mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64))
            else:
                self.hash = np.zeros(0, dtype=np.uint64)
        #: Words before each text; the text of each word; its place there; the words left from there on.
        self.base = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.base)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.place = np.arange(n) - self.base[:-1][self.text]
        self.whole = self.place + WINDOW <= self.counts[self.text]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of seeds and their hashes."""
        if not self.whole.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        x = rolled(self.hash, SEED, FIRST)
        x[self.place + SEED > self.counts[self.text]] = FULL
        x[x == 0] = np.uint64(1)
        least = np.where(self.whole, slid(x, SPAN, np.minimum, FULL), np.uint64(0))
        # A seed is the least of some window that begins at most SPAN - 1 words before it.
        most = slid(least[::-1], SPAN, np.maximum, np.uint64(0))[::-1]
        at = np.flatnonzero((most == x) & (x != FULL))
        return at, x[at]

    def candidates(self, hits: list[np.ndarray | None]) -> np.ndarray:
        """Places of windows that hold a hit, given the places of hits in each text."""
        step = np.zeros(len(self.hash) + 1, dtype=np.int64)
        for t, places in enumerate(hits):
            if places is not None and len(places):
                places = places[places < self.counts[t]]
                np.add.at(step, self.base[t] + np.maximum(places - (SPAN - 1), 0), 1)
                np.add.at(step, self.base[t] + places + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & self.whole)

    def context(self, at: np.ndarray) -> np.ndarray:
        """32 bits of the word before and 32 of the word after each window; 0 for none."""
        short = (self.hash >> np.uint64(32)) | np.uint64(1)
        short = np.r_[short, np.uint64(0)]
        before = np.where(self.place[at] > 0, short[at - 1], np.uint64(0))
        last = self.place[at] + WINDOW
        after = np.where(last < self.counts[self.text[at]], short[np.minimum(at + WINDOW, len(short) - 1)], np.uint64(0))
        return before | (after << np.uint64(32))

    def bytes_of(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n]))


def slid(x: np.ndarray, n: int, least: np.ufunc, fill: np.uint64) -> np.ndarray:
    """The least (or greatest) of the n values from each place on."""
    def later(v: np.ndarray, by: int) -> np.ndarray:
        out = np.full_like(v, fill)
        if by < len(v):
            out[: len(v) - by] = v[by:]
        return out

    size = 1
    while 2 * size <= n:
        x, size = least(x, later(x, size)), 2 * size
    return least(x, later(x, n - size)) if size < n else x


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about BLOCK bytes of text in the first column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(0)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lists(column: pa.ListArray) -> list[np.ndarray | None]:
    """The numbers of each row's list."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    return [flat[e - n : e] if n else None for e, n in zip(ends, lengths)]


def over_texts(df: DataFrame, work: Callable[[pa.RecordBatch, Words], Iterable[list]], schema: str) -> DataFrame:
    """work(rows, their words) gives columns of the schema; the first column of df is the text."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays(work(block, Words(block.column(0))), names)

    return df.mapInArrow(run, schema)


def seed_rows(texts: DataFrame) -> DataFrame:
    def work(rows: pa.RecordBatch, words: Words) -> list:
        at, x = words.seeds()
        of = pa.array(words.text[at])
        return [signed(x), rows.column(1).take(of), pa.array(words.place[at].astype(np.int32)), rows.column(2).take(of)]

    return over_texts(texts.select("text", "id", "weight"), work, "h long, id long, place int, weight long")


def edge_rows(found: DataFrame) -> DataFrame:
    """Candidate windows: hash, source, first word, words beside it, a second hash."""
    def work(rows: pa.RecordBatch, words: Words) -> list:
        at = words.candidates(lists(rows.column(3)))
        of = pa.array(words.text[at])
        if not len(at):
            return [signed(at), rows.column(1).take(of), pa.array(at.astype(np.int32)), rows.column(2).take(of), signed(at), signed(at)]
        edges, second = rolled(words.hash, WINDOW, FIRST)[at], rolled(mixed(words.hash + SECOND), WINDOW, SECOND)[at]
        return [signed(edges), rows.column(1).take(of), pa.array(words.place[at].astype(np.int32)), rows.column(2).take(of), signed(words.context(at)), signed(second)]

    return over_texts(found.select("text", "id", "weight", "hits"), work, "e long, id long, place int, weight long, beside long, e2 long")


#: What the texts are told of a window: it is no repeated one, it does not always come alike, it does not always go on alike.
LONE, BEGINS, ENDS = 1, 2, 4


def span_rows(told: DataFrame) -> DataFrame:
    """Compacted paths: source, first word, words, digest."""
    def work(rows: pa.RecordBatch, words: Words) -> list:
        at = words.candidates(lists(rows.column(3)))
        mark = np.zeros(len(words.hash), dtype=np.int8)
        mark[at] = 8
        for t, told in enumerate(lists(rows.column(4))):
            if told is not None:
                mark[words.base[t] + (told >> 3)] |= (told & 7).astype(np.int8)
        at = at[(mark[at] & LONE) == 0]
        if len(at):
            # A run ends where the next window is no repeated one, is another text's, or a node between branches.
            cut = (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]]) | ((mark[at[:-1]] & ENDS) > 0) | ((mark[at[1:]] & BEGINS) > 0)
            first, last = at[np.r_[True, cut]], at[np.r_[cut, True]]
        else:
            first = last = at
        size = last - first + WINDOW
        digests = np.frombuffer(b"".join(hashlib.blake2b(words.bytes_of(int(f), int(n)), digest_size=16).digest() for f, n in zip(first, size)), dtype=np.int64).reshape(-1, 2)
        of = pa.array(words.text[first])
        return [rows.column(1).take(of), pa.array(words.place[first].astype(np.int32)), pa.array(size.astype(np.int32)), rows.column(2).take(of), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]

    return over_texts(told.select("text", "id", "weight", "hits", "told"), work, "id long, place int, size int, weight long, d1 long, d2 long")


def texts_of(docs: DataFrame, text: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """Distinct texts (t1, t2, text, weight: 2 if there are copies, id) in a bucketed table, keys (id, t1, t2), and how to drop the table."""
    spark, n = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(text.alias("text")).where("text IS NOT NULL").select(*text_key(F.col("text")), "text")
    once = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.least(F.count(F.lit(1)), F.lit(2)).alias("weight"))
    name = f"texts_{uuid.uuid4().hex}"
    once.repartition(n, *KEY).withColumn("id", F.monotonically_increasing_id()).write.bucketBy(n, *KEY).option("path", f"{scratch.folder}/{name}").saveAsTable(name)
    table = spark.table(name)
    scratch.tables.append((table, f"{scratch.folder}/{name}"))

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop(table)

    return table, table.select("id", *KEY), drop


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def by_text(rows: DataFrame, keys: DataFrame, value: Column, name: str) -> DataFrame:
    """(t1, t2, name): the values of each text, as a list no longer than the text."""
    return rows.groupBy("id").agg(F.collect_list(value).alias(name)).join(keys, "id").select(*KEY, name)


def failed_edges(spans: DataFrame, verified: DataFrame, found: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, place, size) of windows of spans that are not verified, but stand elsewhere under two hashes."""
    failed = scratch.keep(spans.join(verified, ["d1", "d2"], "left_anti").select("id", "place", "size"), "failed")
    if failed.isEmpty():
        return None
    parts = failed.withColumn("place", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("size") - WINDOW))).select("id", "place")
    edges = edge_rows(found).select("e", "e2", "id", "place", "weight")
    asked = edges.join(parts, ["id", "place"])
    counts = edges.join(asked.select("e", "e2").distinct(), ["e", "e2"], "left_semi").groupBy("e", "e2").agg(F.sum("weight").alias("n")).where("n >= 2").select("e", "e2")
    return scratch.keep(asked.join(counts, ["e", "e2"], "left_semi").select("id", "place", F.lit(WINDOW).alias("size")), "edges")


def repeated_spans(table: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, place, size): spans of words of the texts' table that stand elsewhere, too. Together they hold all windows that do."""
    seeds = seed_rows(table)
    # Written, so that a join does not share the shuffle of the counts, which Spark may not split where a hash is hot.
    twice = scratch.keep(seeds.groupBy("h").agg(F.sum("weight").alias("n")).where("n >= 2").select("h"), "twice")
    hits = scratch.keep(by_text(seeds.select("h", "id", "place").join(twice, "h"), keys, F.col("place"), "hits"), "hits")
    found = table.join(hits, KEY)
    edges = edge_rows(found)
    told = edges.groupBy("e").agg(F.sum("weight").alias("n"), F.bit_or("beside").alias("some"), F.bit_and("beside").alias("every")).where("n >= 2")
    mixed_up = F.col("some").bitwiseXOR(F.col("every"))
    told = told.select("e", (F.when(mixed_up.bitwiseAND(F.lit(0xFFFFFFFF)) != 0, BEGINS).otherwise(0) + F.when(F.shiftrightunsigned(mixed_up, 32) != 0, ENDS).otherwise(0)).alias("what"))
    told = scratch.keep(told, "repeated")
    news = edges.select("e", "id", "place").join(told, "e", "left").select("id", "place", F.coalesce("what", F.lit(LONE)).alias("what")).where("what > 0")
    news = scratch.keep(by_text(news, keys, F.col("place").cast("long") * 8 + F.col("what"), "told"), "told")
    spans = scratch.keep(span_rows(found.join(news, KEY, "left")), "spans")
    scratch.drop(news, told, twice)
    verified = scratch.keep(spans.groupBy("d1", "d2").agg(F.sum("weight").alias("n")).where("n >= 2").select("d1", "d2"), "digests")
    good = scratch.keep(spans.join(verified, ["d1", "d2"]).select("id", "place", "size"), "verified")
    more = failed_edges(spans, verified, found, keys, scratch)
    scratch.drop(spans, verified, hits)
    return good if more is None else good.unionByName(more)


def kept_texts(table: DataFrame, spans: DataFrame, keys: DataFrame) -> DataFrame:
    """(t1, t2, n_words, n_removed, kept): the words outside the spans, joined by one space."""
    gone = by_text(spans, keys, F.col("place").cast("long") * (1 << 31) + F.col("size"), "gone")

    def work(rows: pa.RecordBatch, words: Words) -> list:
        stay = np.ones(len(words.hash), dtype=bool)
        for t, gone in enumerate(lists(rows.column(3))):
            if gone is not None:
                step = np.zeros(words.counts[t] + 1, dtype=np.int64)
                np.add.at(step, gone >> 31, 1)
                np.add.at(step, (gone >> 31) + (gone & 0x7FFFFFFF), -1)
                stay[words.base[t] : words.base[t + 1]] = np.cumsum(step[:-1]) == 0
        kept, data = [], words.data.tobytes()
        for t in range(len(rows)):
            at = np.flatnonzero(stay[words.base[t] : words.base[t + 1]]) + words.base[t]
            kept.append(b" ".join([data[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]))
        removed = words.counts - np.array([int(stay[a:b].sum()) for a, b in zip(words.base[:-1], words.base[1:])], dtype=np.int64)
        return [rows.column(1), rows.column(2), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary())]

    out = over_texts(table.join(gone, KEY, "left").select("text", *KEY, "gone"), work, "t1 long, t2 long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Callable[[Column], Column] = lambda text: text, out: str = "kept") -> DataFrame:
    """id, n_words, n_removed and keep(the text without its repeated windows), named out, of each row.

    keep is applied to distinct texts, before they go back to rows: a digest leaves the texts where
    they are. The result is written once; the other tables are deleted.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    table, keys, drop = texts_of(docs, F.col(text_col), scratch)
    spans = repeated_spans(table, keys, scratch)
    texts = kept_texts(table, spans, keys).select(*KEY, "n_words", "n_removed", keep(F.col("kept")).alias("_out"))
    rows = docs.select(F.col(id_col).alias("_id"), *text_key(F.col(text_col)), F.col(text_col).isNull().alias("_none"))
    some = rows.where("NOT _none").join(texts, KEY).select("_id", "n_words", "n_removed", "_out")
    none = rows.where("_none").select("_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), keep(F.lit("")).alias("_out"))
    done = scratch.keep(some.unionByName(none), "done")
    drop()
    scratch.drop_all_but(done)
    return done.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("_out").alias(out))
