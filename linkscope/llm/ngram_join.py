"""Jaccard self-join of texts on word n-grams, and the components of its links.

Two texts link when intersection * 100 >= percent * union of their shingle sets. Texts with one
and the same set are a class, which is joined once. Classes meet in tiles: a band of sizes, cut
further by parts. In a band, hashes deal the shingles into parts; sets that link differ in at
most d shingles, so in at most d parts, and the content of a part they have alike is a tile's key.
Sizes that link across a band's border enter both bands. Two prefix filters thin the keys
without losing a link. Of its parts a set sends the d + 1 + SPARE first in order of their content
(parts without a shingle last), where d follows the set's own size: linking sets then share at
least SPARE + 1 of those. Once all rows of each tile are counted, a set leaves its SPARE fullest
tiles, so what a passage gives to many texts is passed over; one shared tile at least remains.

A tile's pairs pass three gates. Bitmaps of hashed shingles bound the overlap from above: each
bit in which they differ is a shingle that one text lacks. Sorted shingle arrays then give the
exact intersection. First each set is held against one hub, the smallest set of most of its
tiles. Only tiles whose members still lie in several components are then searched in square
blocks: by bit counts, of whose likely pairs a block gives those that would span its components, the
nearest first; and, for tiles still open when those are verified, with the arrays of the sets that
still may link, of which a block gives spanning links only. Members of a tile's largest component do not
meet one another again. All that is sent is linear in the rows of the tiles.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z in lower case. Defined
cases: null, empty and blank texts have an empty set, and are a component of their own; a text
of fewer words than a shingle has one of all its words; rows that share an id are each judged by
their text, and a null id never names a component that has another id; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PERCENT = 90
WORDS = 3
#: A band's upper size over its lower one.
BAND = 1.7
#: Tiles that a set enters beyond those that it needs, and then the fullest ones that it leaves.
SPARE = 6
#: Sets of a tile, and about shingles, that one block of pairs takes from either side.
BLOCK = 1000
BLOCK_SHINGLES = 4_000_000
#: Bits of the largest bitmaps; beyond half as many shingles they bound the overlap less tightly.
MOST_BITS = 1 << 16
#: Rows of ids of texts to fetch again, and of tiles with several sets, that are broadcast, at about 30 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Pairs for each row up to which a block names the pairs left to verify, each once over all blocks; with more, its sets' arrays come to the block.
PAIRS_A_ROW = 8
#: Edges that a task contracts at a time.
SLICE = 200_000
_TABLE_WORDS = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_HASHES: dict[bytes, int] = {}


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_HASHES) > _TABLE_WORDS:
        _HASHES.clear()
    try:
        h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        for w in words:
            if w not in _HASHES:
                _HASHES[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * _M3 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def name_of(h: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(h.tobytes()), "little", signed=True)


def bands(percent: int, largest: int = 1 << 31) -> np.ndarray:
    """Lower sizes of the bands. Smaller sets link only when they are equal."""
    low = [max(1, -(-percent // (100 - percent)))] if percent < 100 else [1]
    while low[-1] < largest:
        low.append(int(low[-1] * BAND) + 1)
    return np.array(low, dtype=np.int64)


def most_apart(total: int, percent: int) -> int:
    """Most shingles that lie in one set only, of two linking sets of so many shingles in total."""
    return total * (100 - percent) // (100 + percent)


def keys(h: np.ndarray, low: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles of a set; their last six bits are the band."""
    out, own = [], int(np.searchsorted(low, len(h), side="right")) - 1
    for band in (own, own + 1):
        if band < 0 or band + 1 >= len(low) or len(h) * 100 < percent * low[band]:
            continue
        largest = int(low[band + 1]) - 1
        parts = most_apart(2 * largest, percent) + 1 + SPARE
        asked = most_apart(len(h) + min(largest, len(h) * 100 // percent), percent) + 1 + SPARE
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending, as h is
        has, first = np.unique(part, return_index=True)
        content = mix(np.add.reduceat(mix(h ^ _M3), first) + mix((has + (band << 40)).astype(np.uint64) + _M1))
        if len(content) > asked:
            content = np.partition(content, asked - 1)[:asked]
        elif len(content) < asked:
            lacks = np.setdiff1d(np.arange(parts), has)[: asked - len(content)]
            content = np.append(content, mix(mix((lacks + (band << 40)).astype(np.uint64) + _M1)))
        out.append(content & ~np.uint64(63) | np.uint64(band))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def bitmap(h: np.ndarray) -> bytes:
    """About two bits a shingle; larger bitmaps fold onto smaller ones."""
    bits = min(MOST_BITS, max(256, 1 << int(2 * len(h) - 1).bit_length())) if len(h) else 256
    got = np.zeros(bits, dtype=np.uint8)
    got[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(got, bitorder="little").tobytes()


def fold(a: np.ndarray, size: int) -> np.ndarray:
    while a.shape[-1] > size:
        half = a.shape[-1] // 2
        a = a[..., :half] | a[..., half:]
    return a


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles that lie apart in at least so many may link."""
    overlap = (n + m - apart) // 2
    return (overlap > 0) & (100 * overlap >= percent * (n + m - overlap))


def summaries(docs: DataFrame, id_col: str, text_col: str, percent: int, n: int) -> DataFrame:
    """doc_id, text_h (a hash of the text), set (64 bits that name it; null if empty), n_shingles, bits and tiles of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    low = bands(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, bits, tiles = [], [], [], []
            for text in batch.column(2):
                h = shingles(text.as_py(), n)
                sizes.append(len(h))
                sets.append(name_of(h) if len(h) else None)
                bits.append(bitmap(h) if len(h) else None)
                tiles.append(keys(h, low, percent).view(np.int64))
            at = np.cumsum([0, *map(len, tiles)])
            flat = pa.array(np.concatenate(tiles) if tiles else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], ["doc_id", "text_h", "set", "n_shingles", "bits", "tiles"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_h"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {id_type}, text_h bigint, set bigint, n_shingles bigint, bits binary, tiles array<bigint>")


def sent(df: DataFrame) -> DataFrame:
    """df, broadcast if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def arrays_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """set and hashes (its sorted shingles) of the sets wanted, which are named with the id of a text of theirs: set, want."""

    def arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [shingles(t.as_py(), n) for t in batch.column(1)]
            good = [k for k, s in enumerate(batch.column(0)) if name_of(h[k]) == s.as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), pa.array([h[k].tobytes() for k in good], pa.binary())], ["set", "hashes"])

    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text")).join(sent(wanted), F.col("text_id").eqNullSafe(F.col("want"))).select("set", "text")
    return texts.mapInArrow(arrays, "set bigint, hashes binary").dropDuplicates(["set"])


def differing(x: bytes, y: bytes) -> int:
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sides: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, n: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of sets that link; sides: set, want, n_shingles, bits."""
    side = lambda x: sides.select(F.col("set").alias(x), F.col("want").alias(f"want_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def bound(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            apart = np.fromiter(map(differing, f["bits_a"], f["bits_b"]), dtype=np.int64, count=len(f))
            yield f.loc[may_link(f["n_a"].to_numpy(), f["n_b"].to_numpy(), apart, percent), ["a", "b", "want_a", "want_b"]]

    id_type = sides.schema["want"].dataType.simpleString()
    left = scratch.keep(both.mapInPandas(bound, f"a bigint, b bigint, want_a {id_type}, want_b {id_type}"), "pairs")
    wanted = left.select(F.col("a").alias("set"), F.col("want_a").alias("want")).union(left.select("b", "want_b")).distinct()
    sets = arrays_of(wanted, docs, id_col, text_col, n)

    def intersect(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(f["x"], f["y"])]
            yield f.loc[np.array(good, dtype=bool), ["a", "b"]]

    full = left.select("a", "b").join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b")
    out = scratch.keep(full.select("a", "b", "x", "y").mapInPandas(intersect, "a bigint, b bigint"), "links")
    scratch.drop(left)
    return out


def top(above: dict[int, int], x: int) -> int:
    while above.get(x, x) != x:
        above[x] = x = above.get(above[x], above[x])
    return x


def forest(edges: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v), u > v, of each SLICE of rows as (node, smallest node of its component in the slice)."""

    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        above: dict[int, int] = {}
        for x, y in zip(t.column("u").to_pylist(), t.column("v").to_pylist()):
            x, y = top(above, x), top(above, y)
            if x != y:
                above[max(x, y)] = min(x, y)
        return pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([top(above, x) for x in list(above)], pa.int64())], ["u", "v"])

    held, rows = [], 0
    for batch in edges:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SLICE:
            yield contracted(held)
            held, rows = [], 0
    if rows:
        yield contracted(held)


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and root (its component's smallest node) of every node of the links (a, b), by alternating large and small stars.

    Edges lead from the larger node. What is written is contracted slice by slice before, so a node leads to few
    smaller ones (one for each slice at most), and few rounds remain. Contractions and stars never add edges, and
    lower the sum of their nodes until every component is one star, which they leave as it is.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    kept = lambda pairs: scratch.keep(pairs.mapInArrow(forest, "u bigint, v bigint"), "edges")
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state, before = now, edges
        least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = edges.join(least, edges.v == least.x, "left").select("u", F.coalesce("m", "v").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        edges = kept(small.select(F.explode(F.expr("transform(vs, v -> struct(IF(v = m, u, v) AS u, m AS v))")).alias("e")).select("e.u", "e.v"))
        scratch.drop(before)


def open_tiles(members: DataFrame, roots: DataFrame, tried: DataFrame) -> DataFrame:
    """tile, set, root, main (of the tile's largest component), rest and most (rows of others and of it) of tiles whose sets lie in several components.

    members: tile, set; roots: node, root; tried: pairs (a, b) that have been compared. Of tiles with the same sets one stays.
    """
    rooted = members.join(roots, members.set == roots.node, "left").select("tile", "set", F.coalesce("root", "set").alias("root"))
    parts = rooted.groupBy("tile", "root").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("least"), F.max("set").alias("largest"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y"))
    tiles = parts.groupBy("tile").agg(
        F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("root", "n").alias("top"), F.count(F.lit(1)).alias("roots"),
        F.min("least").alias("a"), F.max("largest").alias("b"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
    ).where("roots > 1")
    tiles = tiles.join(tried.withColumn("two", F.lit(2)), (tiles.rows == F.col("two")) & (tiles.a == tried.a) & (tiles.b == tried.b), "left_anti")
    tiles = tiles.dropDuplicates(["rows", "x", "y"]).select("tile", "top", "most", (F.col("rows") - F.col("most")).alias("rest"))
    return rooted.join(tiles, "tile").select("tile", "set", "root", (F.col("root") == F.col("top")).alias("main"), "rest", "most")


def in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """rows of open_tiles() with i, j: each block of rows of other components meets itself, those after it, and the blocks of the main one."""
    low = F.element_at(F.lit(bands(percent).tolist()), (F.col("tile").bitwiseAND(F.lit(63)) + 1).cast("int"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(2), F.lit(BLOCK_SHINGLES) / low))
    t = rows.withColumn("others", F.ceil(F.col("rest") / block).cast("int")).withColumn("mains", F.ceil(F.col("most") / block).cast("int"))
    t = t.withColumn("own", F.pmod(F.xxhash64("set"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    meets = """
      IF(main, transform(sequence(0, others - 1), o -> struct(o AS i, others + own AS j)),
               concat(transform(sequence(0, others - 1), o -> struct(least(own, o) AS i, greatest(own, o) AS j)),
                      transform(sequence(0, mains - 1), o -> struct(own AS i, others + o AS j))))"""
    t = t.select("tile", "set", "root", "rest", F.when(F.col("main"), F.col("others") + F.col("own")).otherwise(F.col("own")).alias("own"), F.explode(F.expr(meets)).alias("at"))
    return t.select("tile", "set", "root", "own", F.col("at.i").alias("i"), F.col("at.j").alias("j")).where("i < j OR rest > 1")


def runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each value of the keys, from batches sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        values = [t.column(k).to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1).tolist(), t.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(v[lo] for v in values)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def candidates(t: pa.Table, bits: list[bytes], n: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, row numbers of those of other components that bit counts let link with it, and bits apart, of a block's rows."""
    own, root = t.column("own").to_numpy(), t.column("root").to_numpy()
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if not len(left) or not len(right):
        return
    size = min(map(len, bits))
    folded = np.stack([fold(np.frombuffer(b, dtype=np.uint8), size) for b in bits]).view(np.uint64)
    theirs, m, r = folded[right], n[right], root[right]
    for k in left:
        apart = np.bitwise_count(theirs ^ folded[k]).sum(axis=1, dtype=np.int64)
        good = may_link(n[k], m, apart, percent) & (r != root[k])
        if i == j:
            good &= right > k
        if good.any():
            yield k, right[good], apart[good]


def likely(open_: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open tiles that bit counts let link: of each block those that would span its components, the nearest first."""

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, TILE_BLOCK):
            n, ids, roots = t.column("n_shingles").to_numpy(), t.column("set").to_numpy(), t.column("root").to_pylist()
            found = [(np.full(len(them), k), them, apart / (n[k] + n[them])) for k, them, apart in candidates(t, t.column("bits").to_pylist(), n, percent)]
            if not found:
                continue
            k, o, far = (np.concatenate(x) for x in zip(*found))
            above: dict[int, int] = {}
            out = []
            for e in np.argsort(far, kind="stable").tolist():
                x, y = top(above, roots[k[e]]), top(above, roots[o[e]])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    out.append(e)
            x, y = ids[k[out]], ids[o[out]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    rows = in_blocks(open_, percent).join(sides, "set").select(*TILE_BLOCK, "own", "set", "root", "n_shingles", "bits")
    return together(rows).mapInArrow(nearest, "a bigint, b bigint").distinct()


TILE_BLOCK = ("tile", "i", "j")


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TILE_BLOCK).sortWithinPartitions(*TILE_BLOCK)


def searched(open_: DataFrame, tried: DataFrame, sides: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, n: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the components of open tiles: all of sparse blocks that are not in tried, and of dense ones those that span them."""
    id_type = sides.schema["want"].dataType.simpleString()
    names = [*TILE_BLOCK, "own", "set", "root", "want"]

    def survivors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, TILE_BLOCK):
            found = [(np.full(len(them), k), them) for k, them, _ in candidates(t, t.column("bits").to_pylist(), t.column("n_shingles").to_numpy(), percent)]
            if not found:
                continue
            k, o = (np.concatenate(x) for x in zip(*found))
            if len(k) <= PAIRS_A_ROW * t.num_rows:
                ids = t.column("set").to_numpy()
                one = t.select(names).take(k).set_column(names.index("set"), "set", pa.array(np.minimum(ids[k], ids[o])))
                out = one.append_column("other", pa.array(np.maximum(ids[k], ids[o])))
            else:
                out = t.select(names).take(np.unique(np.append(k, o)))
                out = out.append_column("other", pa.nulls(out.num_rows, pa.int64()))
            yield from out.to_batches()

    rows = in_blocks(open_, percent).join(sides, "set").select(*names, "n_shingles", "bits")
    both = scratch.keep(together(rows).mapInArrow(survivors, f"tile bigint, i int, j int, own int, set bigint, root bigint, want {id_type}, other bigint"), "survivors")
    pairs = both.where("other IS NOT NULL").select(F.col("set").alias("a"), F.col("other").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = verified(pairs, sides, docs, id_col, text_col, percent, n, scratch)
    left = both.where("other IS NULL").drop("other")
    sets = arrays_of(left.select("set", "want").distinct(), docs, id_col, text_col, n)

    def spanning(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, TILE_BLOCK):
            arrays = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("hashes")]
            above: dict[int, int] = {}
            out, ids, roots = [], t.column("set").to_pylist(), t.column("root").to_pylist()
            sizes = np.array([len(x) for x in arrays], dtype=np.int64)
            for k, them, _ in candidates(t, [bitmap(x) for x in arrays], sizes, percent):
                for o in them:
                    x, y = top(above, roots[k]), top(above, roots[o])
                    if x != y and linked(arrays[k], arrays[o], percent):
                        above[max(x, y)] = min(x, y)
                        out.append((ids[k], ids[o]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    found = together(left.drop("want").join(sets, "set").select(*TILE_BLOCK, "own", "set", "root", "hashes")).mapInArrow(spanning, "a bigint, b bigint")
    out = scratch.keep(found.distinct().union(links), "links")
    scratch.drop(both)
    return out


def labelled(docs: DataFrame, id_col: str, text_col: str, percent: int, n: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_h, n_shingles, set and root (the component's smallest set; null for texts without words) of each row."""
    rows = scratch.keep(summaries(docs, id_col, text_col, percent, n), "sets")
    full = rows.where(F.col("set").isNotNull())
    each = full.select(F.explode("tiles").alias("tile"), "set")
    # Most tiles have one set. Rows of copies are merged before the shuffle, where they are many.
    shared = scratch.keep(each.groupBy("tile").agg(F.min("set").alias("least"), F.max("set").alias("largest"), F.count(F.lit(1)).alias("n")).where("least < largest").select("tile", "n"), "shared")
    fullest = Window.partitionBy("set", F.col("tile").bitwiseAND(F.lit(63))).orderBy(F.desc("n"), F.desc("tile"))
    met = each.join(sent(shared), "tile").distinct().withColumn("rank", F.row_number().over(fullest)).where(F.col("rank") > SPARE)
    met = scratch.keep(met.select("tile", "set"), "tiles")
    scratch.drop(shared)
    first = full.groupBy("set").agg(F.min("doc_id").alias("want"))
    named = sent(scratch.keep(met.select("set").distinct().join(first, "set"), "named"))
    own = full.select("set", "doc_id", "n_shingles", "bits").join(named.select(F.col("set").alias("s"), "want"), (F.col("set") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("want")))
    sides = scratch.keep(own.select("set", "want", "n_shingles", "bits").dropDuplicates(["set"]), "sides")
    slim = scratch.keep(rows.select("doc_id", "text_h", "n_shingles", "set"), "rows")
    scratch.drop(rows)
    hubs = met.groupBy("tile").agg(F.min("set").alias("a"))
    stars = met.join(hubs, "tile").where("set > a").groupBy("set", "a").agg(F.count(F.lit(1)).alias("n")).groupBy("set").agg(F.max_by("a", "n").alias("a"))
    stars = scratch.keep(stars.select("a", F.col("set").alias("b")), "stars")
    links = verified(stars, sides, docs, id_col, text_col, percent, n, scratch)
    roots = components(links, scratch)
    pairs = scratch.keep(likely(open_tiles(met, roots, stars), sides, percent), "likely")
    links = links.union(verified(pairs, sides, docs, id_col, text_col, percent, n, scratch))
    roots = components(links, scratch)
    tried = stars.union(pairs)
    more = searched(open_tiles(met, roots, tried), tried, sides, docs, id_col, text_col, percent, n, scratch)
    roots = scratch.keep(components(links.union(more), scratch), "roots")
    scratch.drop_all_but(slim, roots)
    return slim.join(roots, slim.set == roots.node, "left").select("doc_id", "text_h", "n_shingles", "set", F.coalesce("root", "set").alias("root"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id of its component) of each row."""
    rows = labelled(docs, id_col, text_col, percent, n, Scratch(docs.sparkSession, "ngram-join"))
    ids = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """docs with one row of each component, that of the smallest (id, hash of the text); null ids come last.

    Rows are told apart by id and text, so other texts of an id that goes stay, and rows of equal
    id and text leave one. Rows without words stay, all of them.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = labelled(docs, id_col, text_col, percent, n, scratch).where("root IS NOT NULL")
    each = scratch.keep(rows.groupBy("root", "doc_id", "text_h").agg(F.count(F.lit(1)).alias("copies")), "each")
    best = each.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_h")).alias("best")).where("texts > 1")
    lost = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_h") == F.col("best.text_h")))
    key = [F.col("doc_id").alias("one_id"), F.col("text_h").alias("one_h")]
    gone = scratch.keep(each.join(best, "root").where(lost).select(key), "gone")
    twice = scratch.keep(each.where("copies > 1").select(key), "twice")
    scratch.drop_all_but(gone, twice)
    same = lambda t: docs[id_col].eqNullSafe(t.one_id) & (F.xxhash64(docs[text_col]) == t.one_h)
    kept = docs.join(sent(gone), same(gone), "left_anti")
    if twice.isEmpty():
        return kept
    extra = kept.join(sent(twice), same(twice), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(sent(twice), same(twice), "left_anti").union(extra)
