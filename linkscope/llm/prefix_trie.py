"""Prefix trie of conversations, and what a cache of shared prefixes would save at each node.

rebuild() makes the conversations: each takes its first h turns from the first conversation of its
hundred, h being the CRC-32 of its decimal id modulo 6, and the rest from itself. A node stands
for a distinct sequence of turns. Its key is the exclusive or of digests of (position, turn): 128
bits, which any prefix sum of exclusive ors gives, so that a conversation of any length is
scanned in chunks. Texts are digested where they are read and are never shuffled.

Numbering. Turns are dealt by ranges of (conversation, turn) and written once; a task numbers the
turns of its range, and as many rows as there are ranges say where each range begins within the
conversation that it continues. Keys follow likewise.

Rollup. Edges lead from a node's key to its parent's. With ptr the ancestor at distance 2 ** r and
sums over descendants nearer than 2 ** r, a round adds to each node the sums of those that point
at it and doubles the distance of the pointers, which takes about log2 of the greatest depth
rounds. Each round is written in the shared folder and cuts the lineage. Sums are made before
the shuffle, so that a node with any number of children is no hot key; what remains to be looked
up, one row for each pointer, is a join that Spark splits where it is skewed.

A node's members that end there are hashed in ascending order. Blocks of at most BLOCK ids become
strings first; where a node has several, one pass streams them through SHA-256 with constant
memory (a single hash of all bytes in order cannot be divided).

Defined cases: rows without conv_id are left out; a null role or text is an empty one; null turns
come first; equal turns follow the SHA-256 of the turn; repeated rows are turns of their own; a
conversation without turns ends at the root; an empty table has no nodes. Remainders keep the
sign of the id. Columns of the input other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Ids of a node that are joined into one string at a time: the conversations of one block of ids.
BLOCK = 4096
#: Parts that a lookup by the hundred's first conversation is dealt into, as one conversation may hold most turns.
SALTS = 16
KEY = ["a", "b"]


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred, at most: 0 to 5."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of a SHA-256."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def lane(no: int, position: Column, x: Column) -> Column:
    return F.xxhash64(F.lit(no), position, x)


def numbered_in_ranges(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, conv_id, no, x, size): turns in order within each range `part`; no counts a conversation's turns of that range from 1."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = turns.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("x"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).where("conv_id IS NOT NULL")
    # The last key tells repeated rows apart, however many there are.
    order = ["conv_id", F.asc_nulls_first("turn"), "x", "tie"]
    ranged = x.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            new = np.r_[True, ids[1:] != ids[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            no = np.arange(len(ids)) - start + 1
            if ids[0] == last:
                no[start == 0] += seen
            last, seen = ids[-1], int(no[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(no, pa.int64()), batch.column(2), batch.column(3)], ["part", "conv_id", "no", "x", "size"])

    kept = ranged.select(F.spark_partition_id().alias("part"), F.col("conv_id").cast("long").alias("conv_id"), "x", "size")
    return scratch.keep(kept.mapInArrow(number, "part int, conv_id long, no long, x string, size long"), "turns")


def continued(totals: DataFrame, before: dict[str, Column]) -> DataFrame:
    """Of totals by (part, conv_id): what the smaller parts of a conversation hold, where there are any. One row a part at most."""
    w = Window.partitionBy("conv_id").orderBy("part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", "conv_id", F.row_number().over(w).alias("_nth"), *[c.over(earlier).alias(name) for name, c in before.items()]).where("_nth > 1").drop("_nth")


def members(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, depth, pa, pb, size, conv_id) for each rebuilt conversation and node on its way, and (a, b, conv_id) of each end."""
    rows = numbered_in_ranges(turns, scratch)
    totals = rows.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    starts = continued(totals, {"before": F.sum("n")})
    rows = rows.join(F.broadcast(starts), ["part", "conv_id"], "left").withColumn("k", F.col("no") + F.coalesce("before", F.lit(0))).drop("before")
    convs = totals.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", shared_turns(F.col("conv_id"))).withColumn("hundred", F.col("conv_id") - F.col("conv_id") % 100)
    # The first turns of each hundred's first conversation: keys after 0, 1, ... of them.
    heads = rows.where("conv_id % 100 = 0 AND k <= 5").groupBy(F.col("conv_id").alias("hundred")).agg(F.array_sort(F.collect_list(F.struct("k", lane(1, F.col("k"), F.col("x")).alias("la"), lane(2, F.col("k"), F.col("x")).alias("lb"), "size"))).alias("t"))
    heads = scratch.keep(heads, "heads")
    zero = F.lit(0).cast("long")
    xor = lambda upto, f: F.aggregate(F.slice("t", F.lit(1), upto), zero, lambda acc, t: acc.bitwiseXOR(t[f]))
    m = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.least(F.col("h"), F.size("t"))).cast("int")

    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("h", shared_turns(F.col("conv_id"))).where("k > h").withColumn("hundred", F.col("conv_id") - F.col("conv_id") % 100).withColumn("salt", (F.col("k") % SALTS).cast("int"))
    own = own.join(salted, ["hundred", "salt"], "left").withColumn("m", m).withColumn("depth", F.col("k") - F.col("h") + F.col("m"))
    own = own.select("part", "conv_id", "k", "depth", "size", F.when(F.col("m") > 0, xor(F.col("m"), "la")).otherwise(zero).alias("ha"), F.when(F.col("m") > 0, xor(F.col("m"), "lb")).otherwise(zero).alias("hb"), lane(1, F.col("depth"), F.col("x")).alias("la"), lane(2, F.col("depth"), F.col("x")).alias("lb"))
    own = scratch.keep(own, "own")
    sums = own.groupBy("part", "conv_id").agg(F.bit_xor("la").alias("la"), F.bit_xor("lb").alias("lb"))
    starts = continued(sums, {"qa": F.bit_xor("la"), "qb": F.bit_xor("lb")})
    run = Window.partitionBy("part", "conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    keyed = own.withColumns({"ra": F.bit_xor("la").over(run), "rb": F.bit_xor("lb").over(run)}).join(F.broadcast(starts), ["part", "conv_id"], "left")
    at = lambda c: F.col(f"h{c}").bitwiseXOR(F.col(f"r{c}")).bitwiseXOR(F.coalesce(f"q{c}", zero))
    keyed = keyed.select(at("a").alias("a"), at("b").alias("b"), "depth", "la", "lb", "size", "conv_id")
    keyed = keyed.select("a", "b", "depth", F.col("a").bitwiseXOR(F.col("la")).alias("pa"), F.col("b").bitwiseXOR(F.col("lb")).alias("pb"), "size", "conv_id")

    taken = convs.join(heads, "hundred", "left").withColumn("m", m)
    taken = taken.withColumn("way", F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(1), F.col("m")), lambda d: F.struct(d.cast("long").alias("depth"), xor(d, "la").alias("a"), xor(d, "lb").alias("b"), xor(d - 1, "la").alias("pa"), xor(d - 1, "lb").alias("pb"), F.element_at("t", d)["size"].alias("size")))))
    shared = taken.select("conv_id", F.explode("way").alias("w")).select("w.a", "w.b", "w.depth", "w.pa", "w.pb", "w.size", "conv_id")
    root = convs.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("size"), "conv_id")
    tails = sums.groupBy("conv_id").agg(F.bit_xor("la").alias("ta"), F.bit_xor("lb").alias("tb"))
    last = lambda c: F.coalesce(F.element_at("way", -1)[c], zero).bitwiseXOR(F.coalesce(f"t{c}", zero)).alias(c)
    ends = taken.join(tails, "conv_id", "left").select(last("a"), last("b"), "conv_id")
    return keyed.unionByName(shared).unionByName(root), ends


def hashed_ends(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, ends_sha256) of the nodes where conversations end."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = scratch.keep(ends.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids")), "ends")
    counted = blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("one"))
    single = counted.where("n = 1").select(*KEY, F.sha2("one", 256).alias("ends_sha256"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, ([], [], [])
        for batch in batches:
            for a, b, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    for column, value in zip(done, (*key, state.hexdigest())):
                        column.append(value)
                key, state = (a, b), hashlib.sha256(ids.encode())
        if key:
            for column, value in zip(done, (*key, state.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], [*KEY, "ends_sha256"])

    several = blocks.join(counted.where("n > 1").select(*KEY), KEY).repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return single.unionByName(several.mapInArrow(run, "a long, b long, ends_sha256 string"))


def rolled_up(nodes: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(a, b, n_leaves, saved_tokens): sums over the subtree of each node, by doubling the distance of pointers. nodes: a, b, depth, pa, pb, n_leaves, saved_tokens."""
    state, span = nodes, 1
    while span <= depth:
        pointing = state.where(F.col("depth") >= span)
        given = pointing.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = pointing.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("na"), F.col("pb").alias("nb"))
        deep = state.where(F.col("depth") >= 2 * span).join(further, ["pa", "pb"]).select(*KEY, "depth", F.col("na").alias("pa"), F.col("nb").alias("pb"), "n_leaves", "saved_tokens")
        # These point beyond the root now, and at nothing.
        near = state.where(F.col("depth") < 2 * span).withColumns({"pa": F.lit(None).cast("long"), "pb": F.lit(None).cast("long")}).select(deep.columns)
        new = deep.unionByName(near).join(given, KEY, "left").select(*KEY, "depth", "pa", "pb", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        kept = scratch.keep(new, "rollup")
        if state is not nodes:
            scratch.drop(state)
        state, span = kept, 2 * span
    return state.select(*KEY, "n_leaves", "saved_tokens")


def trie(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(turns.sparkSession, "trie")
    way, ends = members(turns, scratch)
    nodes = way.groupBy(*KEY).agg(F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"))
    nodes = scratch.keep(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(parents, ["pa", "pb"])
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    known = below.unionByName(top).join(children, KEY, "left").fillna(0, ["n_children"])
    known = known.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    known = scratch.keep(known, "known")
    depth = known.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(known.select(*KEY, "depth", "pa", "pb", "n_leaves", "saved_tokens"), depth, scratch)
    out = known.drop("n_leaves", "saved_tokens").join(sums, KEY).join(hashed_ends(ends, scratch), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
