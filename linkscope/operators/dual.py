"""Two captures of the same connections: matching flows and segments, and the offset of the clocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import packets as P
from ..schemas import KEYS
from ..stages import Stage
from . import scan

FLOW_KEY = ["client_ip", "client_port", "server_ip", "server_port"]
#: Seconds between starts, at most, of sessions that do not overlap.
NEAR = 600
#: Sessions of one 4-tuple that meet those of the other side without a look at the time.
FEW = 64
#: Rounds of mutual best pairs before the rest is walked through in order.
ROUNDS = 6
#: Pairs for each session of a 4-tuple, about, beyond which a task looks for them by turns instead of listing them.
DENSE = 64
#: Best free partners that such a session notes at a time.
NOTED = 64


def relative_syn(packets: DataFrame) -> DataFrame:
    """The sequence number of each session's first SYN."""
    return packets.where(P.flag("SYN") & ~P.flag("ACK")).groupBy(*KEYS).agg(F.min_by("tcp_seq", "pkt_ord").alias("syn_seq"))


def match_flows(app: DataFrame, db: DataFrame, stage: Stage | None = None) -> DataFrame:
    """One row a pair of sessions of the same connection; app and db are sessions with syn_seq.

    Pairs of one 4-tuple are taken greedily by overlap, longest first, each session once. Pairs
    that do not overlap score 1 / (1 + gap), if their starts are at most NEAR seconds apart.
    """
    stage = stage or Stage(app.sparkSession, "flows")
    sized = sized_sessions(app, db, stage)
    if sized.where("many").isEmpty():
        matched = greedy(stage.keep(pairs_of(sized), "pairs"), stage)
    else:
        sized = stage.keep(sized.join(dense_keys(sized).withColumn("dense", F.lit(True)), FLOW_KEY, "left").fillna(False, ["dense"]), "dense", readers=3)
        listed = stage.keep(pairs_of(sized.where("NOT dense")), "pairs")
        matched = greedy(listed, stage).unionByName(crowded(sized.where("dense"), listed.schema))
    confidence = F.when(F.col("overlap") <= 0, "SUSPECTED").when((F.col("app_n") > 1) | (F.col("db_n") > 1), "STRONG").otherwise("CONFIRMED")
    rows = matched.withColumn("confidence", confidence).select(*FLOW_KEY, "worse", "app_ord", "db_ord", "app_stream", "db_stream", "app_start", "app_end", "db_start", "db_end", "confidence")
    out = scan.numbered(rows, [*FLOW_KEY, "worse", "app_ord", "db_ord"], "no", stage)
    return out.withColumn("correlation_id", F.format_string("CF%04d", "no")).drop("worse", "app_ord", "db_ord", "no")


def session_pairs(app: DataFrame, db: DataFrame, stage: Stage) -> DataFrame:
    """Pairs of sessions that may be one: (4-tuple, worse, app_*, db_*, overlap). The smaller (worse, app_ord, db_ord), the better.

    Sessions of a 4-tuple with few of them on a side meet at once; others only where they come near
    in time, by buckets of it.
    """
    return pairs_of(sized_sessions(app, db, stage))


def sized_sessions(app: DataFrame, db: DataFrame, stage: Stage) -> DataFrame:
    """Sessions of both sides with the numbers of either side of their 4-tuple: written first, so that no task sorts for all joins at once."""
    own = lambda s, at_app: s.select(*FLOW_KEY, F.lit(at_app).alias("at_app"), "session_id", "session_ord", "start_time", "end_time", "syn_seq")
    sides = stage.keep(own(app, True).unionByName(own(db, False)), "sides", readers=2)
    sizes = sides.groupBy(*FLOW_KEY).agg(F.count_if("at_app").alias("app_n"), F.count_if(~F.col("at_app")).alias("db_n")).where("app_n > 0 AND db_n > 0")
    return stage.keep(sides.join(sizes.withColumn("many", F.least("app_n", "db_n") > FEW), FLOW_KEY), "sized", readers=4)


def dense_keys(sized: DataFrame) -> DataFrame:
    """4-tuples whose sessions come near in time so often that their pairs grow with the square of the sessions: counted by buckets of time."""
    bucket = lambda c, more: F.floor(F.col(c) / NEAR) + F.when(F.col("at_app"), more).otherwise(0)
    s = sized.where("many").withColumns({"b0": bucket("start_time", -1), "b1": bucket("end_time", 1)})
    s = s.withColumn("bucket", F.explode(F.sequence("b0", F.greatest("b0", "b1"))))
    met = s.groupBy(*FLOW_KEY, "bucket").agg(F.count_if("at_app").alias("a"), F.count_if(~F.col("at_app")).alias("d"), F.max(F.col("app_n") + F.col("db_n")).alias("n"))
    return met.groupBy(*FLOW_KEY).agg(F.sum(F.col("a") * F.col("d")).alias("pairs"), F.max("n").alias("n")).where(F.col("pairs") > DENSE * F.col("n")).select(*FLOW_KEY)


def pairs_of(sized: DataFrame) -> DataFrame:
    """session_pairs() of sized_sessions()."""
    side = lambda at_app, x: sized.where(F.col("at_app") == at_app).select(*FLOW_KEY, "many", *[F.col(c).alias(f"{x}_{n}") for c, n in (("session_id", "stream"), ("session_ord", "ord"), ("start_time", "start"), ("end_time", "end"), ("syn_seq", "syn"), (f"{x}_n", "n"))])
    a, d = side(True, "app"), side(False, "db")
    bucket = lambda c, more=0: F.floor(F.col(c) / NEAR) + more
    a = a.withColumns({"a0": F.when(F.col("many"), bucket("app_start", -1)).otherwise(0), "a1": F.when(F.col("many"), bucket("app_end", 1)).otherwise(0)})
    d = d.withColumns({"d0": F.when(F.col("many"), bucket("db_start")).otherwise(0), "d1": F.when(F.col("many"), bucket("db_end")).otherwise(0)}).drop("many")
    spread = lambda s, x: s.withColumn("bucket", F.explode(F.sequence(f"{x}0", F.greatest(f"{x}0", f"{x}1"))))
    j = spread(a, "a").join(spread(d, "d"), [*FLOW_KEY, "bucket"]).where(F.col("bucket") == F.greatest("a0", "d0"))
    overlap = F.greatest(F.lit(0.0), F.least("app_end", "db_end") - F.greatest("app_start", "db_start"))
    gap = F.abs(F.col("app_start") - F.col("db_start"))
    j = j.where(~F.coalesce((F.col("app_syn") != 0) & (F.col("db_syn") != 0) & (F.col("app_syn") != F.col("db_syn")), F.lit(False)))
    j = j.withColumn("overlap", F.coalesce(overlap, F.lit(0.0))).where((F.col("overlap") > 0) | (gap <= NEAR))
    score = F.when(F.col("overlap") > 0, F.col("overlap")).otherwise(1 / (1 + gap))
    return j.withColumn("worse", -score).drop("bucket", "a0", "a1", "d0", "d1", "many", "app_syn", "db_syn")


def greedy(pairs: DataFrame, stage: Stage) -> DataFrame:
    """What taking pairs in the order (worse, app_ord, db_ord), each session once, gives.

    A pair that is the best of both its sessions is taken by any such walk, whatever comes before:
    all of these go at once, with all pairs of their sessions, and the rest follows in rounds.
    What is left after ROUNDS is walked through in order, 4-tuple by 4-tuple, with the sessions taken so
    far as the only state.
    """
    taken, left = [], pairs
    a, d = [*FLOW_KEY, "app_stream"], [*FLOW_KEY, "db_stream"]
    for _ in range(ROUNDS):
        nth = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("worse", "app_ord", "db_ord"))
        mutual = left.withColumn("a_nth", nth(a)).withColumn("d_nth", nth(d)).where("a_nth = 1 AND d_nth = 1").select(pairs.columns)
        taken.append(stage.keep(mutual, "mutual", readers=3))
        rest = stage.keep(left.join(taken[-1].select(*a), a, "left_anti").join(taken[-1].select(*d), d, "left_anti"), "left")
        stage.release(left)
        left = rest
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = None, set()
        for batch in batches:
            keep = []
            for k, row in enumerate(zip(*[batch.column(c).to_pylist() for c in (*FLOW_KEY, "app_stream", "db_stream")])):
                if row[:4] != key:
                    key, used = row[:4], set()
                x, y = ("a", row[4]), ("d", row[5])
                if x not in used and y not in used:
                    used |= {x, y}
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    rest = left.select(pairs.columns).repartition(*FLOW_KEY).sortWithinPartitions(*FLOW_KEY, "worse", "app_ord", "db_ord").mapInArrow(walk, pairs.schema)
    return reduce(DataFrame.unionByName, [*taken, rest])


class _Free:
    """Sessions at db that no pair has taken yet, by start."""

    def __init__(self, start: np.ndarray, end: np.ndarray, order: np.ndarray, syn: np.ndarray):
        self.all, self.used = (start, end, order, syn), np.zeros(len(start), dtype=bool)
        self._sort(np.argsort(start, kind="stable"))

    def _sort(self, at: np.ndarray) -> None:
        self.at, (self.start, self.end, self.order, self.syn) = at, (x[at] for x in self.all)
        # Some session up to here reaches so far: in overlap, or by the start of one that lies NEAR behind it, with room for rounding.
        self.reach, self.taken = np.maximum.accumulate(np.maximum(self.end, self.start + NEAR + 1)) if len(at) else self.start, 0

    def take(self, k: int) -> None:
        self.used[k], self.taken = True, self.taken + 1
        if 2 * self.taken > len(self.at):
            self._sort(self.at[~self.used[self.at]])

    def best(self, start: float, end: float, syn: int) -> list[tuple]:
        """The best NOTED of them for an application's session: (worse, order, number, overlap), best first."""
        lo, hi = np.searchsorted(self.reach, start, "left"), np.searchsorted(self.start, max(end, start + NEAR + 1), "right")
        s, e = self.start[lo:hi], self.end[lo:hi]
        overlap, gap = np.maximum(0.0, np.minimum(end, e) - np.maximum(start, s)), np.abs(start - s)
        ok = ((overlap > 0) | (gap <= NEAR)) & ~self.used[self.at[lo:hi]]
        if syn:
            ok &= (self.syn[lo:hi] == 0) | (self.syn[lo:hi] == syn)
        some = np.flatnonzero(ok)
        worse = -np.where(overlap[some] > 0, overlap[some], 1 / (1 + gap[some]))
        if len(some) > NOTED:
            near = np.flatnonzero(worse <= np.partition(worse, NOTED - 1)[NOTED - 1])
            some, worse = some[near], worse[near]
        order = self.order[lo:hi][some]
        first = np.lexsort((order, worse))[:NOTED]
        return list(zip(worse[first].tolist(), order[first].tolist(), self.at[lo:hi][some[first]].tolist(), overlap[some[first]].tolist()))


def by_turns(app: tuple[np.ndarray, ...], db: tuple[np.ndarray, ...]) -> list[tuple[int, int, float, float]]:
    """(number at app, number at db, worse, overlap) of what greedy() takes of one 4-tuple, without a list of its pairs.

    app, db: start, end, order, syn (0 where there is none). The best note of each session lies in a heap; one that has been
    taken meanwhile gives way to the next that is free, which is never better, so what comes off the heap free is the best of all.
    """
    free, out, notes, heap = _Free(*db), [], {}, []

    def offer(i: int) -> None:
        for again in (False, True):
            if again:
                notes[i] = iter(free.best(*(app[k][i].item() for k in (0, 1, 3))))
            for worse, order, j, overlap in notes.get(i, ()):
                if not free.used[j]:
                    heapq.heappush(heap, (worse, app[2][i].item(), order, i, j, overlap))
                    return
        notes.pop(i)

    for i in range(len(app[0])):
        offer(i)
    while heap:
        worse, _, _, i, j, overlap = heapq.heappop(heap)
        if free.used[j]:
            offer(i)
        else:
            out.append((i, j, worse, overlap))
            free.take(j)
            notes.pop(i)
    return out


def crowded(sized: DataFrame, schema: T.StructType) -> DataFrame:
    """by_turns() of each 4-tuple: a task holds the sessions of one at a time, never its pairs."""
    names = ["session_id", "session_ord", "start_time", "end_time", "syn_seq"]

    def of_key(key: tuple, rows: pa.Table) -> pa.RecordBatch:
        at_app, sides = rows["at_app"].to_numpy(), []
        for side in (at_app, ~at_app):
            one = rows.filter(pa.array(side & rows["start_time"].is_valid().to_numpy() & rows["end_time"].is_valid().to_numpy()))
            sides.append((one, tuple(one[c].to_numpy() for c in ("start_time", "end_time", "session_ord")) + (one["syn_seq"].fill_null(0).to_numpy(),)))
        (a, own), (d, others) = sides
        got = by_turns(own, others)
        x, y = (pa.array([g[k] for g in got], pa.int64()) for k in (0, 1))
        columns = {**{c: pa.array([v] * len(got)) for c, v in zip(FLOW_KEY, key)}, "worse": pa.array([g[2] for g in got], pa.float64()), "overlap": pa.array([g[3] for g in got], pa.float64())}
        for side, rows_of, at in (("app", a, x), ("db", d, y)):
            columns |= {f"{side}_{n}": rows_of[c].take(at) for n, c in (("stream", "session_id"), ("ord", "session_ord"), ("start", "start_time"), ("end", "end_time"), ("n", f"{side}_n"))}
        target = to_arrow_schema(schema)
        return pa.Table.from_arrays([columns[n].cast(target.field(n).type) for n in target.names], target.names).combine_chunks()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in FLOW_KEY]))
            bounds = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if keys[a] != key:
                    if parts:
                        yield from of_key(key, pa.Table.from_batches(parts).combine_chunks()).to_batches()
                    key, parts = keys[a], []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from of_key(key, pa.Table.from_batches(parts).combine_chunks()).to_batches()

    tasks = 8 * int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sized.select(*FLOW_KEY, "at_app", *names, "app_n", "db_n").withColumns({"start_time": F.col("start_time").cast("double"), "end_time": F.col("end_time").cast("double"), "session_ord": F.col("session_ord").cast("long"), "syn_seq": F.col("syn_seq").cast("long")})
    return rows.repartition(tasks, *FLOW_KEY).sortWithinPartitions(*FLOW_KEY).mapInArrow(run, schema)


def unmatched(sessions: DataFrame, flows: DataFrame, stream: str) -> DataFrame:
    return sessions.join(flows.select(F.col(stream).alias("session_id")), "session_id", "left_anti").select("session_id")


def buckets(directed: DataFrame) -> DataFrame:
    """Segments with data of each session: copies of one direction, sequence number, length and content are one row. Content is unknown where the packet is cut or empty."""
    d = directed.where("tcp_len > 0").withColumn("hash", F.when(~P.truncated() & F.col("payload_known"), F.col("payload_sha256")))
    return d.groupBy("session_id", P.role_direction().alias("direction"), F.col("tcp_seq").alias("seq"), "tcp_len", "hash").agg(
        F.min_by("timestamp", "pkt_ord").alias("ts"), F.min_by("frame_number", "pkt_ord").alias("frame"), F.min_by("tcp_ack", "pkt_ord").alias("ack"), F.min("pkt_ord").alias("ord"), F.count(F.lit(1)).alias("n")
    )


def match_segments(app: DataFrame, db: DataFrame, flows: DataFrame) -> DataFrame:
    """One row for each match, conflict or remainder of two sessions' buckets."""
    f = flows.select("correlation_id", "app_stream", "db_stream")
    place = ["correlation_id", "direction", "seq", "tcp_len"]
    names = ("hash", "ts", "frame", "ack", "ord", "n")
    side = lambda b, x: b.withColumnRenamed("session_id", f"{x}_stream").join(f.select("correlation_id", f"{x}_stream"), f"{x}_stream").select(*[F.col(c).alias(f"{x[0]}_{c}") for c in place], *[F.col(c).alias(f"{x}_{c}") for c in names])
    same = [F.col(f"a_{c}") == F.col(f"d_{c}") for c in place] + [F.col("app_hash").eqNullSafe(F.col("db_hash"))]
    j = side(app, "app").join(side(db, "db"), same, "full_outer").select(*[F.coalesce(f"a_{c}", f"d_{c}").alias(c) for c in place], *[f"{x}_{c}" for x in ("app", "db") for c in names])
    w = Window.partitionBy(*place)
    lone_a, lone_d = F.col("db_ord").isNull(), F.col("app_ord").isNull()
    count = lambda c: F.count_if(c).over(w)
    j = j.withColumns({"ahn": count(lone_a & F.col("app_hash").isNotNull()), "aln": count(lone_a & F.col("app_hash").isNull()), "dhn": count(lone_d & F.col("db_hash").isNotNull()), "dln": count(lone_d & F.col("db_hash").isNull())})
    firsts = F.struct(*[F.col(f"db_{c}").alias(c) for c in ("hash", "ts", "frame", "ack", "n")])
    j = j.withColumn("peer_h", F.min_by(firsts, F.when(lone_d & F.col("db_hash").isNotNull(), F.col("db_ord"))).over(w)).withColumn("peer_l", F.min_by(firsts, F.when(lone_d & F.col("db_hash").isNull(), F.col("db_ord"))).over(w))
    j = j.withColumn("first_a", F.min(F.when(lone_a & F.col("app_hash").isNotNull(), F.col("app_ord"))).over(w)).withColumn("first_d", F.min(F.when(lone_d & F.col("db_hash").isNotNull(), F.col("db_ord"))).over(w))
    aone = F.struct(*[F.col(f"app_{c}").alias(c) for c in ("hash", "ts", "frame", "ack", "n")])
    j = j.withColumn("app_l", F.min_by(aone, F.when(lone_a & F.col("app_hash").isNull(), F.col("app_ord"))).over(w))
    b1 = (F.col("ahn") > 0) & (F.col("dln") > 0) & (F.col("aln") == 0)
    b2 = (F.col("dhn") > 0) & (F.col("aln") > 0) & (F.col("dln") == 0)
    both = ~lone_a & ~lone_d
    a_hash, d_hash = lone_a & F.col("app_hash").isNotNull(), lone_d & F.col("db_hash").isNotNull()
    # Hashed app buckets against one without hash at db (b1), and the mirror image (b2): one row, from the first of them.
    eaten = (b1 & ((a_hash & (F.col("app_ord") != F.col("first_a"))) | (lone_d & F.col("db_hash").isNull()))) | (b2 & ((d_hash & (F.col("db_ord") != F.col("first_d"))) | (lone_a & F.col("app_hash").isNull())))
    cross1, cross2 = b1 & a_hash, b2 & d_hash
    conflict = a_hash & (F.col("dhn") > 0) & ~b2 & ~b1
    many = F.when(cross1, F.col("ahn") > 1).when(cross2, F.col("dhn") > 1)
    status = F.when(both & F.col("app_hash").isNotNull(), "MATCHED_BOTH_SIDES").when(both, "HASH_UNAVAILABLE").when(many, "AMBIGUOUS").when(cross1 | cross2, "HASH_UNAVAILABLE").when(conflict, "AMBIGUOUS").when(lone_a, "ONLY_AT_APP_SIDE").otherwise("ONLY_AT_DB_SIDE")
    level = F.when(both & F.col("app_hash").isNotNull(), "CONFIRMED").when(both, "STRONG").when(many, "SUSPECTED").when(cross1 | cross2, "STRONG").when(conflict, "UNKNOWN").when(F.coalesce("app_hash", "db_hash").isNotNull(), "STRONG").otherwise("SUSPECTED")
    pick = lambda x, c: F.when(cross2, F.col(f"app_l.{c}")).otherwise(F.col(f"app_{c}")) if x == "app" else F.when(cross1, F.col(f"peer_l.{c}")).when(conflict, F.col(f"peer_h.{c}")).otherwise(F.col(f"db_{c}"))
    # Where several buckets could be meant, the frames of all of them.
    frames = lambda x, known: F.collect_set(F.when((lone_a if x == "app" else lone_d) & (F.col(f"{x}_hash").isNotNull() == F.lit(known)), F.col(f"{x}_frame"))).over(w)
    j = j.withColumns({"frames1": F.array_union(frames("app", True), frames("db", False)), "frames2": F.array_union(frames("app", False), frames("db", True))})
    meant = F.when(many, F.array_sort(F.when(cross1, F.col("frames1")).otherwise(F.col("frames2"))))
    delta = F.when(both | ((cross1 | cross2) & ~many), pick("app", "ts") - pick("db", "ts"))
    return j.where(~eaten).join(f, "correlation_id").select(
        *place, (F.col("seq") + F.col("tcp_len")).alias("expected_ack"), F.when(cross2, F.col("db_ack")).otherwise(F.coalesce("app_ack", "db_ack")).alias("ack"),
        pick("app", "frame").alias("app_frame"), pick("app", "ts").alias("app_timestamp"), "app_stream", pick("db", "frame").alias("db_frame"), pick("db", "ts").alias("db_timestamp"), "db_stream",
        pick("app", "hash").alias("payload_hash_app"), pick("db", "hash").alias("payload_hash_db"), F.when(both & F.col("app_hash").isNotNull(), True).when(conflict, False).alias("payload_hash_match"),
        delta.alias("observed_delta"), status.alias("match_status"), level.alias("evidence_level"), meant.alias("candidate_frames"),
        F.coalesce(pick("app", "n"), F.lit(0)).alias("retransmission_count_app"), F.when(conflict, 0).otherwise(F.coalesce(pick("db", "n"), F.lit(0))).alias("retransmission_count_db"),
    )


def clock_alignment(segments: DataFrame, stage: Stage | None = None) -> DataFrame:
    """One row: the median of the deltas of segments matched on both sides, and whether it is an offset of the clocks.

    The median is found by counts of equal deltas in ranges of them, so no task holds all deltas.
    """
    stage = stage or Stage(segments.sparkSession, "clock")
    x = segments.where("match_status = 'MATCHED_BOTH_SIDES' AND observed_delta IS NOT NULL").groupBy("observed_delta").agg(F.count(F.lit(1)).alias("n"))
    x = scan.ranged(x, [], ["observed_delta"], stage, "deltas", readers=3)
    d = x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.min("observed_delta").alias("least"), F.max("observed_delta").alias("most"))
    upto = scan.running(x, [], ["observed_delta"], {"upto": ("sum", F.col("n"))}).join(F.broadcast(d.select("samples")))  # one row
    # The sample in the middle, or the two around it.
    at = lambda place: F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("observed_delta")))
    low, high = F.floor((F.col("samples") - 1) / 2), F.floor(F.col("samples") / 2)
    d = d.join(upto.agg((0.5 * at(low) + 0.5 * at(high)).alias("median")))
    spread = F.col("most") - F.col("least")
    unsure = (spread > 2.0) | ((F.abs("median") > 0.05) & (spread > F.greatest(F.lit(1.0), 10 * F.abs("median"))))
    status = F.when(F.col("samples") < 3, "INSUFFICIENT").when(unsure, "UNRELIABLE").otherwise("OK")
    return d.select("samples", F.col("median").alias("median_delta"), F.col("least").alias("min_delta"), F.col("most").alias("max_delta"), status.alias("status"), F.when(status == "OK", F.col("median")).alias("clock_offset"))


STATUSES = ("MATCHED_BOTH_SIDES", "HASH_UNAVAILABLE", "AMBIGUOUS", "ONLY_AT_APP_SIDE", "ONLY_AT_DB_SIDE")


def status_counts(flows: DataFrame, segments: DataFrame) -> DataFrame:
    counts = segments.groupBy("correlation_id").agg(*[F.count_if(F.col("match_status") == s).alias(s.lower()) for s in STATUSES])
    return flows.join(counts, "correlation_id", "left").fillna(0, [s.lower() for s in STATUSES])
