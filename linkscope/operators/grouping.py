"""Groups of like events close in time."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stage
from . import scan

#: Columns whose equality makes two events alike.
SIGNATURE = ["source_file", "event_type", "thread_name", "message", "caused_by_message", "connection_hint"]
#: Events after which groups that no later event can join are forgotten.
FORGET = 4096


def assign_groups(events: DataFrame, window_seconds: float = 3.0, signature: list[str] | None = None, stage: Stage | None = None) -> DataFrame:
    """events with group_id, occurrence_count and is_group_primary.

    In event order, an event joins the newest group of its signature of which the first and the
    last member are at most window_seconds away; else it starts one. session_window has no such
    bound on a group's span. Events whose times are more than the window from all others of the
    signature cut it into runs that cannot share a group. A run's events pass through its task in
    order, which keeps the groups that a later event may still join, and no members.
    """
    stage = stage or Stage(events.sparkSession, "groups")
    like = F.sha2(F.to_json(F.struct(*(signature or SIGNATURE))), 256)
    keyed = events.select("source_file", "event_ord", F.col("timestamp").cast("double").alias("timestamp"), like.alias("sig"))
    timed = scan.ranged(keyed.where("timestamp IS NOT NULL"), ["sig"], ["timestamp", "event_ord"], stage, "events", readers=4)
    order = ["timestamp", "event_ord"]
    runs = scan.running(timed, ["sig"], order, {"last": ("lag", F.col("timestamp"))})
    far = F.when(F.coalesce(F.col("timestamp") - F.col("last") > window_seconds, F.lit(True)), 1).otherwise(0).cast("long")
    runs = scan.running(runs.withColumn("far", far).drop("last"), ["sig"], order, {"run": ("sum", F.col("far"))})
    # From the last event on, so that the smallest later time is a running value.
    later = F.min("timestamp").over(Window.partitionBy("sig", "run").orderBy(F.desc("event_ord")).rowsBetween(Window.unboundedPreceding, -1))
    passing = runs.withColumn("later", later).select("sig", "run", "event_ord", "timestamp", "later", "source_file").repartition("sig", "run").sortWithinPartitions("sig", "run", "event_ord")
    grouped = passing.mapInArrow(fold(window_seconds), "source_file string, event_ord long, head long")
    lone = keyed.where("timestamp IS NULL").select("source_file", "event_ord", F.col("event_ord").alias("head"))
    heads = stage.keep(grouped.unionByName(lone.select("source_file", F.col("event_ord").cast("long").alias("event_ord"), F.col("head").cast("long").alias("head"))), "heads", readers=2)
    sizes = heads.groupBy("source_file", "head").agg(F.count(F.lit(1)).alias("occurrence_count"))
    first = scan.ranged(sizes, ["source_file"], ["head"], stage, "sizes", readers=2)
    ids = scan.running(first, ["source_file"], ["head"], {"no": ("sum", F.lit(1).cast("long"))})
    ids = ids.select("source_file", "head", "occurrence_count", F.format_string("JG%04d", "no").alias("group_id"))
    out = events.join(heads.join(ids, ["source_file", "head"]), ["source_file", "event_ord"])
    return out.withColumn("is_group_primary", F.col("head") == F.col("event_ord")).drop("head")


def fold(window: float):
    """Events (sig, run, event_ord, timestamp, later, source_file) in order, to the first event of each one's group."""
    width = 2 * window or 1.0  # a group whose first is within the window is in this bucket or a neighbour

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, made, since = None, {}, 0, 0
        for batch in batches:
            heads = []
            for sig, no, order, t, later in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if (sig, no) != key:
                    key, groups, made, since = (sig, no), {}, 0, 0
                place, best = math.floor(t / width), None
                for b in (place - 1, place, place + 1):
                    for g in groups.get(b, ()):
                        if abs(t - g[2]) <= window and abs(t - g[3]) <= window and (best is None or g[0] > best[0]):
                            best = g
                if best is None:
                    made += 1
                    best = [made, order, t, t]
                    groups.setdefault(place, []).append(best)
                best[3] = t
                heads.append(best[1])
                since += 1
                if since == FORGET and later is not None:
                    open_ = {b: [g for g in gs if min(g[2], g[3]) + window >= later] for b, gs in groups.items()}
                    groups, since = {b: gs for b, gs in open_.items() if gs}, 0
            yield pa.RecordBatch.from_arrays([batch.column(5), batch.column(2).cast(pa.int64()), pa.array(heads, pa.int64())], ["source_file", "event_ord", "head"])

    return run
