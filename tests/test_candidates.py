"""Candidates, counts and running values against plain loops, with the scale of one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from linkscope.operators import correlate, detectors, scan
from linkscope.stages import Stage

FLOWS = "correlation_id string, client_ip string, client_port int, server_ip string, server_port int, app_stream long, db_stream long, app_start double, app_end double"
EVENTS = "event_id string, timestamp double, database_host string, database_port int"
PACKETS = "session_id long, pkt_ord long, timestamp double, frame_number long"


def by_loops(events, flows, packets, found, window=10.0, grace=5.0):
    own, kinds = {}, {}
    for s, o, t, fr in packets:
        own.setdefault(s, []).append((t, o, fr))
    for s, kind in found:
        kinds.setdefault(s, set()).add(kind)
    out, counts = {}, {}
    for ev, t0, host, port in events:
        rows, n_end, n_time = [], 0, 0
        for cid, _, _, ip, fport, a, d, lo, hi in flows:
            if (host and ip != host) or (port is not None and fport != port):
                n_end += 1
                continue
            if t0 is not None and (lo is None or hi is None or not lo - grace <= t0 <= hi + grace):
                n_time += 1
                continue
            fixed = 30.0 * bool(host) + 30.0 * (port is not None) + (40.0 if t0 is not None else 0.0)
            gap, n, frame = None, 0, None
            if t0 is not None and a in own:
                gap, _, frame = min((abs(t - t0), o, fr) for t, o, fr in own[a])
                n = sum(abs(t - t0) <= window for t, _, _ in own[a])
            if n:
                fixed = fixed + (max(0.0, 15.0 * (1.0 - min(gap, window) / window)) + min(5.0, 0.1 * n))
            health = min(5.0, 1 + 0.25 * len(kinds[a])) if a in kinds else 0.0
            rows.append((-fixed, gap is None, gap or 0.0, -health, a, d, cid, n, gap, frame))
        rows.sort()
        counts[ev] = (len(flows), n_end, n_time, len(rows))
        out[ev] = [(r[6], r[7], r[8], r[9], -r[0], -r[3]) for r in rows[:10]]
    return out, counts


def frames(spark, events, flows, packets, found):
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame(flows, FLOWS), spark.createDataFrame(packets, PACKETS), spark.createDataFrame(found, "session_id long, type string")


def case(seed, n_flows=40, n_events=60, span=2000):
    r = random.Random(seed)
    flows, packets, found = [], [], []
    for a in range(n_flows):
        lo = float(r.randint(0, span))
        hi = lo + r.choice([0, 3, 50, 400, span])
        flows.append((f"CF{a:04d}", "c", a, r.choice(["s1", "s1", "s2"]), r.choice([1, 1, 2]), a, 1000 + a, lo if a % 13 else None, hi))
        times = [lo, hi, *(r.uniform(lo, hi) for _ in range(r.choice([0, 2, 30])))]
        packets += [] if a % 11 == 5 else [(a, 0, t if r.random() < 0.9 else float(round(t)), 0) for t in times]
        found += [(a, kind) for kind in "ABCDEFGHIJKLMNOPQRSTU"[: r.choice([0, 0, 1, 3, 21])]]
    packets = [(s, k, t, 7 * k) for k, (s, _, t, _) in enumerate(packets)]
    events = [(f"E{k}", r.choice([None, float(r.randint(0, 2 * span)), r.uniform(0, 2 * span)]), r.choice([None, "s1", "s2", "s3"]), r.choice([None, 1, 2])) for k in range(n_events)]
    return events, flows, packets, found


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_equal_loops(spark, seed, monkeypatch):
    """Also where salts, shards and blocks of flows are small, and where the first sweep leaves events short."""
    monkeypatch.setattr(correlate, "EVENTS", 5)
    monkeypatch.setattr(correlate, "PACKETS", 60)
    monkeypatch.setattr(correlate, "FLOWS", 3)
    data = case(seed)
    e, f, p, a = frames(spark, *data)
    counts = correlate.accounting(e, f)
    got = {}
    rows = correlate.candidates(e, f, p, a, counts=counts).orderBy("event_id", "rank").collect()
    for x in rows:
        got.setdefault(x.event_id, []).append((x.correlation_id, x.packets_near, x.distance, x.nearest and x.nearest.frame_number, x.identity_score, x.health_score))
    want, tallies = by_loops(*data)
    assert {k: v for k, v in want.items() if v} == got
    assert {x.event_id: tuple(x)[1:] for x in counts.collect()} == tallies
    assert all(x.rank <= correlate.KEEP for x in rows)


def test_no_row_for_each_event_and_flow(spark):
    """300 events within 300 flows that are alive all along: what the sweep makes is what it keeps."""
    flows = [(f"CF{a}", "c", a, "s", 1, a, a, 0.0, 1000.0) for a in range(300)]
    packets = [(a, 10 * a + k, float(t), a) for a in range(300) for k, t in enumerate((0, 300 + a, 1000))]
    events = [(f"E{k}", 400.0 + k / 10, "s", 1) for k in range(300)]
    e, f, p, a = frames(spark, events, flows, packets, [])
    narrow = f.select("app_stream", "db_stream", "server_ip", "server_port", "app_start", "app_end").withColumn("health", F.lit(0.0))
    swept = correlate.sweep(correlate.named(e, None, None), narrow, p.withColumnRenamed("session_id", "app_stream"), 10.0, 5.0, 10.0)
    assert swept.groupBy("event_id").count().agg(F.max("count")).first()[0] == correlate.KEEP
    c = correlate.candidates(e, f, p, a)
    assert c.count() == 3000 and correlate.accounting(e, f).agg(F.sum("eligible_count")).first()[0] == 90_000


def test_candidates_of_nothing(spark):
    events, flows, packets, found = case(3, 5, 5)
    for data in (([], flows, packets, found), (events, [], [], []), ([], [], [], [])):
        e, f, p, a = frames(spark, *data)
        assert correlate.candidates(e, f, p, a).count() == 0
        assert {x.eligible_count for x in correlate.accounting(e, f).collect()} <= {0}


@pytest.mark.parametrize("hot", [True, False])
def test_running_values_equal_loops(spark, hot):
    """One key over all ranges, or several keys and a null one."""
    r = random.Random(7)
    rows = [(0 if hot else r.choice([0, 1, 2, None]), k, r.choice([None, float(r.randint(0, 9))]), r.randint(-3, 3)) for k in range(500)]
    stage = Stage(spark, "test")
    df = scan.ranged(spark.createDataFrame(rows, "k int, o int, x double, d int").repartition(3), ["k"], ["o"], stage)
    got = scan.running(df, ["k"], ["o"], {"last": ("last", F.col("x")), "sum": ("sum", F.col("d")), "n": ("count", F.col("x")), "top": ("max", F.col("x"))}).collect()
    assert df.select(scan.PART).distinct().count() > 1 and len(got) == 500
    for x in got:
        own = [y for y in rows if y[0] == x.k and y[1] <= x.o]
        known = [y[2] for y in own if y[2] is not None]
        assert (x["last"], x["sum"], x.n, x.top) == (known[-1] if known else None, sum(y[3] for y in own), len(known), max(known) if known else None)
    stage.close()


def test_stalls_see_the_greatest_acknowledgement_so_far(spark):
    """Random segments of a session against loops, with contents that are not known."""
    r = random.Random(8)
    kind = "capture_id string, session_id long, direction string, seq long, tcp_len int, payload_sha256 string, count long, first_ts double, last_ts double, frames array<long>, expected_ack long, first_ord long, duration_ms double, plane string, severity string, anomaly_type string, filter string"
    retx = [("c", k % 3, r.choice(["client_to_server", "server_to_client"]), 10 * k, 10, None, 3, 0.0, float(r.randint(5, 50)), [k], r.randint(0, 600), k, 4000.0, "data", "HIGH", "X", "f") for k in range(40)]
    acks = [("c", r.randint(0, 3), r.choice(["client_to_server", "server_to_client"]), float(r.randint(0, 60)), r.choice([16, 16, 2]), r.randint(0, 600)) for _ in range(80)]
    directed = spark.createDataFrame(acks, "capture_id string, session_id long, direction string, timestamp double, tcp_flags int, tcp_ack long")
    got = {x.seq: x.observed_ack for x in detectors.ack_stalls(directed, spark.createDataFrame(retx, kind)).collect()}
    want = {}
    for x in retx:
        seen = max([a[5] for a in acks if a[1] == x[1] and a[2] != x[2] and a[4] == 16 and a[3] <= x[8]], default=0)
        if seen < x[10]:
            want[x[3]] = seen
    assert got == want
