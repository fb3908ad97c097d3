"""Ping windows, flows of one reused 4-tuple and groups of one signature, against plain loops and at scale."""

import random

import pytest
from pyspark.sql import functions as F

from linkscope.operators import dual, grouping, ping

SAMPLES = "net string, timestamp double, target_host string, status string, rtt_ms double, source_line int"


def ping_case(seed, nets):
    r = random.Random(seed)
    samples = [(r.choice(nets), r.choice([None, round(r.uniform(0, 400), 2), float(r.randint(0, 400))]), r.choice([None, "h1", "h2"]), r.choice(["REPLY", "REPLY", "TIMEOUT", "TIMEOUT", "UNREACHABLE", "ERROR"]), None, k) for k in range(250)]
    samples = [(n, t, h, s, r.choice([None, round(r.random(), 3)]) if s == "REPLY" else None, k) for n, t, h, s, _, k in samples]
    events = [(r.choice(nets), f"E{k}", r.choice([None, float(r.randint(-50, 450)), round(r.uniform(0, 400), 2)])) for k in range(60)]
    return events, samples


def expected(event, samples, window):
    """What the window of one event holds, and its markers."""
    net, _, t0 = event
    own = sorted(([s for s in samples if s[0] == net and s[1] is not None]), key=lambda s: (s[1], s[5]))
    near = [] if t0 is None else [s for s in own if t0 - window <= s[1] <= t0 + window]
    of = lambda status, rows: [s for s in rows if s[3] == status]
    rtts = [s[4] for s in of("REPLY", near) if s[4] is not None]
    side = lambda status, test, pick: pick([s[1] for s in of(status, own) if t0 is not None and test(s[1])], default=None)
    stats = (len(near), *[len(of(x, near)) for x in ("REPLY", "TIMEOUT", "UNREACHABLE", "ERROR")], min(rtts, default=None), round(sum(rtts) / len(rtts), 9) if rtts else None, max(rtts, default=None),
             side("REPLY", lambda t: t <= t0, max), side("REPLY", lambda t: t >= t0, min), side("TIMEOUT", lambda t: t <= t0, max), side("TIMEOUT", lambda t: t >= t0, min))
    marks, last, answered = [], None, True
    for k, s in enumerate(near):
        if s[3] == "TIMEOUT":
            if k == 0 or near[k - 1][3] != "TIMEOUT":
                n = next((m for m in range(k, len(near)) if near[m][3] != "TIMEOUT"), len(near))
                marks.append((s[1], "PING_TIMEOUT", f"{n - k} consecutive ICMP timeout(s) starting", near[n][2] if n < len(near) else near[0][2]))
            last, answered = s[1], False
        elif s[3] == "REPLY" and not answered:
            answered = True
            if s[1] - last <= 5:
                marks.append((s[1], "PING_RECOVERY", "ICMP replies resumed after timeout(s)", s[2]))
    replies = of("REPLY", near)
    if replies and not of("TIMEOUT", near):
        marks.append((replies[0][1], "PING_REPLY_STABLE", f"{len(replies)} ICMP replies in window (no timeouts)", replies[0][2]))
    return stats, sorted(marks, key=str)


@pytest.mark.parametrize("by,nets", [([], ["n"]), (["net"], ["a", "b", "c"])])
def test_ping_equals_loops(spark, by, nets):
    events, samples = ping_case(len(nets), nets)
    e, s = spark.createDataFrame(events, "net string, event_id string, timestamp double"), spark.createDataFrame(samples, SAMPLES).repartition(3)
    want = {x[1]: expected(x, samples, 30.0) for x in events}
    names = ("samples", "replies", "timeouts", "unreachable", "errors", "min_rtt_ms", "avg_rtt_ms", "max_rtt_ms", "last_reply_before", "first_reply_after", "nearest_timeout_before", "nearest_timeout_after")
    got = {x.event_id: tuple(round(x[n], 9) if n == "avg_rtt_ms" and x[n] is not None else x[n] for n in names) for x in ping.statistics(e, s, by=by).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    marks = {k: [] for k in want}
    for x in ping.markers(e, s, by=by).collect():
        marks[x.event_id].append((x.timestamp, x.event_type, x.description, x.target_host))
    assert {k: sorted(v, key=str) for k, v in marks.items()} == {k: v[1] for k, v in want.items()}


def test_ping_without_samples_or_events(spark):
    e, s = spark.createDataFrame([("E1", 5.0)], "event_id string, timestamp double"), spark.createDataFrame([], SAMPLES)
    assert ping.statistics(e, s).first().samples == 0 and ping.markers(e, s).count() == 0
    assert ping.statistics(e.limit(0), s).count() == 0


def test_one_long_outage_is_one_row_a_window(spark):
    """20,000 timeouts in a row: windows meet the run, not its samples."""
    s = spark.range(20_000).select(F.lit("n").alias("net"), F.col("id").cast("double").alias("timestamp"), F.lit("h").alias("target_host"), F.lit("TIMEOUT").alias("status"), F.lit(None).cast("double").alias("rtt_ms"), F.col("id").cast("int").alias("source_line"))
    e = spark.range(200).select(F.concat(F.lit("E"), "id").alias("event_id"), (F.col("id") * 90 + 100.0).alias("timestamp"))
    assert [tuple(x) for x in ping.markers(e, s).groupBy("description").count().collect()] == [("61 consecutive ICMP timeout(s) starting", 200)]


# -- flows ---------------------------------------------------------------------------------------

SIDE = "client_ip string, client_port int, server_ip string, server_port int, session_id long, session_ord long, start_time double, end_time double, syn_seq long"


def greedy_by_loops(a, d):
    pairs = []
    for x in a:
        for y in d:
            if x[:4] != y[:4] or (x[8] and y[8] and x[8] != y[8]):
                continue
            overlap, gap = max(0.0, min(x[7], y[7]) - max(x[6], y[6])), abs(x[6] - y[6])
            if overlap > 0 or gap <= 600:
                pairs.append((*x[:4], -(overlap if overlap > 0 else 1 / (1 + gap)), x[5], y[5], x[4], y[4]))
    used, out = set(), []
    for *_, x, y in sorted(pairs):
        if not {("a", x), ("d", y)} & used:
            used |= {("a", x), ("d", y)}
            out.append((x, y))
    return out


@pytest.mark.parametrize("rounds,few", [(0, 64), (2, 3), (6, 0)])
def test_greedy_flows_by_rounds_and_by_walks(spark, monkeypatch, rounds, few):
    monkeypatch.setattr(dual, "ROUNDS", rounds)
    monkeypatch.setattr(dual, "FEW", few)
    r = random.Random(rounds)
    make = lambda base: [(f"10.0.0.{r.randint(1, 2)}", 40000, "10.0.0.9", 5236, base + n, n, float(s := r.randint(0, 4000)), float(s + r.choice([0, 5, 300, 3000])), r.choice([None, 0, 5, 6])) for n in range(40)]
    a, d = make(0), make(100)
    got = dual.match_flows(spark.createDataFrame(a, SIDE), spark.createDataFrame(d, SIDE)).collect()
    assert [(g.app_stream, g.db_stream) for g in sorted(got, key=lambda g: g.correlation_id)] == greedy_by_loops(a, d)


def test_one_tuple_of_thousands_of_sessions(spark):
    """5,000 sessions a side of one 4-tuple, one after the other: each finds its own."""
    side = lambda shift: spark.range(5000).select(F.lit("c").alias("client_ip"), F.lit(1).alias("client_port"), F.lit("s").alias("server_ip"), F.lit(2).alias("server_port"), "id", F.col("id").alias("session_ord"), (F.col("id") * 60 + shift).cast("double").alias("start_time"), (F.col("id") * 60 + 20 + shift).cast("double").alias("end_time"), F.lit(None).cast("long").alias("syn_seq")).withColumnRenamed("id", "session_id")
    got = dual.match_flows(side(0), side(3))
    assert got.where("app_stream = db_stream AND confidence = 'STRONG'").count() == 5000 == got.select("correlation_id").distinct().count()


# -- groups --------------------------------------------------------------------------------------


def groups_by_loops(rows, window=3):
    groups, want = [], {}
    for _, n, t, kind in rows:
        fit = [g for g in groups if g[1] == kind and t is not None and g[2] is not None and abs(t - g[2]) <= window and abs(t - g[3]) <= window]
        if fit:
            fit[-1][3] = t
            want[n] = fit[-1][0]
        else:
            groups.append([f"JG{len(groups) + 1:04d}", kind, t, t])
            want[n] = groups[-1][0]
    return want


@pytest.mark.parametrize("forget", [1, 4096])
def test_groups_forget_only_what_is_closed(spark, monkeypatch, forget):
    monkeypatch.setattr(grouping, "FORGET", forget)
    r = random.Random(forget)
    # Half in order of time, half not.
    rows = [("f", n + 1, None if r.random() < 0.1 else n / 4 + (r.choice([0, 0, 5, 9]) if n % 2 else 0), r.choice("AB")) for n in range(300)]
    df = spark.createDataFrame(rows, "source_file string, event_ord long, timestamp double, event_type string").withColumns({c: F.lit("x") for c in ("thread_name", "message", "caused_by_message", "connection_hint")})
    got = grouping.assign_groups(df).collect()
    want = groups_by_loops(rows)
    assert {x.event_ord: x.group_id for x in got} == want
    sizes = list(want.values())
    assert all(x.occurrence_count == sizes.count(x.group_id) for x in got)


def test_one_signature_of_many_events(spark):
    """300,000 events in one run: groups of 3 seconds, in one pass."""
    df = spark.range(300_000).select(F.lit("f").alias("source_file"), F.col("id").alias("event_ord"), (F.col("id") / 10).alias("timestamp"), *[F.lit("x").alias(c) for c in grouping.SIGNATURE[1:]])
    got = grouping.assign_groups(df).agg(F.countDistinct("group_id").alias("n"), F.max("occurrence_count").alias("most")).first()
    assert (got.n, got.most) == (300_000 // 31 + 1, 31)


# -- chunks of packets ---------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_sessions_over_many_chunks(spark, monkeypatch, chunk):
    """Resets, zero windows and handshakes of sessions that chunks cut anywhere, against loops."""
    from test_core import capture, packet

    from linkscope.operators import detectors

    monkeypatch.setattr(detectors, "CHUNK", chunk)
    r = random.Random(11)
    rows = [packet(n, n, r.choice([2, 18, 16, 16, 24, 17, 4]), r.random() < 0.5, 1, 1, r.choice([0, 0, 5]), r.choice([0, 0, 100]), r.randint(0, 2)) for n in range(150)]
    c = capture(spark, rows)
    resets, runs, shakes = [], [], {}
    for s in range(3):
        own = [x for x in rows if x[13] == s]
        syn = fin = data = False
        last_ack = False
        run = []
        for x in [*own, None]:
            zero = x is not None and x[10] == 0 and not x[7] & 5
            if run and not zero:
                runs.append((s, [y[12] for y in run], run[0][2], x and x[2]))
                run = []
            if x is None:
                break
            if zero:
                run.append(x)
            syn, fin, data = syn or bool(x[7] & 2), fin or bool(x[7] & 1), data or (x[11] > 0 and not x[7] & 2)
            if x[7] & 4:
                resets.append((s, x[1], "RST_AFTER_FIN" if fin else "ACK_TO_RST" if last_ack and data else "RST_DURING_DATA" if data else "RST_AFTER_SYN" if syn else "RST_OTHER"))
            last_ack = bool(x[7] & 16) and not x[7] & 7 and x[11] == 0
        first = lambda test, after: next((x for x in own if test(x[7]) and x[1] > after), None) if after is not None else None
        one = first(lambda f: f & 18 == 2, -1)
        two = first(lambda f: f & 18 == 18, one and one[1])
        three = first(lambda f: f & 16 and not f & 6, two and two[1])
        shakes[s] = tuple(x and x[2] for x in (one, two, three))
    assert sorted((x.session_id, x.pkt_ord, x.classification) for x in c.resets.collect()) == sorted(resets)
    assert sorted((x.session_id, x.frames, x.start_ts, x.end_ts) for x in c.zero_windows.collect()) == sorted(runs)
    assert {x.session_id: (x.syn_ts, x.synack_ts, x.ack_ts) for x in c.handshakes.collect()} == shakes
