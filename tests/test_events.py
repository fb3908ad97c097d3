"""The logged events of the correlation queries, and their join to flows."""

import random

from linkscope.operators import correlate
from linkscope.plans import case_queries, views


def test_every_error_is_an_event(spark, tmp_path):
    kinds = ["error", "view", "error", "click"]
    rows = [(i, i % 3, kinds[i % 4], "2024-01-01 00:00:00", f'{{"k": {i}}}') for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = case_queries.event_table(spark, str(tmp_path))
    assert sorted(x.event_ord for x in got.collect()) == [r[0] for r in rows if r[2] == "error"]
    assert "%" not in case_queries.event_rows(views.DUCK).split("WHERE")[-1]


FLOWS = "correlation_id string, client_ip string, client_port int, server_ip string, server_port int, app_stream long, db_stream long, app_start double, app_end double"


def test_events_meet_flows_as_in_a_plain_loop(spark):
    r = random.Random(5)
    flows, events = [], []
    for i in range(120):
        start = r.choice([r.uniform(-500, 5000), float(r.randint(0, 50) * 5)])
        end = start + r.choice([0.0, r.uniform(0, 20), r.uniform(0, 3000), 1e6, -30.0])
        flows.append((f"C{i}", "c", i, r.choice(["h1", "h2", None]), r.choice([1, 2, None]), i, i, None if i % 17 == 0 else start, None if i % 19 == 0 else end))
    for i in range(80):
        events.append((f"E{i}", None if i % 9 == 0 else r.choice([r.uniform(-600, 6000), float(r.randint(0, 60) * 5)]), r.choice(["h1", "h2", "h3", None]), r.choice([1, 2, None])))
    at = {e[0]: [f for f in flows if (e[2] is None or e[2] == f[3]) and (e[3] is None or e[3] == f[4])] for e in events}
    live = {e[0]: {f[0] for f in at[e[0]] if e[1] is None or (f[7] is not None and f[8] is not None and f[7] - 5 <= e[1] <= f[8] + 5)} for e in events}
    f = spark.createDataFrame(flows, FLOWS)
    e = spark.createDataFrame(events, "event_id string, timestamp double, database_host string, database_port int")
    packets = spark.createDataFrame([(1, 1, 49.0, 1)], "session_id long, pkt_ord long, timestamp double, frame_number long")
    got = correlate.candidates(e, f, packets, spark.createDataFrame([(2, "ZERO_WINDOW")], "session_id long, type string")).collect()
    assert all(x.correlation_id in live[x.event_id] for x in got)
    assert sorted((x.event_id, x["rank"]) for x in got) == sorted((k, n + 1) for k, v in live.items() for n in range(min(len(v), correlate.KEEP)))
    counts = {x.event_id: (x.flows_considered, x.filtered_endpoint, x.filtered_time, x.eligible_count) for x in correlate.accounting(e, f).collect()}
    assert counts == {k: (120, 120 - len(at[k]), len(at[k]) - len(live[k]), len(live[k])) for k in live}


def test_short_flows_are_not_paired_with_all_events(spark):
    n = 2000
    f = spark.range(n).selectExpr("concat('C', id) AS correlation_id", "'h' AS server_ip", "1 AS server_port", "id * 100.0D AS app_start", "id * 100.0D + 10 AS app_end")
    for host in ("'h'", "NULL"):
        e = spark.range(n).selectExpr("concat('E', id) AS event_id", "id * 100.0D AS t0", f"cast({host} AS string) AS host", "cast(NULL AS int) AS port")
        pairs = correlate.eligible_pairs(e, f, 5.0)
        assert pairs.count() == n
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "_bucket" in plan.split("Join", 1)[1].splitlines()[0]
