"""Shared steps of two captures: exact results by counts, few sorts in a task, tables that are written once."""

import random
import statistics

import pytest

from linkscope.operators import dual
from linkscope.plans import case_queries
from linkscope.stages import Stage

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50, 301])
def test_median_by_counts(spark, n, monkeypatch):
    """The median over ranges of equal deltas; no aggregate that holds all of them."""
    monkeypatch.setattr("pyspark.sql.functions.median", None)
    r = random.Random(n)
    deltas = [r.choice([-0.0, 0.25, -1.5, r.uniform(-2, 2)]) for _ in range(n)]
    rows = [("MATCHED_BOTH_SIDES", x) for x in deltas] + [("MATCHED_BOTH_SIDES", None), ("AMBIGUOUS", 99.0)]
    got = dual.clock_alignment(spark.createDataFrame(rows, "match_status string, observed_delta double").repartition(3)).collect()
    assert len(got) == 1
    want = (n, statistics.median(deltas), min(deltas), max(deltas)) if n else (0, None, None, None)
    assert (got[0].samples, got[0].median_delta, got[0].min_delta, got[0].max_delta) == want


def test_pairs_of_sessions_sort_little(spark):
    """The stage that pairs sessions has the two sorts of its join; each sort of a task takes memory of its own."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = spark.createDataFrame([("c", 1, "s", 2, k, k, float(k), k + 9.0, None) for k in range(3)], "client_ip string, client_port int, server_ip string, server_port int, session_id long, session_ord long, start_time double, end_time double, syn_seq long")
        made = dual.session_pairs(side, side, Stage(spark, "test"))
        assert made.count() == 9 and plan(made).count("- Sort [") <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_timelines_read_tables_that_are_written_once(spark):
    """Packets come from JSON once; a timeline's branches read what was made of them."""
    d = case_queries.pair(spark, SF)
    assert d.app.side()["packets"] is d.app.directed and d.stage is d.app.stage is not None
    for made in (d.flows, d.segments, d.app.directed, d.db.anomalies, d.app.sessions):
        assert "get_json_object" not in plan(made)
