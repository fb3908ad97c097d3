"""Sessions of one 4-tuple that all overlap: the greedy walk's pairs, without a list of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streams import SIDE, greedy_by_loops

from linkscope.operators import dual


@pytest.mark.parametrize("noted", [1, 3, 64])
def test_turns_equal_a_loop(monkeypatch, noted):
    monkeypatch.setattr(dual, "NOTED", noted)
    for seed in range(12):
        r = random.Random(seed)
        span = r.choice([200, 3000, 20_000])
        make = lambda base: [("c", 1, "s", 2, base + n, r.randint(0, 10**6), float(s := r.randint(0, span)), float(s + r.choice([0, 5, 300, 3000])), r.choice([0, 0, 5, 6])) for n in range(r.choice([1, 30, 90]))]
        a, d = make(0), make(1000)
        own = lambda rows: tuple(np.array([x[k] for x in rows], dtype=kind) for k, kind in ((6, float), (7, float), (5, np.int64), (8, np.int64)))
        got = sorted(dual.by_turns(own(a), own(d)), key=lambda g: (g[2], a[g[0]][5], d[g[1]][5]))
        assert [(a[i][4], d[j][4]) for i, j, _, _ in got] == greedy_by_loops(a, d)


def test_dense_4_tuples_beside_others(spark, monkeypatch):
    monkeypatch.setattr(dual, "FEW", 3)
    monkeypatch.setattr(dual, "DENSE", 5)
    r = random.Random(2)
    make = lambda base: [(f"10.0.0.{n % 3}", 40000, "10.0.0.9", 5236, base + n, n, float(s := r.randint(0, 400) if n % 3 else 5000 * n), float(s + r.choice([0, 5, 300, 3000])), r.choice([None, 0, 5, 6])) for n in range(60)]
    a, d = make(0), make(100)
    a.append(("10.0.0.1", 40000, "10.0.0.9", 5236, 99, 99, None, None, None))
    got = dual.match_flows(spark.createDataFrame(a, SIDE), spark.createDataFrame(d, SIDE)).collect()
    assert [(g.app_stream, g.db_stream) for g in sorted(got, key=lambda g: g.correlation_id)] == greedy_by_loops(a[:-1], d)


def test_pairs_of_a_dense_4_tuple_are_not_listed(spark, monkeypatch):
    """1,500 sessions a side that are alive at once make 2.25 million pairs; none is written."""
    listed = []
    monkeypatch.setattr(dual, "greedy", lambda pairs, stage, real=dual.greedy: (listed.append(pairs.count()), real(pairs, stage))[1])
    side = lambda shift: spark.range(1500).select(F.lit("c").alias("client_ip"), F.lit(1).alias("client_port"), F.lit("s").alias("server_ip"), F.lit(2).alias("server_port"), "id", F.col("id").alias("session_ord"), (F.col("id") * 0.125 + shift).alias("start_time"), (F.col("id") * 0.5 + 900 + shift).alias("end_time"), F.lit(None).cast("long").alias("syn_seq")).withColumnRenamed("id", "session_id")
    got = dual.match_flows(side(0.0), side(0.25))
    assert got.count() == 1500 == got.select("app_stream").distinct().count() == got.select("db_stream").distinct().count()
    assert listed == [0]
