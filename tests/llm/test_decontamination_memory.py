"""Hits of long texts and of repeated items hold little memory, and pieces of texts change no count."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pytest

from linkscope.llm import decontaminate

LOW_HEAP = """
from pyspark.sql import SparkSession, functions as F
from linkscope.llm import decontaminate
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "450m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
passage = " ".join(f"item{k}" for k in range(40))
text = " ".join(f"own{k}" for k in range(500))
bench = spark.range(60).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
docs = spark.range(2).select(F.col("id").alias("doc_id"), F.repeat(F.lit(text + " " + passage + " "), 40).alias("text"))
"""
FOUND = """
rows = decontaminate.find_overlaps(docs, bench).collect()
assert len(rows) == 120 and all(x.agreeing == 40 and x.first_word == 500 and x.n_hits == 40 * (31 + 34) for x in rows), rows[:3]
"""
LEFT = """
assert [x.doc_id for x in decontaminate.remove_contaminated(docs.union(spark.sql("SELECT 7L, 'of no item'")), bench).collect()] == [7]
"""


@pytest.mark.parametrize("asked", [FOUND, LEFT])
def test_a_small_heap_holds_the_hits_of_long_texts_and_repeated_items(asked):
    run = subprocess.run([sys.executable, "-c", LOW_HEAP + asked], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=280)
    assert run.returncode == 0, run.stderr[-2000:]


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_passages_at_the_ends_of_pieces(spark, seeds):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    item, n = [word() for _ in range(30)], decontaminate.PIECE
    places = [0, 1, n - 31, n - 30, n - 29, n - 15, n - 1, n, n + 1, 2 * n - 10, 2 * n + 5]
    docs = [(at, " ".join([*[word() for _ in range(at)], *item, *[word() for _ in range(3 * n - at)]])) for at in places]
    docs += [(-5, " ".join(item[5:])), (-6, " ".join([*[word() for _ in range(n - 20)], *item[:20]]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (2, " ".join(item[:28]) + " x y")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.first_word, x.agreeing, x.n_hits) for x in decontaminate.find_overlaps(table, bench, broadcast_seeds=seeds).collect()}
    each = lambda words: sum(words - len(m) + 1 for m in decontaminate.MASKS)
    ones = {1: (0, each(30)), 2: (0, each(30) + each(28))}
    want = {(at, k): (at, 30, hits) for at in places for k, (_, hits) in ones.items()}
    want |= {(-5, 1): (-5, 25, each(25)), (-5, 2): (-5, 25, each(25) + each(23)), (-6, 1): (n - 20, 20, each(20)), (-6, 2): (n - 20, 20, 2 * each(20))}
    assert got == want
