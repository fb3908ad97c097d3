"""Prefix trie, vector codes and repeated passages against plain loops, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkscope.llm import prefix_trie, substring_dedup, vector_codes


# -- prefix trie -------------------------------------------------------------------------------


def trie_by_loops(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            said = f"{len(role or '')}:{role or ''}{text or ''}"
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(said.encode()).hexdigest()[:32], (role or "", text or "")))
    own = {c: [y[3] for y in sorted(v, key=lambda y: y[:3])] for c, v in own.items()}
    nodes = {}
    for c in own:
        h, first = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        turns = own.get(first, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), (set(), []))
            node[0].add(c)
            if d == len(turns):
                node[1].append(c)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, (members, _) in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), children[k], leaves[k], saved[k], digest(ends)) for k, (m, ends) in nodes.items()), key=str)


def trie_rows(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, a int").repartition(3)
    return sorted((tuple(r) for r in prefix_trie.trie(turns).collect()), key=str)


def test_trie_equals_loops(spark):
    r = random.Random(3)
    ids = [*range(30), *range(100, 130), -5, -205, 205, None]
    rows = [(r.choice(ids), r.choice([None, 0, 1, 2, 3]), r.choice(["u", None, ""]), r.choice(["a", "b", "é😀", None, ""])) for _ in range(300)]
    # A long conversation, whose turns fill several ranges; many that end at one node, over several blocks of ids; repeated rows.
    rows += [(7, k, "u", "x" * (k % 3)) for k in range(200)] + [(c * 3000, 0, "u", "zz") for c in range(1, 12)] + [(9, 1, "u", "same")] * 40
    assert trie_rows(spark, rows) == trie_by_loops(rows)


def test_trie_of_nothing_and_of_no_turns(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "u", "a")]) == []
    # 3 takes its first turns from an absent conversation and has none left: it ends at the root.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 4)
    assert trie_rows(spark, [(c, 1, "u", "a")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_rollup_doubles_its_distance(spark, monkeypatch):
    """A chain of 70 turns takes 7 rounds."""
    rounds = []
    kept = prefix_trie.Scratch.keep
    monkeypatch.setattr(prefix_trie.Scratch, "keep", lambda self, df, name: rounds.append(name) or kept(self, df, name))
    rows = [(0, k, "u", f"t{k}") for k in range(70)]
    assert trie_rows(spark, rows) == trie_by_loops(rows) and rounds.count("rollup") == 7


# -- vector codes ------------------------------------------------------------------------------


def codes_by_loops(rows, dim):
    fine = [(i, v, label) for i, v, label in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, [math.floor(4096 * np.float64(x)) if abs(x) < 1e9 else int(4096 * int(x)) for x in v], label) for i, v, label in sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    width = dim // 8
    books = [[v[p * width : (p + 1) * width] for _, v, _ in fine[:16]] for p in range(8)]

    def nearest(x, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(6):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in fine:
                x = v[p * width : (p + 1) * width]
                own[nearest(x, book)[0]].append(x)
            books[p] = [[sum(c) // len(xs) for c in zip(*xs)] if xs else y for xs, y in zip(own, book)]
    out, by_label = [], {}
    for i, v, label in fine:
        got = [nearest(v[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
        error = min(sum(g for _, g in got), 2**63 - 1)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in got), error, label))
    sha = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    return sorted(((i, code, error, min(by_label[label], 2**63 - 1), sha) for i, code, error, label in out), key=str)


def codes(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], f"vec_id long, embedding {kind}, label int, code string, error string").repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)


def test_codes_equal_loops(spark):
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.gauss(0, 1) + (i % 3))) for _ in range(16)], r.choice([0, 1, None])) for i in range(120)]
    rows += [(i, [0.5] * 16, 5) for i in range(200, 230)] + [(3, rows[3][1], 1), (None, [1.0] * 16, 2)]
    odd = [(300, None, 1), (301, [1.0, None] * 8, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, 1), (304, [1.0] * 24, 1), (305, [], 1), (306, [1.0] * 15, 1)]
    assert codes(spark, rows + odd) == codes_by_loops(rows + odd, 16)


def test_codes_of_few_and_of_no_vectors(spark):
    rows = [(i, [float(i)] * 8, 0) for i in range(3)]
    assert codes(spark, rows) == codes_by_loops(rows, 8)
    assert codes(spark, []) == [] and codes(spark, [(1, None, 0)]) == []


def test_codes_of_huge_components_are_exact(spark):
    rows = [(i, [2.0**60 * (i % 5), -(2.0**90) * (i % 3), float(i), 0.25] * 2, i % 2) for i in range(40)]
    assert codes(spark, rows, "array<double>") == codes_by_loops(rows, 8)


def test_partial_distances_choose_the_first_of_equal_entries():
    r = np.random.default_rng(5)
    book = r.integers(-3, 4, (16, 4))
    book[9] = book[2]
    vectors = r.integers(-3, 4, (500, 4))
    chosen, gap = vector_codes.nearest(vectors, book)
    every = ((vectors[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (chosen == every.argmin(axis=1)).all() and (gap == every.min(axis=1)).all()


# -- repeated passages -------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages_by_loops(rows, window=35):
    texts, counts = [WORD.findall(t or "") for _, t in rows], {}
    for ws in texts:
        for i in range(len(ws) - window + 1):
            counts[tuple(ws[i : i + window])] = counts.get(tuple(ws[i : i + window]), 0) + 1
    out = []
    for (d, _), ws in zip(rows, texts):
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if counts[tuple(ws[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=str)


def passages(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, t1 string, id int").repartition(3)
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=str)


@pytest.fixture
def corpus():
    r = random.Random(5)
    vocabulary = ["a", "b", "é", "😀x", "w", *(f"w{k}" for k in range(40))]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(20, 90))] for _ in range(6)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(r.randint(0, 4)):
            passage = r.choice(shared)
            at = r.randrange(len(passage))
            words += passage[at : at + r.randint(10, 90)] if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if d % 17 == 0:
            words = ["a"] * r.randint(30, 80)
        rows.append((d if d % 9 else None, r.choice([" ", "\n", "  ", "\t \x0b"]).join(words) if d % 23 else None))
    return rows + rows[:5] + [(900, ""), (901, " \n")]


def test_passages_equal_loops(spark, corpus):
    assert passages(spark, corpus) == passages_by_loops(corpus)


def test_passages_of_failed_spans_are_sought_edge_by_edge(spark, corpus, monkeypatch):
    """With no span verified but those of copied texts, the way for failed ones gives the same."""
    rows = substring_dedup.span_rows
    monkeypatch.setattr(substring_dedup, "span_rows", lambda told: rows(told).withColumn("d1", F.xxhash64("id", "place")))
    assert passages(spark, corpus) == passages_by_loops(corpus)


def test_passages_of_empty_tables_and_short_texts(spark):
    assert passages(spark, []) == []
    rows = [(1, "same few words"), (2, "same few words"), (3, None)]
    assert passages(spark, rows) == passages_by_loops(rows)


def test_passages_in_long_texts_and_words(spark):
    r = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(50))
    long = " ".join(str(r.randrange(10**6)) for _ in range(150_000))
    rows = [(1, long + " " + passage), (2, "x" * 1_000_000 + " " + passage + " end"), (3, passage.replace("p25", "q") + " y" * 60)]
    got = {d: (n, gone) for d, n, gone, _ in passages(spark, rows)}
    assert got == {1: (150_050, 50), 2: (52, 50), 3: (110, 60)}


def test_every_window_with_an_equal_one_has_an_equal_seed(corpus):
    """Seeds depend on the words of a window alone, wherever it stands."""
    import pyarrow as pa

    seeds = {}
    for _, text in corpus:
        words = substring_dedup.Words(pa.array([text or ""]))
        at, x = words.seeds()
        for p in np.flatnonzero(words.whole):
            inside = {(int(a - p), int(h)) for a, h in zip(at, x) if p <= a <= p + substring_dedup.SPAN - 1}
            seeds.setdefault(words.bytes_of(int(p), 35), []).append(inside)
    assert all(set.intersection(*found) for found in seeds.values())
