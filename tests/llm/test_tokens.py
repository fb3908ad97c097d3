"""Counting, packing and binary output against the libraries themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from linkscope.llm import binary_ids, packing, token_counts, token_ids  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(3)
    odd = [None, "", " ", "  a  b ", "<s>a</s><0x0A>\tx　y", "中文字符测试没有空格", "a" * 3000, "\x00x\x1cy", "   " * 300, "It's <|endoftext|> don't, ÀÉ é ﬁ Σας ΣΑΣ.", "▁a ▁b", "word,word. Word! WORD?", "x " * 5000]
    return odd + ["".join(r.choice("ab  ethionrst\né中.,▁😀X1'") for _ in range(r.randint(0, 500))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "no id", "x"), (7, "same id again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def ids_of(text, end):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [end]
    return np.array(ids, dtype="<u4")


def test_counts_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(docs, PIECES).collect()
    want = sorted((repr(d.doc_id), len((d.text or "").encode()), len(model.encode(d.text or ""))) for d in docs.collect())
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_pair_rule_equals_merging():
    machine, r = token_counts.transducer(PIECES), random.Random(5)
    tokens = list(machine.score)
    for _ in range(20000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert machine.beside(a, b) == (machine.merge(a + b) == [a, b])


def test_chunks_compose_whatever_their_length(monkeypatch):
    machine = token_counts.transducer(PIECES)
    own = [t or "" for t in texts()]
    want = machine.count(own).tolist()
    for chunk in (1, 3, 17):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert machine.count(own).tolist() == want


def test_packing_is_gapless_and_exact(docs):
    rows = packing.pack_documents(docs, WORDS).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    want = []
    for d in docs.collect():
        ids = ids_of(d.text, 0)
        want += [(repr(d.doc_id), k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 2048)) for p in [ids[2048 * k : 2048 * (k + 1)]]]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert len(by_sequence) <= sum(r.length for r in rows) / 2048 * 1.1 + 1


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_plan_keeps_every_capacity(by):
    r = random.Random(1)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 78), 60)}
    placed = packing.plan(counts, 100, max_docs=7, max_cost=6000 if by == "norm" else 10000, by=by)
    bins = {}
    for length, rows in placed.groupby("length"):
        rows = rows.sort_values("rank").to_dict("records")
        for row, after in zip(rows, [x["rank"] for x in rows[1:]] + [counts[length]]):
            for n in range(after - row["rank"]):
                bins.setdefault(row["sequence"] + n // row["per_bin"], []).append((row["offset"] + n % row["per_bin"] * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for places in bins.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 100 and len(places) <= 7 and sum(n * n for _, n in places) <= (6000 if by == "norm" else 10000)


def test_varints_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1000):
        ranks = (2 ** r.uniform(0, 32, n)).astype(np.uint32)
        assert (binary_ids.decode(*binary_ids.encode(ranks), n) == ranks).all()


def test_files_round_trip(docs, spark):
    rows = binary_ids.round_trip(docs, WORDS, block_tokens=700).collect()
    want = sorted((repr(d.doc_id), len(i), zlib.crc32(i.tobytes())) for d in docs.collect() for i in [ids_of(d.text, 2)])
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert known[0] is None and known[1:] == sorted(known[1:])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert packing.pack_documents(none, WORDS).count() == 0
    assert binary_ids.round_trip(none, WORDS).count() == 0


def test_word_table_equals_the_library():
    r, letters = random.Random(7), [chr(c) for c in range(256)]
    own = [x for a in letters for b in letters for x in (a + b, f"x{a}{b}y")] + [f"'{a}{b}" for a in letters for b in "stmdrevl'.x"] + texts()
    for some in ("ab'stredvlmABÉéß .,!<|\x1c\x85\xa0²½_-\n", "abé中文σΣς'<|İ́\u3000 .\x1d"):
        own += ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for limit, own in ((300, own[-2000:]), (token_ids.TABLE_CHUNKS, own)):
        table = token_ids.WordTable(WORDS, limit)
        got = [x for k in range(0, len(own), 700) for x in table.encode(pa.array(own[k : k + 700], pa.string()))]
        want = [np.array(x.ids, dtype="<u4").tobytes() for x in table.tokenizer.encode_batch_fast([t or "" for t in own], add_special_tokens=False)]
        assert got == want and len(table.known) <= limit


def test_new_words_cost_the_model_alone():
    """Words that were not seen before took the whole tokenizer, one text each, and those beside marks a place for each neighbour."""
    table, given = token_ids.WordTable(WORDS), []

    class Library:
        def encode_batch_fast(self, chunks, **options):
            given.extend(chunks)
            return whole.encode_batch_fast(chunks, **options)

    whole, table.tokenizer = table.tokenizer, Library()
    r = random.Random(11)
    words = ["".join(r.choice("abdehiorst\u00e9") for _ in range(12)) for _ in range(2000)]
    table.encode(pa.array([f"{a} {b.upper()},{a}; ({b})--{a}'s" for a, b in zip(words, words[1:])]))
    assert set(table.known) - {"", ",", ";", "(", ")--", "'s"} == set(words)
    assert set(given) <= {"", ",", ";", "(", ")--", "'s"}


def test_slices_are_bounded_in_bytes():
    own = [None, "", "a" * 10, "é" * 7, None, "b" * 3, "c" * 50, "", "d"] * 30
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(own))), "text": pa.array(own, pa.string())})
    parts = list(token_ids.slices(batch, most=20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(own)))
    assert all(sum(len((x or "").encode()) for x in p.column(1).to_pylist()[1:]) <= 20 for p in parts)
    assert list(token_ids.slices(batch.slice(0, 0))) == []
