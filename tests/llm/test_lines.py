"""Short lines in the line dedup, and in the pipeline's stage."""

import corpus_pipeline
from linkscope.llm import line_dedup


def test_equal_short_lines_go_(spark):
    long = "a line of more than twenty-five characters"
    texts = {1: f"Menu\n\n{long}\nMenux", 2: f"Menu\n\n  \n{long}!\nown", 3: "  \nMenu\nMenu\nlast"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = {1: texts[1], 2: "\n  \nown", 3: "  \nlast"}
    out = line_dedup.dedup_lines(docs).collect()
    assert {x.doc_id: x.text for x in out} == want
    assert {x.doc_id: (x.n_exact, x.n_near) for x in out} == {1: (0, 0), 2: (1, 1), 3: (2, 0)}
    assert {x.doc_id: x.text for x in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()} == want


def test_a_text_of_many_equal_lines(spark):
    """60,000 equal lines in one text, and as many in another: what goes is found by its number, not sought among all."""
    import time

    docs = spark.createDataFrame([(1, "all alike, line by line\n" * 60_000 + "end"), (2, "all alike, line by line\n" * 60_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].text == "all alike, line by line\nend" and got[1].n_exact == 59_999
    assert got[2].text == "" and got[2].n_exact == 60_000 and time.time() - began < 60


def test_a_text_of_many_secrets(spark):
    """40,000 matches in a megabyte, some too short to count, with their places."""
    import time

    from linkscope.llm import secrets

    parts, want, at = [], [], 0
    for k in range(40_000):
        word = "token=" + ("é" if k % 7 == 0 else "") + f"k{k:06}"
        if k % 7:
            want.append((at, at + len(word)))
        parts.append(word)
        at += len(word) + 1
    docs = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    began = time.time()
    spans = secrets.find_secrets(docs).first().spans
    assert [(s["at"], s["at"] + s.chars) for s in spans] == want and time.time() - began < 60
