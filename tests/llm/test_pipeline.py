"""The pipeline on a small corpus with planted cases, and the registered queries."""

import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, folder = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = {i: "\n".join(prose(30) for _ in range(3)) for i in range(80)}
    items = {k: prose(35) for k in range(4)}
    for i in range(0, 20, 4):
        texts[i] = texts[i].replace(" ", " idiot ", 2)
    for i in (41, 43):
        texts[i] += "\n" + items[i % 4]
    passage = prose(60)
    for i in (50, 51, 52):
        texts[i] += "\n" + passage
    # One word replaced breaks 5 of 86 shingles: 81 of 91 stay, 0.89. Three break 15: 71 of 101, 0.70, are no near copy.
    near = texts[60].split(" ")
    near[50] = "dddd"
    texts[63] = " ".join(near)
    near[5], near[50], near[70] = "aaaa", "bbbb", "cccc"
    texts[61], texts[62] = " ".join(near), texts[60]
    rows = [(i, t, "en", "src0", len(t)) for i, t in texts.items()] + [(200, None, None, None, None), (201, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 20 and i % 4 == 0)) for i in range(80)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage


def test_each_stage_catches_its_cases_and_leaves_the_rest(spark, corpus):
    folder, texts, passage = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{k}")
        docs = spark.read.parquet(f"{folder}/out-{k}")
        if k < 4:
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    everyone = set(texts) | {200, 201}
    assert everyone - set(kept["toxicity"]) == set(range(0, 20, 4))
    # 62 repeats 60 line by line; a replaced word is more than two edits.
    assert set(kept["toxicity"]) - set(kept["line_dedup"]) == {62}
    assert [passage in kept["line_dedup"][i] for i in (50, 51, 52)] == [True, False, False]
    assert {i for i in kept["line_dedup"] if kept["line_dedup"][i] != kept["toxicity"][i]} <= {51, 52, 61, 63}
    assert set(kept["ngram_join"]) - set(kept["decontamination"]) == {41, 43}
    assert {r.doc_id for r in docs.collect()} == set(kept["decontamination"])


def test_near_copies_leave_one(spark, corpus):
    folder, texts, _ = corpus
    docs = spark.createDataFrame([(i, texts[i], "en", "s", 1) for i in (59, 60, 61, 62, 63)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_join_stage(spark, docs, folder).collect()) == [59, 60, 61]


def test_stages_take_empty_tables_and_clashing_names(spark, corpus):
    folder, texts, _ = corpus
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _toxicity0 string, near string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {q.split("_")[0] + "_" for q in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
