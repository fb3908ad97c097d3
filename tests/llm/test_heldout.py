"""What the trained models give for rows that they did not learn from, and their scores against plain loops."""

import math
import os
import tracemalloc

import duckdb
import numpy as np
import pytest

from linkscope.llm import queries, toxicity

DATA = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@given
def test_language_of_held_out_rows(spark):
    got = {r.doc_id: r.lang_pred for r in queries.op2_language_id(spark, DATA).where("held_out").collect()}
    known = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet' WHERE lang IS NOT NULL AND regexp_matches(text, '\\pL')").fetchall())
    judged = [got[k] == known[k] for k in got if k in known]
    assert len(judged) > 100 and np.mean(judged) > 0.98


@given
def test_toxicity_of_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, DATA).where("held_out").collect()}
    known = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    both = [(got[k].score, got[k].predicted, known[k]) for k in got if k in known]
    toxic, clean = [s for s, _, y in both if y], [s for s, _, y in both if not y]
    caught, wrong = sum(p for _, p, y in both if y), sum(p for _, p, y in both if not y)
    assert len(toxic) > 100 and caught >= 0.85 * len(toxic) and wrong <= 0.02 * len(clean)
    # Area under the curve; ties count half.
    assert np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean]) > 0.9
    assert all(p == int(s >= 0.3) for s, p, _ in both)


def test_scores_equal_a_plain_sum_of_weights():
    texts = [f"gentle words about the garden number {k} " + ("you are a horrible zorgling idiot" if k % 3 == 0 else "and its trees") for k in range(60)]
    model = toxicity.fit(texts, [int(k % 3 == 0) for k in range(60)])
    for text in (*texts, "", None, "Zorglings of the GARDEN, you moron", "idiot " * 50_000):
        z = model.intercept + sum(model.weights.get(f, 0.0) for f in toxicity.features(text))
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-9)
    assert model.score(texts[0]) > 0.5 > model.score(texts[1])


def test_voters_of_rows_without_listed_words():
    """Rows that show no listed word, stem or pattern get no vote for label 1, and both votes against it."""
    names = ["plain", "weather", "scum", "scum*"]
    own = [np.array([0, 1]), np.array([], dtype=np.int64), np.array([1, 2, 3])]
    votes = toxicity.voted(own, [[False] * 3] * 3, [3], [2], names)
    assert votes.shape == (3, toxicity.VOTERS)
    assert (votes[:2, :-2] == -1).all() and (votes[:2, -2:] == 0).all()
    assert votes[2, 0] == 1 and votes[2, 1] == 1 and (votes[2, -2:] == -1).all()


def test_labels_of_a_row_do_not_reach_its_own_voters(monkeypatch):
    """Words that one row alone pairs with label 1 are mined for other folds only."""
    seen = []
    mined = toxicity.mined
    monkeypatch.setattr(toxicity, "mined", lambda toxic, df, n, share, names: seen.append((toxic[names.index("zorgling")], n)) or mined(toxic, df, n, share, names))
    texts = [f"row{chr(97 + k % 26)}{chr(97 + k // 26)} garden" + (" zorgling" if k == 7 else "") for k in range(60)]
    toxicity.fit(texts, [int(k in (7, 8)) for k in range(60)])
    whole, *folds = seen
    assert whole[0] == 1 and len(folds) == toxicity.FOLDS
    assert sorted(x for x, _ in folds) == [0, 1, 1, 1, 1] and sum(whole[1] - n for _, n in folds) == whole[1]


def test_fit_holds_no_words_that_cannot_be_listed():
    """Words of rows without label 1 are most of all words; the driver held each of them and its stems."""
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200)) + (" zorgling" if k % 50 == 0 else "") for k in range(1000)]
    labels = [int(k % 50 == 0) for k in range(1000)]
    toxicity.fit(texts[:20], labels[:20])
    tracemalloc.start()
    model = toxicity.fit(texts, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "zorgling" in model.weights and most < 15_000_000
