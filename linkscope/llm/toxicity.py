"""Toxicity by weak supervision.

Voters. Lexicon voters say "toxic" where a word of a list occurs: a fixed list of insults, and
lists of words and of word stems that go with label 1 in labelled rows of other folds, dealt into
groups. Pattern voters look at masked words, shouting and address. Two voters say "not toxic": no
listed word at all, and no listed stem. No row's own label votes on it, and near copies share a
fold, so that a voter is as accurate on the rows that the label model sees as on any others.

Label model. Votes are pooled by pattern (which voters said what), and expectation maximization
fits a generative model of the unseen label: each voter has its own accuracy for either label.
Voters' correlations given the label are estimated from the pooled votes and discount the votes
of those that only repeat others. The result is a probability of the label for each row.

Classifier. Logistic regression on the listed words and stems, each with a weight of its own, is
trained on those probabilities, and scores any text by its words.

Fitting takes at most about TRAIN_ROWS labelled rows by a hash of their ids. Rows with the same words, patterns
and label are one row with a weight.
Defined cases: null and empty texts have no words and score by the intercept; labels of null
teach nothing; repeated rows score alike; with nothing to learn from, the fixed list decides.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 5_000
#: Insults that any such list has.
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers clown pathetic disgusting worthless imbecile bastard bastards idiota idioten dummkopf arschloch abschaum imbécile connard ordure salaud estúpido imbécil basura escoria".split())
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
GROUPS = 4
#: Parts of the labelled rows; a row's voters are mined from the other parts.
FOLDS = 5
MAX_FEATURES = 6000


def features(text: str | None) -> set[str]:
    """Lower-case words, and the stems (a stem ends with *) of those that are no listed insult: what an insult shows says nothing of other words that begin alike."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {w[:n] + "*" for w in words - INSULTS for n in STEMS if len(w) >= n}


def patterns(text: str) -> list[bool]:
    letters = sum(map(str.isalpha, text))
    return [bool(re.search(r"\w[*#@$%]{2,}\w", text)), letters > 20 and sum(map(str.isupper, text)) > 0.7 * letters, bool(re.search(r"(?i)\byou (are|'re) (an?|such|so)\b", text))]


class LabelModel:
    """Accuracies and correlations of voters (1: toxic, 0: not, -1: abstains) by expectation maximization over vote patterns."""

    def __init__(self, votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 40):
        self.said = np.stack([votes == 1, votes == 0], axis=2).astype(float)  # row, voter, what
        m = votes.shape[1]
        # rate[y, voter, what]: chance of saying so under label y. Voters start as better than chance.
        rate = np.zeros((2, m, 2))
        overall = (self.said * weight[:, None, None]).sum(0) / weight.sum()
        rate[1, :, 0], rate[0, :, 0] = np.minimum(0.9, overall[:, 0] * 4 + 1e-3), overall[:, 0] * 0.5 + 1e-4
        rate[0, :, 1], rate[1, :, 1] = np.minimum(0.98, overall[:, 1] * 1.05 + 1e-3), overall[:, 1] * 0.4 + 1e-4
        self.rate, self.prior, self.share = rate, prior, np.ones(m)
        for turn in range(rounds):
            p = self.posterior(self.said)
            for y, q in ((1, p), (0, 1 - p)):
                w = q * weight
                self.rate[y] = ((self.said * w[:, None, None]).sum(0) + 0.1 * overall + 1e-3) / (w.sum() + 0.2)
            self.prior = float(np.clip((p * weight).sum() / weight.sum(), 0.01, 0.6))
            if turn == rounds // 2:
                self.share = 1 / self.correlated(p, weight)

    def correlated(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each voter, one and the sum of its squared correlations with the others given the label."""
        total = np.zeros((self.said.shape[1],) * 2)
        x = self.said[:, :, 0] - self.said[:, :, 1]
        for q in (p, 1 - p):
            w = q * weight / max(1e-9, (q * weight).sum())
            d = x - (x * w[:, None]).sum(0)
            cov = (d * w[:, None]).T @ d
            sd = np.sqrt(np.maximum(1e-9, np.diag(cov)))
            total = np.maximum(total, np.where(np.outer(sd, sd) > 1e-6, (cov / np.outer(sd, sd)) ** 2, 0))
        np.fill_diagonal(total, 0)
        return 1 + np.minimum(total, 1).sum(1)

    def posterior(self, said: np.ndarray) -> np.ndarray:
        r = np.clip(self.rate, 1e-5, 1 - 1e-5)
        silent = np.clip(1 - r.sum(2), 1e-5, 1)
        quiet = 1 - said.sum(2)
        gain = (said * np.log(r[1] / r[0])).sum(2) + quiet * np.log(silent[1] / silent[0])
        return 1 / (1 + np.exp(-np.clip((gain * self.share).sum(1) + np.log(self.prior / (1 - self.prior)), -30, 30)))


class Model:
    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.listed = {n: {w for w in weights if w.endswith("*") and len(w) == n + 1} for n in STEMS}

    def score(self, text: str | None) -> float:
        weights, z = self.weights, self.intercept
        if text:
            found = set(WORD.findall(text.lower()))
            hit = found & weights.keys()
            found -= INSULTS
            for n, stems in self.listed.items():
                hit |= {w[:n] + "*" for w in found} & stems if stems else set()
            z += sum(weights[w] for w in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def mined(toxic: np.ndarray, df: np.ndarray, n_rows: int, share: float, names: list[str]) -> tuple[list[int], np.ndarray]:
    """Numbers of the words that go with label 1, best first, and each word's lower bound of precision: toxic of its df rows have label 1."""
    # Enough rows as well: in small tables chance pairs rare words with a label.
    bound = np.where(toxic >= (3 if n_rows < 1000 else 4), (toxic - 1.3 * np.sqrt(np.maximum(0, toxic * (1 - toxic / (df + 1))) + 0.5)) / np.maximum(1, df), 0)
    return sorted(np.flatnonzero(bound > max(0.5, 2 * share)).tolist(), key=lambda k: (-bound[k], names[k])), bound


#: Insults, mined groups, mined stems, mined words; three patterns; no listed word, no listed stem.
VOTERS = GROUPS + 8


def voted(own: list[np.ndarray], shapes: list[list[bool]], lexicon: list[int], insults: list[int], names: list[str]) -> np.ndarray:
    """What each voter says of each row, which is given by its words' numbers and its patterns (1: toxic, 0: not, -1: abstains)."""
    lists = [insults, *(lexicon[g::GROUPS] for g in range(GROUPS)), [k for k in lexicon if names[k].endswith("*")], [k for k in lexicon if not names[k].endswith("*")], lexicon + insults]
    member = np.zeros((len(names), len(lists)), dtype=bool)
    for g, ks in enumerate(lists):
        member[ks, g] = True
    hit = np.array([member[a].any(axis=0) if len(a) else np.zeros(len(lists), dtype=bool) for a in own]).reshape(len(own), len(lists))
    shown = np.array(shapes, dtype=bool).reshape(len(own), 3)
    stems, listed = hit[:, GROUPS + 1], hit[:, -1]
    return np.column_stack([np.where(hit[:, :-1], 1, -1), np.where(shown, 1, -1), np.where(listed, -1, 0), np.where(stems, -1, 0)])


class Texts:
    """Texts of an Arrow column as strings, one at a time, as often as they are asked for."""

    def __init__(self, column: pa.ChunkedArray):
        self.column = column

    def __iter__(self) -> Iterator[str | None]:
        return (x.as_py() for x in self.column)


def fit(texts: Iterable[str | None], labels: list[int]) -> Model:
    """A classifier from texts, which are read twice, and their labels (1: toxic)."""
    # Only words of rows with label 1 can be listed; the others, most of all words, are not held.
    listable = set(INSULTS)
    for text, label in zip(texts, labels):
        if label == 1:
            listable |= features(text)
    number: dict[str, int] = {}
    seen, own, shapes, folds, y, weight = {}, [], [], [], [], []
    for text, label in zip(texts, labels):
        f, shown = sorted(features(text)), patterns(text or "")
        # A digest stands for the words, so that those of one text alone are in memory.
        row = seen.setdefault((hashlib.blake2b(" ".join(f).encode(), digest_size=16).digest(), *shown, label), len(y))
        if row == len(y):
            own.append(np.fromiter((number.setdefault(w, len(number)) for w in f if w in listable), dtype=np.int32))
            shapes.append(shown)
            folds.append(min((zlib.crc32(w.encode()) for w in f), default=0) % FOLDS)  # near copies share it mostly
            y.append(label)
            weight.append(0)
        weight[row] += 1
    names, y, weight = list(number), np.array(y, dtype=float), np.array(weight, dtype=float)
    if not len(y) or not y.any():
        return Model({w: 6.0 for w in INSULTS}, -3.0)
    # Copies say nothing new of which words go with a label, so words are mined from different rows; all else weighs each row by its copies.
    size, share = len(names), float((y * weight).sum() / weight.sum())
    count = lambda rows: np.bincount(np.concatenate([own[r] for r in rows]), minlength=size) if len(rows) else np.zeros(size, dtype=np.int64)
    toxic = count(np.flatnonzero(y == 1))
    df = toxic + count(np.flatnonzero(y == 0))
    lexicon, bound = mined(toxic, df, len(y), share, names)
    insults = [number[w] for w in sorted(INSULTS) if w in number]
    votes = np.zeros((len(own), VOTERS), dtype=np.int64)
    for k in range(FOLDS):
        rows = np.flatnonzero(np.array(folds) == k)
        bad = rows[y[rows] == 1]
        others, _ = mined(toxic - count(bad), df - count(rows), len(y) - len(rows), share, names)
        votes[rows] = voted([own[r] for r in rows], [shapes[r] for r in rows], others, insults, names)
    pooled, at = np.unique(votes, axis=0, return_inverse=True)
    label_model = LabelModel(pooled, np.bincount(at.ravel(), weights=weight), share)
    target = label_model.posterior(label_model.said)[at.ravel()]
    # Logistic regression on the probabilities, by accelerated gradient steps on a sparse matrix.
    top = set(lexicon + insults)
    chosen = sorted(top, key=lambda k: (-bound[k], -df[k], names[k]))[:MAX_FEATURES]
    place = np.full(size, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    row = np.repeat(np.arange(len(own)), [len(a) for a in own])
    col = place[np.concatenate(own)]
    row, col = row[col >= 0], col[col >= 0]
    rarity = np.log((len(y) + 1) / (df[chosen] + 1)) / np.log(len(y) + 2)
    value = rarity[col]
    w, b, vw, vb = np.zeros(len(chosen)), float(np.log(share / max(1e-9, 1 - share))), 0.0, 0.0
    step = 4.0 * len(y) / max(1.0, float(np.bincount(row, weights=value**2, minlength=len(y)).max() * len(y) / 16))
    for _ in range(300):
        wl, bl = w + 0.9 * vw, b + 0.9 * vb
        z = np.bincount(row, weights=value * wl[col], minlength=len(y)) + bl
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / weight.sum()
        gw = np.bincount(col, weights=value * e[row], minlength=len(chosen)) + 1e-5 * wl
        vw, vb = 0.9 * vw - step * gw, 0.9 * vb - step * e.sum()
        w, b = w + vw, b + vb
    scaled = w * rarity
    # Insults that the sample lacks weigh as much as the middle one of those that it has.
    learned = {names[k]: float(scaled[i]) for i, k in enumerate(chosen) if abs(scaled[i]) > 1e-3}
    usual = float(np.median([learned[w] for w in learned if w in INSULTS] or [4.0]))
    return Model({w: max(usual, 1.0) for w in INSULTS} | learned, float(b))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """A model from at most about train_rows labelled rows for which `usable`, an expression of the id, holds."""
    known = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    share = min(1.0, train_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = docs.select(id_col, text_col).join(chosen, F.col(id_col) == F.col("label_id")).select(F.col(text_col).alias("text"), "label").toArrow()
    got = got.sort_by([("label", "ascending"), ("text", "ascending")])
    return fit(Texts(got["text"]), got["label"].to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """The id, the columns of keep and the score, in a column named out, of each row."""
    fixed = list(dict.fromkeys([id_col, *keep]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.score(t.as_py()) for t in batch.column(len(fixed))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fixed)], pa.array(got, pa.float64())], [*fixed, out])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in fixed)
    return docs.select(*fixed, F.col(text_col).alias("scored_text")).mapInArrow(run, schema + f", `{out}` double")
