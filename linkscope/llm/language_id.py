"""Language identification by prediction by partial matching over bytes.

For each language, a tree of byte contexts of up to ORDER bytes holds how often each byte
followed. A byte is coded in the longest context that the tree has; a byte not seen there costs
an escape (q of n + q, for q different followers in n), and is coded in the next shorter
context among the bytes that the longer one did not rule out, down to all 256 bytes alike. The
statistics are frozen before scoring, so each (context, byte) has one exact code length in each
language. The lengths are worked out once; a text's code length is a sum of table lookups, and
the language with the shortest code wins.

Training takes whole texts of at most about TRAIN_DOCS documents of each language, chosen by a
hash of their ids; that bound is a parameter. Defined cases: a null text, or one without a
letter, is `und` with score 0; null languages teach nothing; ties go to the first language in
alphabetical order; with nothing to learn from, all rows are `und`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
TRAIN_DOCS = 1500
#: Contexts seen less often are left out of the tree.
LEAST_COUNT = 6
PAD = 256


def training_rows(docs: DataFrame, usable: Column, lang_col: str, id_col: str, train_docs: int) -> DataFrame:
    """About train_docs rows of each language, by a hash of the id."""
    rows = docs.where(usable & F.col(lang_col).isNotNull())
    shares = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).select(F.col(lang_col).alias("l"), F.least(F.lit(1.0), F.lit(1.0 * train_docs) / F.col("n")).alias("share"))
    chosen = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    return rows.join(F.broadcast(shares), F.col(lang_col) == F.col("l")).where(chosen)  # one row a language


def gram_counts(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, gram and n: runs of ORDER bytes and the byte after them, nine bits each; PAD stands before a text's start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                parts = []
                for own, text in zip(langs, batch.column(1)):
                    if own == lang and text.is_valid:
                        a = np.frombuffer(text.as_buffer(), dtype=np.uint8).astype(np.int64)
                        a = np.concatenate([np.full(ORDER, PAD, dtype=np.int64), a])
                        gram = a[: len(a) - ORDER]
                        for k in range(1, ORDER + 1):
                            gram = gram << 9 | a[k : len(a) - ORDER + k]
                        parts.append(gram)
                grams, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return rows.select(lang_col, text_col).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of all languages in one table of code lengths, in bits."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int = LEAST_COUNT):
        self.langs = langs
        seen = sorted({int(b) for grams, _ in counts.values() for b in np.unique(grams & 511)})
        #: Symbols: the bytes seen, then one for any other byte, then PAD.
        self.size = len(seen) + 2
        self.other, self.pad = len(seen), len(seen) + 1
        self.symbol = np.full(257, self.other, dtype=np.int64)
        self.symbol[seen] = np.arange(len(seen))
        self.symbol[PAD] = self.pad
        weight = np.ones(self.size)
        weight[self.other], weight[self.pad] = 256 - len(seen), 0
        a = self.size
        stats: list[list[dict[int, np.ndarray]]] = []
        for lang in langs:
            grams, n = counts[lang]
            digits = [self.symbol[grams >> 9 * k & 511] for k in range(ORDER, -1, -1)]
            levels = []
            for order in range(ORDER + 1):
                context = np.zeros(len(grams), dtype=np.int64)
                for d in digits[ORDER - order : ORDER]:
                    context = context * a + d
                pairs, at = np.unique(context * a + digits[-1], return_inverse=True)
                total = np.bincount(at, weights=n, minlength=len(pairs))
                owner, first = np.unique(pairs // a, return_index=True)
                levels.append({int(c): (pairs[i:j] % a, total[i:j]) for c, i, j in zip(owner, first, [*first[1:], len(pairs)]) if order == 0 or total[i:j].sum() >= least})
            stats.append(levels)
        # One state for each context of any language; a state of the empty context is number 0.
        contexts = [sorted({c for levels in stats for c in levels[order]}) for order in range(ORDER + 1)]
        state_of = [{c: 0 for c in contexts[0]} or {0: 0}]
        number = 1
        for order in range(1, ORDER + 1):
            state_of.append({c: number + k for k, c in enumerate(contexts[order])})
            number += len(contexts[order])
        cost = np.zeros((number, a, len(langs)), dtype=np.float32)
        uniform = np.full(a, 1 / 256)
        uniform[self.pad] = 1e-9
        for k, levels in enumerate(stats):
            dist: dict[tuple[int, int], np.ndarray] = {}

            def of(order: int, c: int, levels=levels, dist=dist) -> np.ndarray:
                """Probability of each byte of a symbol after the context c."""
                if order < 0:
                    return uniform
                if c not in levels[order]:
                    return of(order - 1, c % a ** (order - 1) if order else 0) if order else uniform
                if (order, c) not in dist:
                    lower = of(order - 1, c % a ** (order - 1) if order else 0)
                    symbols, n = levels[order][c]
                    total, q = n.sum(), len(n)
                    free = weight * lower
                    free[symbols] = 0
                    rest = free.sum()
                    p = lower * (q / (total + q) / rest if rest > 0 else 1e-6)
                    p[symbols] = n / (total + q) / np.maximum(1, weight[symbols])
                    dist[order, c] = p
                return dist[order, c]

            for order in range(ORDER + 1):
                for c, s in state_of[order].items():
                    cost[s, :, k] = -np.log2(of(order, c))
        cost[:, self.pad] = 0
        self.cost = cost.reshape(number * a, len(langs))
        # The state after any ORDER symbols: of the longest context in the tree.
        last = np.arange(a**ORDER, dtype=np.int64)
        self.state = np.zeros(a**ORDER, dtype=np.int32)
        for order in range(1, ORDER + 1):
            known = np.zeros(a**order, dtype=np.int32)
            for c, s in state_of[order].items():
                known[c] = s
            got = known[last % a**order]
            self.state = np.where(got > 0, got, self.state)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths: one row a text, one column a language."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(size + ORDER) - size - ORDER
        a = np.full(int((size + ORDER).sum()), self.pad, dtype=np.int64)
        place = np.ones(len(a), dtype=bool)
        for k in range(ORDER):
            place[starts + k] = False
        a[place] = self.symbol[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        context = a[: len(a) - ORDER]
        for k in range(1, ORDER):
            context = context * self.size + a[k : len(a) - ORDER + k]
        got = np.zeros((len(a), len(self.langs)), dtype=np.float32)
        got[ORDER:] = self.cost[self.state[context] * np.int64(self.size) + a[ORDER:]]
        return np.add.reduceat(got, starts, axis=0, dtype=np.float64) if len(texts) else np.zeros((0, len(self.langs)))


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model | None:
    counts = gram_counts(training_rows(docs, usable, lang_col, id_col, train_docs), lang_col, text_col).toPandas()
    by = {lang: (g["gram"].to_numpy(), g["n"].to_numpy(dtype=np.float64)) for lang, g in counts.groupby("lang")}
    return Model(sorted(by), by) if by else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns of keep, lang_pred and score (the posterior of the language with equal priors) of each row."""
    fixed = [id_col, *keep]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of MB, bounded by the number of contexts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(len(fixed)).to_pylist()
            lettered = [k for k, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for part in parts(lettered, texts):
                bits = model.bits([texts[k].encode() for k in part])
                least = bits.min(axis=1)
                best = bits.argmin(axis=1)
                post = 1 / np.exp2(np.maximum(-1000, least[:, None] - bits)).sum(axis=1)
                for k, b, p in zip(part, best, post):
                    langs[k], scores[k] = model.langs[b], p
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fixed)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*fixed, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in fixed)
    return docs.select(*fixed, text_col).mapInArrow(run, schema + ", lang_pred string, score double")


def parts(rows: list[int], texts: list[str], chars: int = 1_000_000) -> Iterator[list[int]]:
    """Rows in lists of about so many characters."""
    own, size = [], 0
    for k in rows:
        own.append(k)
        size += len(texts[k])
        if size >= chars:
            yield own
            own, size = [], 0
    if own:
        yield own
