"""Token counts by a compiled finite-state transducer.

The tokenizer is a byte-fallback BPE model of the sentencepiece library. A text's tokens end
where the tokens of its prefixes end: if the last token of a prefix is t, the rest is the
tokenization of what stands before t. Which token is last follows from the tokens that may
begin at the places still open (those from which some vocabulary entry can go on) and from the
last token before each of them, for two tokens stand side by side just if the pair's text is
tokenized into that pair. So a deterministic transducer reads the text: its state is the tuple
of open places, each with its place in the vocabulary's trie, the last token before it and the
count there relative to the current one; each transition emits by how much the count changes.
States and transitions are compiled when first met, and kept in a table.

A batch of texts is one long string, cut into chunks that numpy runs side by side. Past its
first reset (a text's start, a character outside of the vocabulary, a space after another
character) a chunk's state no longer depends on where it began: its state map is constant. The
stretch before the reset is run from the exit state of the chunk before, so the maps compose in
rounds of a prefix scan, one round unless a chunk has no reset.

Defined cases: a null text is empty; an empty text has no tokens; ids are passed through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Classes of characters: the start of a text; characters outside of the vocabulary by their UTF-8 bytes; space; others as they come.
START, UNKNOWN, BLANK = 0, (1, 2, 3, 4), 5
_SEPARATOR = "\ud800"
CHUNK = 256
BATCH_CHARS = 4_000_000
#: Beyond this number of states the table is compiled anew, to bound memory.
MAX_STATES = 250_000
#: Open places with at most so many tokens below them are merged where they go on alike.
MANY_BELOW = 24


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("a token that spans words: a space isn't a reset in this vocabulary")
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for piece in self.score:
            node = 0
            for c in piece:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][c]
            self.token[node] = piece
        self.pairs: dict[tuple[str, str], bool] = {}
        self.made: dict[str, bool] = {}
        self.split_of: dict[str, tuple[str, str] | None] = {}
        self.lives: dict[tuple[str, bool], list[tuple[str, float, float]]] = {}
        #: Tokens below each node of the trie, itself excluded; None where they are many.
        self.below: list[list[str] | None] = [[] for _ in self.trie]
        for node in range(len(self.trie) - 1, -1, -1):  # children have larger numbers
            found = [] if all(self.below[n] is not None for n in self.trie[node].values()) else None
            for n in self.trie[node].values() if found is not None else ():
                found += [self.token[n]] * (self.token[n] is not None) + self.below[n]
            self.below[node] = found if found is not None and len(found) <= MANY_BELOW else None
        self.alike: dict[tuple, str | None] = {}
        self.stands_for: dict[tuple, tuple[bool, str | None]] = {}
        self.class_of = np.full(0x110000, 0xFFFF, dtype=np.uint16)
        self.class_of[ord(_SEPARATOR)], self.class_of[ord(" ")], self.class_of[ord(SPACE)] = START, BLANK, BLANK
        self.chars: list[str | None] = [None] * BLANK + [SPACE]
        self.clear()

    def clear(self) -> None:
        """State 0 is asleep: it reads anything and emits nothing. State 1 is that of a text's start, and after any reset but a space."""
        self.keys: list[tuple] = [(), ((0, None, 0),)]
        self.state_of = {k: i for i, k in enumerate(self.keys)}
        self.table = np.full((1024, 128), -1, dtype=np.int32)
        self.table[0] = 0 << 8 | 128
        self.after_space = self._move(self.keys[1], SPACE)[0]

    # -- compilation -------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The tokens of a short text, by the definition: merge the best pair, the leftmost of equals, till none is left."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def life(self, token: str, right: bool) -> list[tuple[str, float, float]]:
        """The parts that lie at a token's right or left edge while it is made, each with the ranks at which it is made and merged away."""
        key = (token, right)
        if key not in self.lives:
            out, end = [], float("inf")
            while True:
                made = -self.score[token] if len(token) > 1 else float("-inf")
                out.append((token, made, end))
                if len(token) == 1:
                    break
                token, end = self.halves(token)[right], made
            self.lives[key] = out
        return self.lives[key]

    def halves(self, token: str) -> tuple[str, str]:
        """The two parts of which the tokenizer makes a token at last."""
        if token not in self.split_of:
            parts = list(token)
            while len(parts) > 2:
                best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.split_of[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split_of[token]

    def beside(self, last: str | None, token: str) -> bool:
        """Whether token may follow last (None: anything that doesn't merge with it).

        It may if no part at last's right edge merges with one at token's left edge while both
        exist; of equal ranks the pair further left goes first. Only tokens that the tokenizer
        makes from their own text count.
        """
        if token not in self.made:
            self.made[token] = len(self.merge(token)) == 1
        if last is None or not self.made[token]:
            return self.made[token]
        key = (last, token)
        if key not in self.pairs:
            score, left = self.score, self.life(token, False)
            self.pairs[key] = not any(
                x + y in score and -score[x + y] < gone and -score[x + y] <= done and max(was, new) < min(gone, done)
                for x, was, gone in self.life(last, True)
                for y, new, done in left
            )
        return self.pairs[key]

    def open_(self, node: int, last: str | None) -> tuple[bool, str | None]:
        """Whether a token below node may follow last; and a token that serves as well as last for all of them.

        What can't go on is dropped from states, and what goes on alike is one state.
        """
        tokens = self.below[node]
        if tokens is None or last is None:
            return True, last
        key = (node, last)
        if key not in self.stands_for:
            may = tuple(self.beside(last, t) for t in tokens)
            self.stands_for[key] = (any(may), None if all(may) and all(self.beside(None, t) for t in tokens) else self.alike.setdefault((node, may), last))
        return self.stands_for[key]

    def _move(self, key: tuple, c: str) -> tuple[int, int]:
        """The state after reading c, and the change of the count."""
        went, end = [], None
        for node, last, count in key:
            if node == 0 and c == SPACE and last and last[-1] != SPACE:
                last = None
            node = self.trie[node].get(c)
            if node is not None:
                if end is None and (t := self.token[node]) and self.beside(last, t):
                    end = (t, count + 1)
                if self.trie[node]:
                    may, last = self.open_(node, last)
                    if may:
                        went.append((node, last, count))
        token, change = end
        new = tuple((node, last, count - change) for node, last, count in went) + ((0, token, 0),)
        if new not in self.state_of:
            self.state_of[new] = len(self.keys)
            self.keys.append(new)
        return self.state_of[new], change

    def compile(self, states: np.ndarray, classes: np.ndarray) -> None:
        for s, c in {*zip(states.tolist(), classes.tolist())}:
            if c <= UNKNOWN[-1]:
                to, change = 1, c
            else:
                to, change = self._move(self.keys[s], self.chars[c])
            if len(self.keys) > len(self.table):
                self.table = np.vstack([self.table, np.full((len(self.table), self.table.shape[1]), -1, dtype=np.int32)])
            self.table[s, c] = to << 8 | (change + 128)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        got = self.class_of[codes]
        if (got == 0xFFFF).any():
            for code in np.unique(codes[got == 0xFFFF]).tolist():
                if chr(code) in self.score:
                    self.class_of[code] = len(self.chars)
                    self.chars.append(chr(code))
                else:
                    self.class_of[code] = len(chr(code).encode())
            while len(self.chars) > self.table.shape[1]:
                self.table = np.hstack([self.table, np.full(self.table.shape, -1, dtype=np.int32)])
                self.table[0] = 0 << 8 | 128
            got = self.class_of[codes]
        return got

    # -- running -----------------------------------------------------------------------------

    def step(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.table[states, classes]
        if (got < 0).any():
            new = got < 0
            self.compile(states[new], classes[new])
            got = self.table[states, classes]
        return got >> 8, (got & 255) - 128

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.keys) > MAX_STATES:
            self.clear()
        joined = "".join(f"{_SEPARATOR} {t}" if t else _SEPARATOR for t in texts)
        read = self.classes(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        lanes = -(-len(read) // CHUNK)
        flat = np.zeros(lanes * CHUNK, dtype=read.dtype)
        flat[: len(read)] = read
        resets = flat <= UNKNOWN[-1]
        resets[1:] |= (flat[1:] == BLANK) & (flat[:-1] != BLANK)
        grid, emitted = np.ascontiguousarray(flat.reshape(lanes, CHUNK).T), np.zeros((CHUNK, lanes), dtype=np.int16)
        resets = resets.reshape(lanes, CHUNK)
        first = np.where(resets.any(axis=1), resets.argmax(axis=1), CHUNK)
        # The chunks past their first reset: from there, every chunk's state is known.
        order = np.argsort(first, kind="stable")
        bounds = np.searchsorted(first[order], np.arange(CHUNK + 1))
        states = np.zeros(lanes, dtype=np.int64)
        for k in range(CHUNK):
            states, emitted[k] = self.step(states, grid[k])
            woken = order[bounds[k] : bounds[k + 1]]
            states[woken] = np.where(grid[k][woken] == BLANK, self.after_space, 1)
        # The stretches up to the resets, from the exit states of the chunks before.
        exits, known = states, first < CHUNK
        waiting, entry_known = np.arange(lanes), np.concatenate([[True], known[:-1]])
        while len(waiting):
            now = waiting[entry_known[waiting]]
            waiting = waiting[~entry_known[waiting]]
            own = np.where(now == 0, 1, exits[now - 1])
            for k in range(int(first[now].max(initial=-1)) + 1):
                on = np.flatnonzero(first[now] >= k)
                if k == CHUNK:
                    break
                own[on], emitted[k, now[on]] = self.step(own[on], grid[k, now[on]])
            done = now[first[now] == CHUNK]
            exits[done] = own[first[now] == CHUNK]
            entry_known[np.minimum(done + 1, lanes - 1)] = True
        total = np.ascontiguousarray(emitted.T).ravel()[: len(read)]
        return np.add.reduceat(total.astype(np.int64), np.flatnonzero(read == START)) if len(texts) else np.zeros(0, dtype=np.int64)


_KEPT: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker, which Spark uses again for its next tasks."""
    if path not in _KEPT:
        _KEPT[path] = Transducer(path)
    return _KEPT[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts, size, counts = [], 0, []
            for text in batch.column(1):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > BATCH_CHARS:
                    counts.append(machine.count(texts))
                    texts, size = [], 0
            counts.append(machine.count(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(counts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
