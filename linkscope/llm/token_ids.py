"""Token ids of whole texts by the `tokenizers` library, at the speed of a word table.

For a tokenizer that normalizes, splits and maps bytes as that of word_bpe_49k.json does, no token
spans white space, and the ids of a text are those of its chunks in a row. A text of Latin-1
characters, which no normalization changes but to lower case, comes apart by Arrow's kernels into
the very words and marks that the tokenizer's pattern finds; any other text into what stands
between white space. Arrow numbers the different chunks of a slice of texts, so that Python handles
each of them once a slice. A worker keeps the ids of the chunks that it has seen. New words of
Latin-1 letters go straight to the library's model, since nothing else changes them; other new
chunks go through the whole tokenizer, many at a time. The table is emptied beyond a number of
chunks, so that memory stays bounded.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a worker, at about 200 bytes each.
TABLE_CHUNKS = 600_000
#: Chunks that the library gets at a time; each of its results takes about a kilobyte.
LIBRARY_CHUNKS = 2048
#: Bytes of text in a slice, but for one longer text.
SLICE_BYTES = 4 << 20
_CHUNK = re.compile(r"[^ \t\n\r]+")
#: White space of str.split() and Arrow that is none to the tokenizer, and the beginning of special tokens.
_SPECIAL = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Texts that do not come apart by _APART.
_ODD = r"[^\x{00}-\x{ff}]|<\||[\x{1c}-\x{1f}]"
#: Lower-case letters, numbers and white space of Latin-1, and what the tokenizer's pattern takes besides runs of letters.
_LETTERS, _NUMBERS, _WHITE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x{85}\x{a0}"
_APART = rf"'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+"
_WORD = re.compile(f"[{_LETTERS}]+")


class WordTable:
    """encode() gives each text's ids as bytes, little-endian unsigned 32-bit."""

    def __init__(self, path: str, chunks: int = TABLE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), chunks, {}
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(128, 256)) if _WORD.fullmatch(c)}

    @staticmethod
    def apart(texts: pa.Array) -> pa.Array:
        """Lists of the words and marks of texts that are not odd; an empty one stands beside white space at an end."""
        return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \0 "))

    @staticmethod
    def split(text: str) -> list[str]:
        """Chunks of an odd text."""
        return _CHUNK.findall(text) if any(x in text for x in _SPECIAL) else text.split()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of new chunks, which are kept."""
        if len(self.known) + len(chunks) > self.limit:
            self.known.clear()
        got, others = [b""] * len(chunks), []
        for k, chunk in enumerate(chunks):
            if _WORD.fullmatch(chunk):
                got[k] = array("I", [t.id for t in self.model.tokenize(chunk if chunk.isascii() else chunk.translate(self.level))]).tobytes()
            else:
                others.append(k)
        for at in range(0, len(others), LIBRARY_CHUNKS):
            part = others[at : at + LIBRARY_CHUNKS]
            for k, x in zip(part, self.tokenizer.encode_batch_fast([chunks[k] for k in part], add_special_tokens=False)):
                got[k] = array("I", x.ids).tobytes()
        self.known.update(zip(chunks[: self.limit], got))
        return got

    def look_up(self, lists: pa.Array) -> list[bytes]:
        """The ids of each list of chunks, in a row."""
        coded = pc.list_flatten(lists).dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()
        got = list(map(self.known.get, chunks))
        new = [k for k, x in enumerate(got) if x is None]
        for k, x in zip(new, self.learn([chunks[k] for k in new])):
            got[k] = x
        size, flat, code = np.fromiter(map(len, got), np.int64, len(got)) // 4, np.frombuffer(b"".join(got), "<u4"), coded.indices.to_numpy()
        n = size[code]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        edges = (4 * ends[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        plain = iter(self.look_up(self.apart(texts.filter(pc.invert(odd)))))
        others = iter(self.look_up(pa.array(map(self.split, texts.filter(odd).to_pylist()), pa.list_(pa.string()))))
        return [next(others if x else plain) for x in odd.to_pylist()]


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """One table for each Python worker, which Spark uses again for its next tasks."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def slices(batch: pa.RecordBatch, text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A record batch in parts of so many bytes of text, so that what is made of them stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    last = np.flatnonzero(np.diff(ends // most)) + 1
    for a, b in zip([0, *last.tolist()], [*last.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)
