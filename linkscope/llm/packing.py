"""Best-fit packing of token pieces into sequences, under several capacities at once.

A sequence has room for so many tokens, documents and units of attention cost (the sum of the
squares of its pieces' lengths). Pieces go in order of descending length, each to the open
sequence in which it leaves the least: the residual vector with the smallest weighted norm
("norm"), or the largest weighted dot product of piece and residual ("dot"), among those that
hold it under every capacity.

Pieces of one length are alike, and so are sequences of one fill. Packing therefore needs only
the number of pieces of each length, at most as many numbers as a sequence has tokens, whatever
the number of documents; it places whole runs of pieces into whole runs of sequences. The plan
says, for each length, which ranks go where. Spark numbers the pieces of each length in
buckets (a length that a third of all pieces share is spread over them) and looks up the plan.

Defined cases: a null text is empty, and holds one token, the end; rows that share a doc_id are
packed each; null ids are kept; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .token_ids import slices, word_table

MAX_TOKENS = 2048
#: Pieces that one bucket of a length holds, about.
BUCKET_ROWS = 100_000
LEAST_BUCKETS = 64


def cut(docs: DataFrame, tokenizer: str, end_id: int = 0, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each text's ids with end_id after them."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = word_table(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch):
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(table.encode(part.column(1))):
                    ids += end
                    for no, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                        own = ids[at : at + 4 * max_tokens]
                        row.append(k), piece.append(no), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int = MAX_TOKENS, max_cost: int | None = None, weights=(1.0, 0.05, 0.05), by: str = "norm") -> pd.DataFrame:
    """Placement of all pieces, from the number of each length.

    A row (length, rank, per_bin, sequence, offset) places the pieces of that length from that
    rank to the next row's: the n-th of them is in sequence + n // per_bin, at
    offset + (n % per_bin) * length.
    """
    room = np.array([max_tokens, max_docs, max_cost or max_tokens**2], dtype=np.float64)
    scale = np.sqrt(np.array(weights)) / room
    left, base, many = np.zeros((0, 3)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rows, sequences = [], 0
    smallest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        size, rank, n = np.array([length, 1.0, float(length) ** 2]), 0, counts[length]
        if (size > room).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {room}")
        while n:
            fits = np.flatnonzero((left >= size).all(axis=1))
            if len(fits):
                rest = (left[fits] - size) * scale
                score = (rest**2).sum(axis=1) if by == "norm" else -((left[fits] * scale) * (size * scale)).sum(axis=1)
                k = fits[np.argmin(score)]
                put = min(n, int(many[k]))
                rows.append((length, rank, 1, int(base[k]), int(max_tokens - left[k][0])))
                if put < many[k]:  # the others of this fill stay as they are
                    left, base, many = np.vstack([left, left[k]]), np.append(base, base[k] + put), np.append(many, many[k] - put)
                left[k], many[k] = left[k] - size, put
            else:
                per_bin = int(min(room // size))
                put = n // per_bin * per_bin or n
                per_bin = min(per_bin, n)
                rows.append((length, rank, per_bin, sequences, 0))
                left, base, many = np.vstack([left, room - per_bin * size]), np.append(base, sequences), np.append(many, put // per_bin)
                sequences += put // per_bin
            rank, n = rank + put, n - put
        keep = (left >= [smallest, 1, smallest**2]).all(axis=1)
        left, base, many = left[keep], base[keep], many[keep]
    return pd.DataFrame(rows, columns=["length", "rank", "per_bin", "sequence", "offset"], dtype=np.int64)


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, **capacities) -> DataFrame:
    """pieces (a written table with doc_id, piece, length and ids_crc32) and sequence_id and offset."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    placed = plan(counts, max_tokens, **capacities)
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = placed.sort_values(["length", "rank"])
        key = (at["length"].to_numpy() << 40) + at["rank"].to_numpy()
        for f in frames:
            k = np.searchsorted(key, (f["length"].to_numpy() << 40) + f["rank"].to_numpy(), side="right") - 1
            n = f["rank"].to_numpy() - at["rank"].to_numpy()[k]
            per_bin = at["per_bin"].to_numpy()[k]
            f["sequence_id"] = at["sequence"].to_numpy()[k] + n // per_bin
            f["offset"] = at["offset"].to_numpy()[k] + n % per_bin * f["length"].to_numpy()
            yield f.drop(columns="rank")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", **capacities) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(cut(docs, tokenizer, end_id, max_tokens, id_col, text_col), "pieces"), max_tokens, **capacities)
