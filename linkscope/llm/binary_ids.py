"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

The file format. Ids are replaced by their rank in descending frequency over the corpus, so
that frequent ones are small. A rank takes one to four bytes, little-endian; two bits a rank
say how many, and four of them make a control byte (the first in the lowest bits). The control
bytes of a block stand apart from its data bytes. Blocks of about BLOCK_TOKENS ids hold whole
documents in ascending id order, with the documents' ids and numbers of tokens. A table of
blocks is a Parquet folder, one row a block, so Spark's commit protocol covers writing; a
second small folder holds the ids in rank order. decode() looks the lengths of four ranks up by
their control byte, and the id up by its rank.

Defined cases: a null text is empty, and holds the end id alone; null ids of documents come
first; rows that share an id are each kept, side by side, in the order of their bytes; an empty
table writes no block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shared_dir
from .token_ids import slices, word_table

BLOCK_TOKENS = 1 << 20
#: Lengths of the four ranks of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(4):
        long = np.flatnonzero(size > k) if k else slice(None)
        data[at[long] + k] = ranks[long] >> np.uint32(8 * k) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    at, raw = np.cumsum(size) - size, np.frombuffer(data, dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ids of each text, and a row for each task with the ids that it met and their counts."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "ids", "met", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end, total, id_pa = word_table(tokenizer), end_id.to_bytes(4, "little"), np.zeros(0, dtype=np.int64), None
        for batch in batches:
            id_pa = batch.schema.field(0).type
            for part in slices(batch):
                ids = [x + end for x in table.encode(part.column(1))]
                n = np.bincount(np.frombuffer(b"".join(ids), dtype="<u4"))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
                none = pa.nulls(part.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shrink(x) for x in ids], pa.binary()), none, none], names)
        if id_pa is not None:
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_pa), pa.nulls(1, pa.binary()), pa.array([met], pa.list_(pa.int64())), pa.array([total[met]], pa.list_(pa.int64()))], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, ids binary, met array<bigint>, counts array<bigint>")


def shrink(ids: bytes) -> bytes:
    """Two bytes an id where all fit, with a leading byte that says so."""
    a = np.frombuffer(ids, dtype="<u4")
    return b"\2" + a.astype("<u2").tobytes() if a.max(initial=0) < 1 << 16 else b"\4" + ids


def grow(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1)


def by_frequency(tokens: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first (ties: the smaller id); at most as many as the vocabulary has."""
    each = tokens.where("met IS NOT NULL").select(F.explode(F.arrays_zip("met", "counts")).alias("x")).select("x.*")
    counts = each.groupBy(F.col("met").alias("id")).agg(F.sum("counts").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Write path/blocks and path/ranks."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    tokens = scratch.keep(tokenized(docs, tokenizer, end_id, id_col, text_col), "tokens")
    ids = by_frequency(tokens)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ids)), "id": ids.astype(np.int64)}), "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.uint32)
        rank[ids] = np.arange(len(ids), dtype=np.uint32)
        part, before, held = TaskContext.get().partitionId(), 0, []

        def block():
            control, data = encode(np.concatenate([rank[x] for _, x in held]))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "n": pa.array([sum(len(x) for _, x in held)], pa.int64()),
                "doc_ids": pa.array([[d for d, _ in held]], pa.list_(doc_id_type)), "lengths": pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
            })

        size = 0
        for batch in batches:
            doc_id_type = batch.schema.field(0).type
            for d, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((d, grow(packed.as_py())))
                size += len(held[-1][1])
                if size >= block_tokens:
                    yield block()
                    before, size, held = before + size, 0, []
        if held:
            yield block()

    ordered = tokens.where("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(blocks, f"part int, before bigint, n bigint, doc_ids array<{id_type}>, lengths array<bigint>, control binary, data binary").write.parquet(f"{path}/blocks")
    scratch.drop(tokens)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(dtype="<u4")
    stored = spark.read.parquet(f"{path}/blocks")
    id_type = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                got = ids[decode(b["control"], b["data"], b["n"])]
                ends = np.cumsum(b["lengths"])
                starts = ends - b["lengths"]
                crc = [zlib.crc32(got[s:e].tobytes()) for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([b["part"]] * len(crc), pa.int32()), pa.array(b["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(starts + b["before"], pa.int64()), pa.array(b["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = stored.mapInArrow(run, f"part int, doc_id {id_type}, at bigint, n_tokens bigint, ids_crc32 bigint")
    # One row a partition of the writer: a few thousand at most.
    parts = stored.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """write_ids() into a new folder of the shared one, and read_ids() from it."""
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, **options)
    return read_ids(docs.sparkSession, path)
