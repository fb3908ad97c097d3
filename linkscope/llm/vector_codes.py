"""Compression of vectors to short codes: codebooks of integer k-means over parts of the vectors.

Each component x becomes floor(SCALE * x); a vector is cut into PARTS equal parts, and each part
gets the number of the nearest of ENTRIES entries of its codebook. Everything is in integers, so
the result does not depend on the order of rows or the cut into tasks.

Nearest entries by partial-distance search: the dimensions of a part are taken in descending order
of the variance of its codebook; an entry's distance is added up one dimension after the other for
all vectors at once, and a mask drops the vectors whose sum strictly exceeds the best complete
distance so far. Entries that tie with the best run to the end, and the lower number wins.

Spark deals the rows; a task keeps one batch and sums of PARTS * ENTRIES entries. The driver gets
the sums of all tasks by a grouped sum: PARTS * ENTRIES * (components of a part) numbers a round, whatever
the input. Sums travel in limbs of 31 bits, so that no sum overflows.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are left out, as
are those whose length is not the one that most rows with a length of PARTS, 2 * PARTS, ... have
(the longer of equally frequent ones). Repeated ids and rows are rows of their own; the first
codebook takes rows by id (null last), then by vector. With fewer than ENTRIES rows the codebooks
have as many entries as rows. Distances beyond a long are given as the largest long. An empty table
gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMB = 31
LARGEST = 2**63 - 1
#: Components below this in size have distances that fit int64 for up to 1,024 components a part.
SMALL = 2**25
#: Labels beyond this number are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Rows of a batch that are worked on at a time.
BLOCK = 16_384


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and floor(SCALE * x) of their components: int64 where all are small, else Python's integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # null becomes NaN
    fine = np.isfinite(x).all(axis=1)
    rows, x = rows[fine], x[fine]
    with np.errstate(over="ignore"):
        scaled = x * SCALE
    if len(x) == 0 or np.abs(scaled).max() < SMALL:
        return rows, np.floor(scaled).astype(np.int64)
    exact = np.empty(x.shape, dtype=object)
    for at in np.ndindex(*x.shape):
        up, down = float(x[at]).as_integer_ratio()
        exact[at] = SCALE * up // down
    return rows, exact


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of vectors the number of its nearest entry, and the squared distance."""
    if vectors.dtype != object and book.dtype == object:
        vectors = vectors.astype(object)
    if vectors.dtype == object and book.dtype != object:
        book = book.astype(object)
    n = len(book)
    spread = n * (book * book).sum(axis=0) - book.sum(axis=0) ** 2  # the variance times n squared
    order = sorted(range(book.shape[1]), key=lambda d: (-spread[d], d))
    columns = [np.ascontiguousarray(vectors[:, d]) for d in order]
    best = np.zeros(len(vectors), dtype=vectors.dtype)
    for d, column in zip(order, columns):
        best += (column - book[0, d]) ** 2
    chosen = np.zeros(len(vectors), dtype=np.int64)
    for entry in range(1, n):
        alive = None  # all
        total = (columns[0] - book[entry, order[0]]) ** 2
        for d, column in zip(order[1:], columns[1:]):
            left = np.flatnonzero(total <= (best if alive is None else best[alive]))
            if len(left) < 0.75 * len(total):
                alive = left if alive is None else alive[left]
                total = total[left]
            total = total + ((column if alive is None else column[alive]) - book[entry, d]) ** 2
        if alive is None:
            alive = np.arange(len(vectors))
        nearer = total < best[alive]
        best[alive[nearer]] = total[nearer]
        chosen[alive[nearer]] = entry
    return chosen, best


def assigned(matrix: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its place, its columns of the matrix, the entries and the distances."""
    width = matrix.shape[1] // len(books)
    for part, book in enumerate(books):
        own = matrix[:, part * width : (part + 1) * width]
        yield part, own, *nearest(own, book)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) with value = sum of limb << (LIMB * place); the last limb has the sign."""
    place = 0
    while value not in (0, -1):
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    if value:
        yield place, -1


def dimension(vectors: DataFrame, vector: Column) -> int | None:
    """The most frequent length of vectors that PARTS divides."""
    sized = vectors.select(F.size(vector).alias("n")).where((F.col("n") > 0) & (F.col("n") % PARTS == 0))
    top = sized.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return top[0].n if top else None


def first_books(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> list[np.ndarray]:
    """The parts of the first ENTRIES kept rows."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    firsts = vectors.select(F.col(id_col).alias("i"), v.cast("array<double>").alias("v")).where((F.size(v) == dim) & fine)
    got = firsts.orderBy(F.asc_nulls_last("i"), "v").limit(ENTRIES).collect()
    if not got:
        return []
    _, matrix = integers(pa.array([r.v for r in got], pa.list_(pa.float64())), dim)
    return [matrix[:, p * dim // PARTS : (p + 1) * dim // PARTS] for p in range(PARTS)]


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def refined(vectors: DataFrame, vector_col: str, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of its parts."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # ENTRIES vectors in all

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, width = sent.value, dim // PARTS
        # Column `width` counts.
        total = [[[0] * (width + 1) for _ in book] for book in books]
        for batch in blocks(batches):
            _, matrix = integers(batch.column(0), dim)
            for part, own, entry, _ in assigned(matrix, books):
                counts = np.bincount(entry, minlength=len(books[part]))
                for e in np.flatnonzero(counts):
                    row, mine = total[part][e], own[entry == e].sum(axis=0)
                    for d in range(width):
                        row[d] += int(mine[d])
                    row[width] += int(counts[e])
        out = [(part, e, d, place, limb) for part, rows in enumerate(total) for e, row in enumerate(rows) for d, value in enumerate(row) for place, limb in limbs(value)]
        names = ["part", "entry", "d", "place", "limb"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    found = vectors.select(vector_col).mapInArrow(sums, "part int, entry int, d int, place int, limb long").groupBy("part", "entry", "d", "place").agg(F.sum("limb").alias("limb")).collect()
    width, total = dim // PARTS, {}
    for r in found:
        total[r.part, r.entry, r.d] = total.get((r.part, r.entry, r.d), 0) + (r.limb << (LIMB * r.place))
    out = []
    for part, book in enumerate(books):
        rows = []
        for e in range(len(book)):
            n = total.get((part, e, width), 0)
            rows.append([total.get((part, e, d), 0) // n if n else int(book[e, d]) for d in range(width)])
        small = all(abs(x) < SMALL for row in rows for x in row)
        out.append(np.array(rows, dtype=np.int64 if small else object))
    return out


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[list[np.ndarray], int | None]:
    """Codebooks, one array (entries x components) a part, and the vectors' length; none for no rows."""
    dim = dimension(vectors, F.col(vector_col))
    books = first_books(vectors, dim, id_col, vector_col) if dim else []
    for _ in range(ROUNDS if books else 0):
        books = refined(vectors, vector_col, books, dim)
    return books, dim


def encode(vectors: DataFrame, books: list[np.ndarray], dim: int | None, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns of keep, the code (two hex digits a part) and the error of each kept row."""
    fixed = list(dict.fromkeys([id_col, *keep]))
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in fixed) + ", code string, error long"
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows, matrix = integers(batch.column(len(fixed)), dim)
            codes, error = np.zeros((len(rows), PARTS), dtype=np.uint8), 0
            for part, _, entry, distance in assigned(matrix, sent.value):
                codes[:, part] = entry
                error = error + distance
            shown = codes.tobytes().hex()
            error = [min(int(x), LARGEST) for x in error] if len(rows) else []
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*own.columns[: len(fixed)], pa.array([shown[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(rows))], pa.string()), pa.array(error, pa.int64())], [*fixed, "code", "error"])

    return vectors.select(*fixed, F.col(vector_col).alias("coded_vector")).mapInArrow(run, schema)


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error, the errors of equal labels summed (nulls together).

    A label may hold most rows: sums are made before any shuffle, and as few rows as labels go
    back, by broadcast up to BROADCAST_LABELS and by a join that Spark splits where it is skewed
    beyond that.
    """
    sums = coded.groupBy(F.col(label_col).alias("_of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    sums = sums.select("_of", F.least("_sum", F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col(label_col).eqNullSafe(F.col("_of"))).drop("_of")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each kept row; the codes are written once, in the shared folder."""
    books, dim = fit(vectors, id_col, vector_col)
    scratch = Scratch(vectors.sparkSession, "codes")
    coded = scratch.keep(encode(vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector")), books, dim, "_id", "_vector", ("_label",)), "coded")
    out = label_errors(coded, "_label")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
