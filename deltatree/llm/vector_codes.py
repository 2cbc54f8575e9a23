"""Product codes of vectors, trained and assigned in exact whole numbers.

A component ``x`` becomes ``floor(1024 x)``, a vector four parts. Distances come from matrix products: ``|x|^2 - 2 x.c + |c|^2``. BLAS
multiplies float64, which is exact below 2^53 only, so whole numbers are split into limbs of ``w`` bits where ``2 w`` and the bits of
a part's length make 53 at most; each product of limbs is exact, and they are put together with shifts in int64. The first smallest
distance is the code. Where a squared distance could pass int64, Python's whole numbers do the same.

A round is one scan: tasks assign their vectors and send sums by entry (in two halves of 32 bits, so that no sum overflows),
Spark adds them, and the next codebook, which has at most ``entries`` rows whatever the number of vectors, comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole numbers beyond are refused: they don't fit a long.
LARGEST = 1 << 62
#: Products of floating numbers below are exact.
EXACT_BITS = 53
#: Numbers of the matrix of distances that a task holds at a time.
CELLS = 1 << 20


def limb_width(length: int) -> int:
    """Bits of a limb, so that a sum of ``length`` products of limbs stays below 2^53."""
    return (EXACT_BITS - max(length, 1).bit_length()) // 2


def limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """Whole numbers as float64 limbs of ``width`` bits, lowest first; all but the last are not negative."""
    out = []
    while True:
        if -(1 << width) < values.min(initial=0) and values.max(initial=0) < 1 << width:
            return [*out, values.astype(np.float64)]
        out.append((values & ((1 << width) - 1)).astype(np.float64))
        values = values >> width


def dot_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c.T`` of int64 matrices, exact as long as it fits."""
    width = limb_width(x.shape[1])
    out = np.zeros((x.shape[0], c.shape[0]), np.int64)
    right = limbs(c, width)
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (width * (i + j))
    return out


def largest(*arrays: np.ndarray) -> int:
    return max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``c``, the first of equal ones, and the squared distance, for each row of ``x``."""
    if 4 * max(1, x.shape[1]) * largest(x, c) ** 2 >= 1 << 63:  # Python's whole numbers
        wide, book = x.astype(object), c.astype(object)
        distance = (wide * wide).sum(1)[:, None] - 2 * (wide @ book.T) + (book * book).sum(1)[None, :]
        code = np.array([min(range(len(row)), key=row.__getitem__) for row in distance.tolist()], np.int64)
    else:
        distance = (x * x).sum(1)[:, None] - 2 * dot_products(x, c) + (c * c).sum(1)[None, :]
        code = distance.argmin(1)
    return code, distance[np.arange(len(x)), code]


def whole_numbers(column: pa.Array) -> np.ndarray:
    """``floor(1024 x)`` of a list column without nulls or values that are not finite, as an int64 matrix."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if lengths.size > 1 or (lengths.size and lengths[0] % PARTS):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}; found {lengths.tolist()[:5]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size and np.abs(flat).max() >= LARGEST / SCALE:
        raise ValueError(f"a component is {LARGEST // SCALE} or more in size: its whole number doesn't fit a long")
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector and components are neither null nor NaN nor infinite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.select(F.col("vec_id").cast("long"), "embedding", "label").where(F.col("embedding").isNotNull() & finite)


def _assigned(batches: Iterable[pa.RecordBatch], book: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Slices of batches with their whole numbers, codes (rows x parts) and distances by part."""
    step = max(1, CELLS // max(1, book.shape[1]))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            x = whole_numbers(part.column("embedding"))
            if x.shape[1] != PARTS * book.shape[2]:
                raise ValueError(f"vectors must have one length; found {x.shape[1]} and {PARTS * book.shape[2]}")
            found = [nearest(p, c) for p, c in zip(np.split(x, PARTS, axis=1), book, strict=True)]
            yield part, x, np.stack([code for code, _ in found], 1), [distance for _, distance in found]


def first_codebooks(kept: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """Parts x entries x part's length: the parts of the smallest ``vec_id`` (nulls last, of equal ones the smaller vector)."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    column = first.column(0).combine_chunks()
    x = whole_numbers(column if isinstance(column, pa.Array) else column.chunk(0)) if first.num_rows else np.zeros((0, 0), np.int64)
    return np.stack(np.split(x, PARTS, axis=1)) if x.size else np.zeros((PARTS, x.shape[0], x.shape[1] // PARTS), np.int64)


def next_codebooks(kept: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every used entry is the floor of the mean of its parts."""
    parts, entries, length = book.shape
    cells = parts * entries

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = np.zeros(cells, np.int64), np.zeros((cells, length), np.int64), np.zeros((cells, length), np.int64)
        for _, x, codes, _ in _assigned(batches, book):
            for p, values in enumerate(np.split(x, parts, axis=1)):
                order = np.argsort(codes[:, p], kind="stable")
                used, begin = np.unique(codes[order, p], return_index=True)
                count[p * entries + used] += np.diff([*begin, len(order)])
                low[p * entries + used] += np.add.reduceat(values[order] & 0xFFFFFFFF, begin, axis=0)
                high[p * entries + used] += np.add.reduceat(values[order] >> 32, begin, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([used * (length + 1) + i for i in range(length + 1)])),
            pa.array(np.concatenate([count[used], low[used].T.ravel()])), pa.array(np.concatenate([np.zeros(used.size, np.int64), high[used].T.ravel()])),
        ], ["place", "low", "high"])

    added = kept.mapInArrow(sums, "place long, low long, high long").groupBy("place").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    total = {r.place: r.low + (r.high << 32) for r in added.toLocalIterator()}
    new = book.copy()
    for cell in range(cells):
        if n := total.get(cell * (length + 1)):
            new[cell // entries, cell % entries] = [total[cell * (length + 1) + 1 + i] // n for i in range(length)]
    return new


def train(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    book = first_codebooks(kept, entries)
    for _ in range(rounds if book.size else 0):
        book = next_codebooks(kept, book)
    return book


def codebooks_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(kept: DataFrame, book: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits for each part) and ``error``, the squared distances summed over the parts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, codes, distances in _assigned(batches, book):
            error = [sum(map(int, d)) for d in zip(*distances, strict=True)]
            if max(error) >= 1 << 63:
                raise ValueError("a squared distance doesn't fit a long")
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]), pa.array(error, pa.int64()),
            ], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {dict(kept.dtypes)['label']}, code string, error long")


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    * A null vector, or one with a component that is null or not finite, gives no row. Vectors of several lengths, or of one that is no
      multiple of four, are refused, and so are components of 2^52 or more and distances beyond a long. Empty vectors have distance 0 and code 0.
    * Null labels are one group. Repeated rows and rows without a ``vec_id`` are vectors of their own; the latter come last for the first codebook.
    * Fewer vectors than ``entries`` (256 at most, two hex digits): a smaller codebook. No vectors: no rows. Other columns don't count.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"entries must be 1 to {ENTRIES}")
    kept = kept_vectors(vectors)
    book = train(kept, entries, rounds)
    coded = cut_lineage(encode(kept, book), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(book)).alias("codebooks_sha256"))
