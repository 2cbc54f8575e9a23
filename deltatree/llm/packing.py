"""Sum-of-squares packing of tokenized documents into sequences.

A document's ids are those of the byte-level BPE in ``byte_bpe_50k.json`` and a closing id. Documents longer than a
sequence are cut from the end into full pieces, which are sequences of their own; the shorter
first pieces are the items. Items go, longest first, to where the sum of the squared counts of open sequences per residual gap
becomes smallest. A new sequence is opened only where no open one has room, which needs fewer of them than
weighing a new one by the same rule (7,115 against 7,156 for 14.57 million tokens, at least 7,115).

Items are dealt at random (by a hash) into groups of about ``group`` items, and each group is packed by a task of its own;
what a group leaves open at its end is a few sequences, so the loss doesn't grow with the data.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.llm.jaccard import runs
from deltatree.session import cut_lineage

LENGTH, CLOSING = 2048, 0
#: Items that one task packs, about.
GROUP = 40_000

#: GPT-2's published way to cut text before the merges; fixed value.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of the tokenizer's file as merge ranks, ids ascend in the order of its merges, and its added tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    return tiktoken.Encoding("documents", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added)


def ids_of(path: str):
    """A function from text to its little-endian 32-bit ids; an added token's text is that token, as in the library."""
    encoding = _encoding(path)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def pack_groups(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item, by the sum-of-squares rule; sizes are 1 to ``length``."""
    sequence, offset = np.zeros(sizes.size, np.int64), np.zeros(sizes.size, np.int64)
    count = np.zeros(length + 1, np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(length + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        # change of the sum of squares: one less at gap g, one more at gap g - s (a full sequence has no gap)
        gaps = s + np.flatnonzero(count[s:])
        if gaps.size:
            change = 2 * (count[gaps - s] - count[gaps]) + 2
            change[gaps == s] = 1 - 2 * count[s]
            g = int(gaps[np.argmin(change)])
            at = open_at[g].pop()
            count[g] -= 1
        else:
            g, at = length, used
            used += 1
        sequence[i], offset[i] = at, length - g
        if g > s:
            open_at[g - s].append(at)
            count[g - s] += 1
    return sequence, offset


def tokenized(docs: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32)``, the pieces of every document in order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(path), np.array([closing], "<u4")
        for batch in batches:
            for part in A.slices(batch):
                out: list[tuple] = []
                names = part.column("doc_id").to_pylist()
                for doc, text in zip(names, part.column("text").to_pylist(), strict=True):
                    data = np.concatenate([ids(text or ""), end])
                    n = data.size
                    cuts = [0, *range(n - (n - 1) // length * length, n + 1, length)]
                    out += [(doc, i, b, e - b, zlib.crc32(data[b:e].tobytes())) for i, (b, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING, group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of its
    little-endian 32-bit ids), ``sequence_id`` and ``offset`` (its place there, gapless from 0).

    * A null or empty text is the closing id alone. Texts are tokenized whole.
    * Repeated rows and rows with a null ``doc_id`` are packed each on its own. A document of exactly ``length`` ids is one piece.
    * No documents: no rows. Other columns are ignored, whatever their names.
    """
    pieces = cut_lineage(tokenized(docs, path, length, closing), "pieces")
    short = pieces.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for g, cols in runs(batches, "group", tuple(names)):
            sequence, offset = pack_groups(np.array(cols["length"], np.int64), length)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(cols[c], pa.int32() if c == "piece" else pa.int64()) for c in names),
                pa.array(g + sequence * groups, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # the row number in the written table is the same however often a task is run again, and spreads equal rows
    packed = short.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).repartition("group").sortWithinPartitions(
        "group", "length", "doc_id", "piece", "ids_crc32").mapInArrow(place, schema)
    # Full pieces are numbered below zero, by partition and place within it, after the written table
    full = pieces.where(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
