"""Benchmark decontamination: test suffixes looked up in suffix arrays over the training text.

Each slice of documents is a shard with a suffix array of its own over words, written as numbers of the test
vocabulary. A word outside that vocabulary can't be part of a match, so suffixes are kept only where enough vocabulary
words follow each other; the array is sorted by those words, and every window of the tests (the head of a
test suffix) is found in it by binary search, as a range of the array: all its locations in the shard.
Adjacent windows of one test that lie at adjacent places make up the longest verbatim matches.

The tests travel as a broadcast whose size is checked: beyond ``most_bytes`` of text they are dealt into blocks of that
size, and each block is one pass over the documents. These are written once with a number for each row; a pass writes only
what it finds, by number, and at the end what all passes found joins the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltatree.llm import arrays as A
from deltatree.session import cut_lineage

WINDOW = 10
#: Bytes of test text in one broadcast.
BLOCK_BYTES = 16 << 20

REPORT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "longest_match long, longest_item string")


class Tests:
    """The windows of a block of tests, ready for binary search."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        hashes, at = word_hashes(texts)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        bits = int(self.vocabulary.size + 1).bit_length()
        self.bits, self.per = bits, 63 // bits
        self.names = [n for n, _ in items]
        #: by length of window: sorted keys, the (item, start) places in the tests by key, and the keys' offsets into them
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        words = np.diff(at)
        lengths = np.minimum(window, words)
        for m in np.unique(lengths[lengths > 0]).tolist():
            chosen = np.flatnonzero(lengths == m)
            each = words[chosen] - m + 1
            item = np.repeat(chosen, each)
            start = np.arange(item.size) - np.repeat(np.cumsum(each) - each, each) + at[:-1][item]
            keys = self.keys(ids, start, m)
            order = np.argsort(keys, kind="stable")
            unique, first = np.unique(keys[order], return_index=True)
            self.windows[m] = (unique, np.stack([item, start], 1)[order], np.append(first, keys.size))

    def keys(self, ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """The ``m`` words from each place as one string of bytes which sorts as the words do."""
        cols = []
        for begin in range(0, m, self.per):
            key = np.zeros(at.size, np.uint64)
            for j in range(begin, min(begin + self.per, m)):
                key = (key << np.uint64(self.bits)) | ids[at + j].astype(np.uint64)
            cols.append(key.astype(">u8"))
        return np.ascontiguousarray(np.stack(cols, 1)).view(f"S{8 * len(cols)}").ravel()

    def search(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each length of window: length, places in the shard, and the windows' places in the tests."""
        if not hashes.size or not self.vocabulary.size:
            return
        found = np.minimum(np.searchsorted(self.vocabulary, hashes), self.vocabulary.size - 1)
        ids = np.where(self.vocabulary[found] == hashes, found + 1, 0)
        # how many words of the vocabulary stand from here on, within the document
        stop = np.zeros(ids.size, bool)
        stop[ids == 0] = True
        n = ids.size
        nearest = np.where(stop, np.arange(n), n)
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        ends = np.repeat(at[1:], np.diff(at))
        run = np.minimum(nearest, ends) - np.arange(n)
        for m, (keys, places, of) in self.windows.items():
            suffixes = np.flatnonzero(run >= m)
            if not suffixes.size:
                continue
            mine = self.keys(ids, suffixes, m)
            order = np.argsort(mine, kind="stable")
            array, mine = suffixes[order], mine[order]
            low, high = np.searchsorted(mine, keys, "left"), np.searchsorted(mine, keys, "right")
            hit = np.flatnonzero(high > low)
            if hit.size:
                yield m, np.concatenate([array[low[h]:high[h]] for h in hit]), [
                    places[of[h]:of[h + 1]] for h in hit for _ in range(high[h] - low[h])]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text, at = A.text_bytes(column)
    data = np.frombuffer(text.translate(A.LOWER), np.uint8)
    starts, ends, words = A.word_spans(data, at, A.LETTERED)
    return A.span_hashes(data, starts, ends), words


def _longest(starts: np.ndarray, m: int, places: list[np.ndarray]) -> tuple[int, int]:
    """Words and item of the longest verbatim match among windows of ``m`` words at ascending places of a document."""
    best, item, before = 0, -1, None
    for k, p in enumerate(starts):
        rows = places[k]
        if before is not None and p == before[0] + 1:
            old = {tuple(x): n for x, n in zip(before[1].tolist(), before[2], strict=True)}
            lengths = [old.get((i, s - 1), 0) + 1 for i, s in rows.tolist()]
        else:
            lengths = [1] * len(rows)
        top = max(lengths)
        if m + top - 1 > best:
            best, item = m + top - 1, int(rows[lengths.index(top), 0])
        before = (p, rows, lengths)
    return best, item


def _scan(column: pa.Array, tests: Tests, marks: list[bytes], items: list[list[str]], longest: list[tuple[int, str | None]]) -> np.ndarray:
    """Adds what a block of tests finds to the lists, by row; gives the number of words."""
    hashes, at = word_hashes(column)
    for m, where, places in tests.search(hashes, at):
        rows = np.searchsorted(at, where, "right") - 1
        order = np.lexsort((where, rows))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) > 0, [True]]))
        for b, e in zip(cuts, cuts[1:], strict=False):
            pick = order[b:e]
            d = int(rows[pick[0]])
            begins = where[pick] - at[d]
            marks[d] += np.stack([begins, begins + m], 1).astype(np.int64).tobytes()
            mine = [places[x] for x in pick]
            items[d] += {tests.names[i] for i in np.unique(np.concatenate(mine)[:, 0]) if tests.names[i] is not None}
            length, item = _longest(begins, m, mine)
            longest[d] = max(longest[d], (length, tests.names[item]), key=lambda x: x[0])
    return np.diff(at)


def _hits(marks: bytes, words: int) -> int:
    edge = np.frombuffer(marks, np.int64).reshape(-1, 2)
    if not edge.size:
        return 0
    depth = np.zeros(words + 1, np.int64)
    np.add.at(depth, edge[:, 0], 1)
    np.add.at(depth, edge[:, 1], -1)
    return int((np.cumsum(depth) > 0).sum())


def _blocks(benchmark: DataFrame, most_bytes: int) -> tuple[int, Callable[[int], list[tuple[str | None, str]]]]:
    """Number of blocks of about ``most_bytes`` of test text, and what reads one of them."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // most_bytes) or 1
    return blocks, lambda b: [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


#: The broadcast that this worker has made ready last, and its tests: the next task of the same pass needs them again.
_ready: list[tuple[Broadcast, Tests]] = []


def _tests(held: Broadcast) -> Tests:
    if not _ready or _ready[0][0] is not held:
        _ready[:] = [(held, Tests(*held.value))]
    return _ready[0][1]


def _annotated(docs: DataFrame, benchmark: DataFrame, window: int, most_bytes: int, finish, schema: T.StructType | str) -> DataFrame:
    """``finish(part, counts, marks, items, longest)`` over every slice of documents, after all blocks of tests."""
    spark: SparkSession = docs.sparkSession
    blocks, read = _blocks(benchmark, most_bytes)
    if blocks == 1:
        held = spark.sparkContext.broadcast((read(0), window))

        def at_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = _tests(held)
            for batch in batches:
                for part in A.slices(batch):
                    marks, found, longest = [b""] * part.num_rows, [[] for _ in range(part.num_rows)], [(0, None)] * part.num_rows
                    counts = _scan(part.column("text"), tests, marks, found, longest)
                    yield finish(part, counts, marks, found, longest)

        return docs.mapInArrow(at_once, schema)

    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("number"), row, docs["text"].alias("text")), "numbered")
    passes = []
    for block in range(blocks):
        held = spark.sparkContext.broadcast((read(block), window))

        def look_up(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tests = _tests(held)
            for batch in batches:
                for part in A.slices(batch):
                    marks, found, longest = [b""] * part.num_rows, [[] for _ in range(part.num_rows)], [(0, None)] * part.num_rows
                    _scan(part.column("text"), tests, marks, found, longest)
                    hit = [i for i, m in enumerate(marks) if m]
                    yield pa.RecordBatch.from_arrays([
                        part.column("number").take(pa.array(hit, pa.int64())), pa.array([marks[i] for i in hit], pa.binary()), pa.array([found[i] for i in hit], pa.list_(pa.string())),
                        pa.array([longest[i][0] for i in hit], pa.int64()), pa.array([longest[i][1] for i in hit], pa.string())], ["of", "marks", "items", "longest", "item"])

        passes.append(cut_lineage(numbered.select("number", "text").mapInArrow(
            look_up, "of long, marks binary, items array<string>, longest long, item string"), "found"))
        held.destroy()
    each = reduce(DataFrame.unionByName, passes).groupBy("of").agg(F.collect_list(F.struct("marks", "items", "longest", "item")).alias("found"))  # one entry a block at most

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                found = [x or [] for x in part.column("found").to_pylist()]
                _, at = word_hashes(part.column("text"))
                plain = pa.RecordBatch.from_struct_array(part.column("row"))
                yield finish(plain, np.diff(at), [b"".join(y["marks"] for y in x) for x in found], [[i for y in x for i in y["items"]] for x in found],
                             [max(((y["longest"], y["item"]) for y in x), key=lambda z: z[0], default=(0, None)) for x in found])

    return numbered.join(each, F.col("number") == F.col("of"), "left").select("row", "text", "found").mapInArrow(together, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: what of it stands in ``benchmark`` (``item_id``, ``text``).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``window`` consecutive words of
    an item, or all words of a shorter one; an item without words has none. ``n_hit`` counts the words that any occurrence
    covers, ``items_sha256`` digests the sorted, comma-joined ids of the items that occur, ``longest_match`` is the
    length in words of the longest verbatim match that holds a window.

    * A null text has no words: zeros, no match. Any length is taken whole.
    * Repeated rows of documents each give a row; repeated item_ids are one item.
    * An item with a null id hits words and contaminates, but isn't counted or listed.
    * No benchmark rows: nothing is contaminated. Other columns of either table are ignored, whatever their names.
    """
    def finish(part, counts, marks, items, longest) -> pa.RecordBatch:
        hit = [_hits(m, int(n)) for m, n in zip(marks, counts, strict=True)]
        ids = [sorted(set(x)) for x in items]
        return pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
            pa.array([x for x, _ in longest], pa.int64()), pa.array([x for _, x in longest], pa.string())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return _annotated(docs, benchmark, window, most_bytes, finish, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of ``benchmark``; all columns stay as they are."""
    def finish(part, counts, marks, items, longest) -> pa.RecordBatch:
        return part.filter(pa.array([not m for m in marks], pa.bool_()))

    return _annotated(docs, benchmark, window, most_bytes, finish, docs.schema)
