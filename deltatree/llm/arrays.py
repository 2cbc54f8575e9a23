"""Text of Arrow batches as byte arrays: word spans, 64-bit hashes and shingles, without a Python loop per word.

All classes of word used here are byte classes of UTF-8: every byte of a character
beyond ASCII is 0x80 or more, so spans of bytes are spans of characters. A null text is an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; temporaries are about 40 bytes for each.
SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, applied to text whose A-Z are lower case
LETTERED = np.zeros(256, bool)
LETTERED[0x30:0x3A] = LETTERED[0x61:0x7B] = LETTERED[0x80:] = True

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words which spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if _powers[which].size < n:
        steps = np.full(max(n, SLICE_BYTES + 1), _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def _strings(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A string column without nulls, and the len + 1 offsets into its buffer of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1] or bytes(8), np.int64 if wide else np.int32)
    return column, at[column.offset:column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The joined UTF-8 bytes of a string column and the len + 1 offsets into them."""
    column, at = _strings(column)
    data = column.buffers()[2]
    if data is None or not len(column):
        return b"", np.zeros(len(column) + 1, np.int64)
    return memoryview(data)[at[0]:at[-1]].tobytes(), at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text; at least one row each."""
    _, at = _strings(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in bytes, and the len + 1 offsets of documents into the words."""
    n = data.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begin[cuts] = inside[cuts]
    finish[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(starts.size, np.uint64)
    done = 0
    while done < starts.size:
        base = int(starts[done])
        upto = int(np.searchsorted(ends, base + SLICE_BYTES, "right"))
        if upto <= done:  # one word longer than a slice
            word = data[base:int(ends[done])].tobytes()
            out[done] = mix(np.array([zlib.crc32(word) << 32 | zlib.adler32(word)], np.uint64))[0]
            done += 1
            continue
        part = data[base:int(ends[upto - 1])]
        total = np.zeros(part.size + 1, np.uint64)
        np.cumsum(_BYTE[part] * _power("up", part.size), out=total[1:])
        s, e = starts[done:upto] - base, ends[done:upto] - base
        out[done:upto] = (total[e] - total[s]) * _power("down", part.size)[s]
        done = upto
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words within a document, and the documents' offsets into them.

    A document of fewer than ``k`` words, but not none, has its whole sequence as one.
    """
    words = np.diff(offsets)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    if not hashes.size:
        return np.zeros(0, np.uint64), at
    rolled = rolling(hashes, k)
    keep = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(offsets[:-1], count)
    out = rolled[keep]
    for d in np.flatnonzero((words > 0) & (words < k)):
        h = np.array([words[d]], np.uint64)
        for w in range(offsets[d], offsets[d + 1]):
            h = mix(h * _MIX1 + hashes[w:w + 1])
        out[at[d]] = h[0]
    return out, at


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """An order-dependent hash of the ``k`` words from each position on; the last ones run over the end."""
    h = np.zeros(hashes.size, np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        h = h * _MIX2 + padded[j:j + hashes.size]
        h ^= h >> np.uint64(29)
    return mix(h)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each first byte of a character."""
    return (data & 0xC0) != 0x80
