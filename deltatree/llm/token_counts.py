"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut at the tokenizer's added tokens and then by its published pattern. The bytes of a piece are symbols in a linked
list; a heap holds the adjacent pairs that have a rank. The pair of lowest rank, the leftmost of equal ones, is popped
and merged again and again, and the count is the initial symbols minus the merges. No identifiers are emitted.

Every piece is worked out on its own, so a task needs the text at hand, the merges, and the counts of pieces seen before,
which are forgotten when they are many. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from deltatree.llm import arrays as A

#: Pieces whose counts a task remembers, in two generations of so many, and their longest.
REMEMBERED, SHORT = 200_000, 64

#: GPT-2's published way to cut text before the merges; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged_count(symbols: bytes, ranks: dict[int, int]) -> int:
    """Symbols left after all merges. Symbol ``256 + r`` is what the pair of rank ``r`` becomes; a pair is ``left << 32 | right``.

    An entry of the heap is ``rank << 32 | place`` of a pair's left symbol. One that a merge has changed since is passed over: its
    left symbol is gone, or the pair at its place has another rank by now.
    """
    at, n = list(symbols), len(symbols)
    rank_of = ranks.get
    heap = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(at[i] << 32 | at[i + 1])) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    left_of, right_of = list(range(-1, n - 1)), list(range(1, n + 1))
    pop, push, merges = heapq.heappop, heapq.heappush, 0
    while heap:
        least = pop(heap)
        rank, i = least >> 32, least & 0xFFFFFFFF
        j = right_of[i]
        if at[i] < 0 or j >= n or rank_of(at[i] << 32 | at[j]) != rank:
            continue
        merged = at[i] = 256 + rank
        at[j] = -1
        merges += 1
        after = right_of[i] = right_of[j]
        before = left_of[i]
        if after < n:
            left_of[after] = i
            if (new := rank_of(merged << 32 | at[after])) is not None:
                push(heap, new << 32 | i)
        if before >= 0 and (new := rank_of(at[before] << 32 | merged)) is not None:
            push(heap, new << 32 | before)
    return n - merges


@dataclass
class Counting:
    """The merges of a tokenizer's file and what a task remembers."""

    ranks: dict[int, int]
    added: regex.Pattern | None
    pattern: regex.Pattern = field(default_factory=lambda: regex.compile(PATTERN))
    known: dict[str, int] = field(default_factory=dict)
    older: dict[str, int] = field(default_factory=dict)

    def piece(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = self.older.get(piece) or merged_count(piece.encode(), self.ranks)
            if len(piece) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[piece] = count
        return count

    def text(self, text: str) -> int:
        """Tokens of a whole text; an added token in it counts one."""
        parts = self.added.split(text) if self.added else [text]
        total = len(parts) - 1
        for part in parts:
            total += sum(map(self.piece, self.pattern.findall(part)))
        return total


@lru_cache(maxsize=2)
def counting(path: str) -> Counting:
    """What the file says; a file with another kind of pre-tokenizer or model is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take more than their own text")
    symbol = byte_symbols()
    ranks: dict[int, int] = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ranks[symbol[left] << 32 | symbol[right]] = rank
        symbol[left + right] = 256 + rank
    tokens = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return Counting(ranks, regex.compile("|".join(map(regex.escape, tokens))) if tokens else None)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    * A null or empty text has no bytes and no tokens. Texts are counted whole, without begin, end or padding.
    * Repeated rows and rows with a null ``doc_id`` are counted each on its own. No documents: no rows. Other columns don't count.
    * ``path`` is read in every task, so each machine has the tokenizer's file.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counting(path).text
        for batch in batches:
            for part in A.slices(batch):
                _, at = A.text_bytes(part.column("text"))
                tokens = np.array([count(t or "") for t in part.column("text").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
