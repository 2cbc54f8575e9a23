"""Hashed n-gram indicators of texts, and the labelled sample that a classifier is fitted on."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A

_SPREAD = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Grams:
    """Which n-grams count, hashed to ``2 ** bits`` places for each kind.

    ``chars``: lengths in bytes, 1 to 4, upper and lower case apart. ``words``: lengths in
    words between white space. ``repeats``: an n-gram of that many words which occurs
    again in the text, and the share of such words in eighths, as places of their own.
    """

    chars: tuple[int, ...] = (1, 2, 3)
    words: tuple[int, ...] = (1, 2)
    bits: int = 16
    repeats: int = 5

    @property
    def size(self) -> int:
        return (len(self.chars) + len(self.words)) * (1 << self.bits) + 9

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The distinct places of each text; a null or empty text has none."""
        text, at = A.text_bytes(column)
        data = np.frombuffer(text, np.uint8)
        shift, step = np.uint32(32 - self.bits), 1 << self.bits
        wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        kinds: list[tuple[np.ndarray, np.ndarray, int]] = []
        packed = np.zeros(data.size, np.uint32)
        for n in range(1, max(self.chars, default=0) + 1):
            packed |= wide[n - 1:n - 1 + data.size] << np.uint32(8 * (n - 1))
            if n in self.chars:
                kinds.append((((packed + np.uint32(n)) * _SPREAD) >> shift, at, n))
        starts, ends, words = A.word_spans(data, at, A.SPACED)
        hashes = A.span_hashes(data, starts, ends)
        for n in self.words:
            kinds.append(((A.rolling(hashes, n) >> np.uint64(64 - self.bits)).astype(np.uint32), words, n))
        for number, (places, _, _) in enumerate(kinds):
            places += np.uint32(number * step)
        fives = A.rolling(hashes, self.repeats)
        stamp = np.zeros(self.size, np.int32)
        for d in range(len(at) - 1):
            mine = [p[of[d]:max(of[d], of[d + 1] - n + 1)] for p, of, n in kinds]
            held = words[d + 1] - words[d]
            if held:
                again = np.array([self.size - 9 + repeated_words(fives[words[d]:words[d + 1]], self.repeats) * 8 // held], np.uint32)
                mine.append(again)
            joined = np.concatenate(mine) if mine else np.zeros(0, np.uint32)
            order = np.arange(joined.size, dtype=np.int32)
            stamp[joined] = order  # the last writer of a place is the one that stays
            yield joined[stamp[joined] == order]


def repeated_words(rolled: np.ndarray, k: int) -> int:
    """Words inside ``k``-word windows that are found twice or more; ``rolled`` has a hash for each word of the text."""
    n = rolled.size - k + 1
    if n < 2:
        return 0
    order = np.argsort(rolled[:n], kind="stable")
    same = np.flatnonzero(np.diff(rolled[:n][order]) == 0)
    if not same.size:
        return 0
    edge = np.zeros(rolled.size + 1, np.int32)
    twice = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge[twice] += 1
    edge[twice + k] -= 1
    return int((np.cumsum(edge) > 0).sum())


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """Rows ``(doc_id, label)``: one per labelled id; rows with nulls go, ids labelled both ways count as 0."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy(
        "doc_id").agg(F.min("label").alias("label"))


def sample(docs: DataFrame, marks: DataFrame, each: int, grams: Grams) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Places and labels of about ``each`` labelled texts a class, and the share of label 1 among all of ``marks``.

    The ``each`` ids of a class with the smallest hashes are chosen, so the sample is the same whatever
    the partitions. Two bounds hold: ``2 * each`` ids, and two texts for an id with several.
    """
    share = marks.agg(F.avg("label")).first()[0]
    if share is None:
        return [], np.zeros(0), 0.5
    order = F.xxhash64("doc_id", F.lit(29))
    picked = None
    for value in (0, 1):
        part = marks.where(F.col("label") == value).orderBy(order, "doc_id").limit(each)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                places = [p.tobytes() for p in grams.of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(places, pa.binary())],
                                                 ["doc_id", "label", "places"])

    rows = docs.select("doc_id", "text").join(picked, "doc_id").mapInArrow(run, "doc_id long, label int, places binary").groupBy(
        "doc_id", "label").agg(F.array_distinct(F.array(F.min("places"), F.max("places"))).alias("places")).select(
        "doc_id", "label", F.explode("places").alias("places")).orderBy("doc_id", "places").toPandas()
    return [np.frombuffer(b, np.uint32).astype(np.intp) for b in rows["places"]], rows["label"].to_numpy(np.float64), float(share)


def platt(margins: np.ndarray, labels: np.ndarray, share: float, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins; rows are weighted to the share of label 1 outside the sample."""
    ones = labels > 0
    if not ones.any() or ones.all():
        return 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    weight = np.where(ones, share / ones.sum(), (1 - share) / (~ones).sum())
    weight = weight / weight.sum()
    # smoothed targets, so that separable margins don't give an infinite slope
    target = np.where(ones, (ones.sum() + 1) / (ones.sum() + 2), 1 / ((~ones).sum() + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-6 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def probability(margin: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
