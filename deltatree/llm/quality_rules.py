"""Quality rules: counts with fixed limits, and a calibrated logistic regression on hashed word and character n-grams.

The regression is fitted on labelled quality rows by AdaGrad steps, the margins of rows that a model hasn't seen are
calibrated to probabilities, and texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.llm import features as X

GRAMS = X.Grams(chars=(3, 4), words=(1, 2), bits=16, repeats=5)
#: Labelled ids of a class that the regression is fitted on.
EACH = 1000
#: A text is kept at this probability of label 1.
THRESHOLD = 0.3
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
REPORT = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, quality double"


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of every text."""
    text, at = A.text_bytes(column)
    data = np.frombuffer(text, np.uint8)
    starts, ends, words = A.word_spans(data, at, A.SPACED)
    rolled = A.rolling(A.span_hashes(data, starts, ends), REPEAT_WINDOW)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])

    n = len(at) - 1
    twice = np.array([X.repeated_words(rolled[words[d]:words[d + 1]], REPEAT_WINDOW) for d in range(n)], np.int64)
    lines = np.array([_repeated_lines(text[at[d]:at[d + 1]]) for d in range(n)], np.int64)
    return dict(zip(COUNTS, (np.diff(words), per_text(A.SPACED[data] & A.code_points(data)), per_text(SYMBOL[data]), lines, twice), strict=True))


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")]
    return len(lines) - len(set(lines))


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def logistic(rows: list[np.ndarray], labels: np.ndarray, size: int, epochs: int = 6, rate: float = 0.5, decay: float = 1e-5, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and offset over rows of indicators at length 1; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, seen, b, seen_b = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8
    ones = max(1e-9, labels.mean())
    weight = np.where(labels > 0, 0.5 / ones, 0.5 / max(1e-9, 1 - ones))
    for _ in range(epochs):
        for i in rng.permutation(labels.size):
            r = rows[i]
            unit = 1 / max(1.0, r.size) ** 0.5
            p = 1 / (1 + np.exp(-np.clip(float(w[r].sum()) * unit + b, -30, 30)))
            g = weight[i] * (p - labels[i])
            step = g * unit + decay * w[r]
            seen[r] += step * step
            w[r] -= rate * step / np.sqrt(seen[r])
            seen_b += g * g
            b -= rate * g / seen_b ** 0.5
    return w, b


def margins(rows: Iterable[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    return np.array([float(w[r].sum()) / max(1.0, r.size) ** 0.5 + b for r in rows])


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, size: int, folds: int = 3) -> dict:
    """The model as plain arrays; without both labels every text gets the share of label 1."""
    if len(set(labels.tolist())) < 2:
        return {"w": np.zeros(size, np.float32), "b": 0.0, "curve": X.platt(np.zeros(len(labels)), labels, share)}
    out, part = np.zeros(labels.size), np.arange(labels.size) % folds
    for f in range(folds):
        held = np.flatnonzero(part == f)
        out[held] = margins([rows[i] for i in held], *logistic([rows[i] for i in np.flatnonzero(part != f)], labels[part != f], size))
    w, b = logistic(rows, labels, size)
    return {"w": w.astype(np.float32), "b": b, "curve": X.platt(out, labels, share)}


def _model(docs: DataFrame, labels: DataFrame, each: int, grams: X.Grams):
    marks = X.labelled(labels.withColumn("doc_id", F.col("doc_id").cast("long")), "quality")
    rows, y, share = X.sample(docs.withColumn("doc_id", F.col("doc_id").cast("long")), marks, each, grams)
    return docs.sparkSession.sparkContext.broadcast(fit(rows, y, share, grams.size))


def _verdicts(column: pa.Array, m: dict, grams: X.Grams, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    c = counts(column)
    failed = base_failed(c)
    quality = X.probability(margins(grams.of(column), m["w"], m["b"]), *m["curve"])
    return c, failed, ~failed & (quality >= threshold), quality


def quality_report(docs: DataFrame, labels: DataFrame, each: int = EACH, grams: X.Grams = GRAMS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``kept`` and ``quality`` (the probability of label 1).

    Words are ``[^\\x20\\x09-\\x0D]+``. ``n_dup_lines`` counts lines with a word that equal an earlier line of the text,
    ``n_repeat_words`` the words inside five-word windows found twice or more. ``kept`` is false below ten words, beyond
    20 % of repeated words, and below ``threshold``. ``labels``: ``doc_id``, ``quality``; at most
    ``2 * each`` labelled ids are learned from (a parameter).

    * A null text counts as an empty one: zeros, ``base_failed``. Texts are taken whole, whatever their length.
    * Repeated rows each give a row, a null ``doc_id`` too. Ids labelled both ways count as 0, other
      labels are left out; without any label of one class the rules alone decide, unless the share is under ``threshold``.
    * No documents: no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = _model(docs, labels, each, grams)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                c, failed, kept, quality = _verdicts(part.column("text"), model.value, grams, threshold)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *(pa.array(c[x], pa.int64()) for x in COUNTS), pa.array(failed), pa.array(kept), pa.array(quality, pa.float64())],
                    ["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    return docs.mapInArrow(run, REPORT)


def keep_quality(docs: DataFrame, labels: DataFrame, each: int = EACH, grams: X.Grams = GRAMS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that ``quality_report`` doesn't keep; all columns stay as they are."""
    model = _model(docs.select("doc_id", "text"), labels, each, grams)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                yield part.filter(pa.array(_verdicts(part.column("text"), model.value, grams, threshold)[2]))

    return docs.mapInArrow(run, docs.schema)
