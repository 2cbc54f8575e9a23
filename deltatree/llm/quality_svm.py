"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators are scaled by the log-count ratios of the two classes, a linear model with a squared hinge loss is fitted to
the scaled rows by dual coordinate descent, and margins of rows that a model hasn't seen are calibrated to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.llm import features as X

GRAMS = X.Grams()
#: Labelled ids of a class that the model is fitted on.
EACH = 1500
THRESHOLD = 0.3


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log of the share of an indicator among indicators of label 1 rows, over that among label 0 rows."""
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == v] or [np.zeros(0, np.uint32)]), minlength=size) + alpha
              for v in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and offset of the squared hinge loss; a row is its indicators times ``scale``, at length 1, and a constant."""
    rng = np.random.default_rng(seed)
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())]) / max(1, y.size)
    soft = 1 / (2 * cost * np.where(y > 0, share[0], share[1]) * 2)  # both classes weigh the same
    values = [scale[r] / max(1e-9, np.linalg.norm(scale[r])) for r in rows]
    norm = np.array([float((v * v).sum()) + 1 for v in values])
    w, b, alpha = np.zeros(scale.size), 0.0, np.zeros(y.size)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(y.size):
            g = y[i] * (float((w[rows[i]] * values[i]).sum()) + b) - 1 + soft[i] * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(0.0, alpha[i] - g / (norm[i] + soft[i]))
            step = (new - alpha[i]) * y[i]
            most = max(most, abs(step))
            w[rows[i]] += step * values[i]
            b += step
            alpha[i] = new
        if most < 1e-3:
            break
    return w, b


def margins(rows: Iterable[np.ndarray], scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """``w`` holds weight times scale; a row is divided by its length."""
    square = scale * scale
    return np.array([float(w[r].sum()) / max(1e-9, float(square[r].sum()) ** 0.5) + b for r in rows])


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, size: int, folds: int = 3) -> dict:
    """The model as plain arrays; without both labels every text gets the share of label 1."""
    if len(set(labels.tolist())) < 2:
        return {"scale": np.zeros(size, np.float32), "w": np.zeros(size, np.float32), "b": 0.0, "curve": X.platt(np.zeros(len(labels)), labels, share)}

    def model(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        mine = [rows[i] for i in pick]
        scale = log_count_ratio(mine, labels[pick], size)
        w, b = dual_coordinate_descent(mine, labels[pick], scale)
        return scale, w * scale, b

    out = np.zeros(labels.size)
    part = np.arange(labels.size) % folds
    for f in range(folds):
        if len(set(labels[part != f].tolist())) < 2:
            continue
        held = np.flatnonzero(part == f)
        out[held] = margins([rows[i] for i in held], *model(np.flatnonzero(part != f)))
    scale, w, b = model(np.arange(labels.size))
    return {"scale": scale.astype(np.float32), "w": w.astype(np.float32), "b": b, "curve": X.platt(out, labels, share)}


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, each: int = EACH, grams: X.Grams = GRAMS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 is likelier), ``predicted``.

    ``labels`` has ``doc_id`` and ``quality``; rows whose ``crc32(doc_id) mod folds`` is ``held`` are never learned from.
    Only the text is an input of a score. The model is fitted on at most ``2 * each`` labelled ids (a parameter); the
    share of label 1 is that of all labelled rows outside the fold.

    * A null or empty text is scored too: it has no indicators. Texts are taken whole.
    * A null ``doc_id`` is in no fold (``held_out`` false) and has no label. Repeated rows each give a row.
    * Ids labelled both ways count as 0, labels other than 0 and 1 are left out. Without any label of
      one class every text gets the same score. No documents: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marks = X.labelled(labels.withColumn("doc_id", F.col("doc_id").cast("long")), "quality").where(X.fold(F.col("doc_id"), folds) != held)
    rows, y, share = X.sample(docs, marks, each, grams)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, y, share, grams.size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in A.slices(batch):
                score = X.probability(margins(grams.of(part.column("text")), m["scale"], m["w"], m["b"]), *m["curve"])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"])

    return docs.withColumn("held_out", F.coalesce(X.fold(F.col("doc_id"), folds) == held, F.lit(False))).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
