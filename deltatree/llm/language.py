"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the letter n-grams (of several lengths) that both have, divided by
the root of the product of their own counts. A Nyström map over landmark texts turns it into a few hundred
features, one-versus-rest kernel ridge regression is solved in them, and texts are scored in batches by two
matrix products: presence with landmarks, then kernel values with the weights of the languages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.llm.features import fold

#: Lengths in bytes of the n-grams, and places they are hashed to.
LENGTHS, PLACES = (2, 3, 4), 1 << 13
#: Landmarks and training texts of a language, at most, and of all languages together, about: with many languages each has fewer, one at least.
LANDMARKS, EACH = 128, 800
ALL_LANDMARKS, ALL_TEXTS = 2048, 100_000
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts of one matrix product.
BATCH = 256

_LETTER = regex.compile(r"\p{L}")
#: Letters are lower-cased where they are ASCII; all bytes that aren't ASCII letters or part of another character become one blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def presence(column: pa.Array) -> np.ndarray:
    """Rows of 0 and 1, divided by the root of their number of ones: a product of two rows is the kernel."""
    text, at = A.text_bytes(column)
    data = np.frombuffer(text.translate(_FOLD), np.uint8)
    rows = len(at) - 1
    out = np.zeros((rows, PLACES), np.float32)
    owner = np.repeat(np.arange(rows), np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(data.size)
    blank = data == 0x20
    packed = np.zeros(data.size, np.uint32)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    blanks = np.concatenate([blank, np.ones(8, bool)])
    empty = np.ones(data.size, bool)
    for n in range(1, max(LENGTHS) + 1):
        packed |= wide[n - 1:n - 1 + data.size] << np.uint32(8 * (n - 1))
        empty &= blanks[n - 1:n - 1 + data.size]
        if n in LENGTHS:
            keep = (left >= n) & ~empty
            place = ((packed[keep] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
            out[owner[keep], place] = 1
    count = out.sum(1, keepdims=True)
    return out / np.sqrt(np.maximum(count, 1))


def fit(anchors: np.ndarray, rows: np.ndarray, langs: list[str], ridge: float = RIDGE) -> dict:
    """Landmark rows and, for each language, the weights of their kernel values; from rows of ``presence``."""
    names = sorted(set(langs))
    gram = anchors.astype(np.float64) @ anchors.T.astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-8 * max(1e-12, values.max())
    nystroem = vectors[:, good] / np.sqrt(values[good])  # kernel values to features
    features = (rows @ anchors.T).astype(np.float64) @ nystroem
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # every language weighs the same, however many texts it has
    weight = np.array([1 / langs.count(x) for x in langs])[:, None]
    one = np.concatenate([features, np.ones((len(features), 1))], 1)
    penalty = ridge * np.eye(one.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(one.T @ (weight * one) + penalty + 1e-12 * np.eye(len(penalty)), one.T @ (weight * target))
    return {"names": names, "anchors": anchors.T.copy(), "weights": (nystroem @ solved[:-1]).astype(np.float32), "bias": solved[-1].astype(np.float32)}


def predict(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language and its score, the softmax of the scores of all languages times four."""
    best, score = [], []
    for i in range(0, len(column), BATCH):
        values = presence(column.slice(i, BATCH)) @ model["anchors"] @ model["weights"] + model["bias"]
        odds = np.exp(4 * (values - values.max(1, keepdims=True)))
        best.append(values.argmax(1))
        score.append(odds.max(1) / odds.sum(1))
    return (np.concatenate(best), np.concatenate(score).astype(np.float64)) if best else (np.zeros(0, int), np.zeros(0))


def _sample(docs: DataFrame, folds: int, held: int, each: int) -> tuple[np.ndarray, list[str]]:
    """Rows of ``presence`` and languages of up to ``each`` texts a language, those with the smallest hashes.

    Candidates are found with a hash below a limit that the counts of the languages give, so a
    language of a third of all rows isn't sorted as one group. What is gathered is a bit for each place, not the texts.
    """
    known = docs.where("doc_id is not null and lang is not null and length(text) > 0").where(
        (F.col("lang") != UNKNOWN) & (fold(F.col("doc_id"), folds) != held)).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(41)).alias("hash"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, min(each, ALL_TEXTS // max(1, counts.count())))
    # twice as many as are wanted pass, on average
    limit = F.least(F.lit(1.0), F.lit(2.0 * each + 50) / F.col("n"))

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                rows = np.packbits(presence(part.column("text")) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("hash"), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "hash", "bits"])

    chosen = known.join(counts, "lang").where(F.pmod("hash", F.lit(1 << 30)) / F.lit(float(1 << 30)) < limit).select("lang", "hash", "text")
    rows = chosen.mapInArrow(bits, "lang string, hash long, bits binary").toPandas().sort_values(["lang", "hash"]).groupby("lang").head(each)
    ones = np.unpackbits(np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(-1, PLACES // 8), axis=1).astype(np.float32)
    return ones / np.sqrt(np.maximum(ones.sum(1, keepdims=True), 1)), rows["lang"].tolist()


def languages(docs: DataFrame, folds: int = 3, held: int = 1, each: int = EACH, landmarks: int = LANDMARKS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    Learned from text and ``lang`` of rows whose ``crc32(doc_id) mod folds`` isn't ``held``: every language, from at most ``each`` texts
    (a parameter), the first ``landmarks`` of which are landmarks. Only the text is an input of a prediction.

    * ``lang_pred`` is ``und`` with score 0 for a text that is null or has no letter, and for all if nothing could be learned.
    * A null ``doc_id`` is in no fold (``held_out`` false) and not learned from; rows with a null ``lang`` are predicted only.
    * Repeated rows each give a row; texts are taken whole. No documents: no rows. Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    rows, langs = _sample(plain, folds, held, each)
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // max(1, len(set(langs)))))
    seen: dict[str, int] = {}
    first = [i for i, x in enumerate(langs) if seen.setdefault(x, 0) < landmarks and not seen.update({x: seen[x] + 1})]
    fitted = fit(rows[first], rows, langs) if langs else None
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in A.slices(batch):
                column = part.column("text")
                lettered = np.array([bool(t and _LETTER.search(t)) for t in column.to_pylist()], bool) & (m is not None)
                best, score = predict(column, m) if m else (np.zeros(part.num_rows, int), np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array([m["names"][b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], pa.string()),
                    pa.array(np.where(lettered, score, 0.0), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return plain.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
