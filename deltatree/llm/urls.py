"""URL filter: prefix rules, and for the rest a ratio of two character language models.

URLs that a rule allows are accepted, those it blocks rejected. A smoothed Markov model of variable order is counted for
each of the two: the probability of a character after its context is interpolated from the longest context that was seen
down to none. A URL's score is the difference of its two log-likelihoods per character; a logistic curve that is
fitted to URLs the models haven't counted makes it a probability; the models that score then count all labelled URLs.

Counts are exact. They stand in a table keyed by n-gram, summed inside tasks, then over all tasks; so the model grows with the
URLs and no process holds it. URLs are dealt into blocks of bounded size, a block asks the table for its own distinct n-grams,
and what comes back to it is only their counts. Neither side of that join is ever broadcast, so the driver holds none of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.session import cut_lineage

#: Longest context in bytes (with its character it fits 48 bits), weight of the shorter context.
ORDER, PRIOR = 5, 3.0
#: One labelled URL in so many isn't counted until the curve is fitted.
HELD = 5
#: N-grams a task gathers before it sums them; bytes of text of a block.
BUFFER, BLOCK_BYTES = 1_000_000, A.SLICE_BYTES // 4
BINS = 400
ALLOW, BLOCK = "allow", "block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/ ? #``, lower case, and then up to ``? #``; empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of (context and character) and of (context) by order, for every character and the end of each text; and texts' offsets.

    A key holds the bytes themselves, with the order and which of the two it is above them.
    """
    text, at = A.text_bytes(column)
    n = len(at) - 1
    lengths = np.diff(at) + ORDER + 1
    edges = np.concatenate([[0], np.cumsum(lengths)])
    data = np.full(edges[-1], 2, np.int64)
    body = np.arange(len(text)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, np.diff(at))
    data[body] = np.frombuffer(text, np.uint8)
    data[edges[1:] - 1] = 3
    take = np.delete(np.arange(edges[-1]), np.concatenate([np.arange(ORDER) + e for e in edges[:-1]])) if n else np.zeros(0, np.int64)
    pairs, contexts = [], []
    before = np.zeros(take.size, np.int64)
    for o in range(ORDER + 1):
        if o:
            before |= data[take - o] << (8 * o)
        contexts.append(before | (2 * o << 48))
        pairs.append(before | data[take] | (2 * o + 1 << 48))
    return np.array(pairs), np.array(contexts), edges - np.arange(n + 1) * ORDER


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a column, ascending, and ``_grams`` as places among them."""
    pairs, contexts, at = _grams(column)
    keys, place = np.unique(np.concatenate([pairs.ravel(), contexts.ravel()]), return_inverse=True)
    return keys, *place.reshape(2, ORDER + 1, -1), at


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _numbered(column)[1:]


#: Length of arrays of counts by place for a column of few texts; longer ones have as many places as distinct keys.
SIZE = 1 << 16


def log_likelihood(pairs: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-probability of each character; ``counts`` has a row for pairs and one for contexts."""
    p = np.full(pairs.shape[1], 1 / 256)
    for o in range(ORDER + 1):
        p = (counts[0][pairs[o]] + PRIOR * p) / (counts[1][contexts[o]] + PRIOR)
    return np.log(p)


def count_models(labelled: DataFrame) -> DataFrame:
    """Counts of every n-gram over all rows ``(text, accepted, held)``: ``gram`` and ``n0`` to ``n3``, accepted and rejected, and then those held."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            keys, place = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.concatenate(counts, 1)
            return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.bincount(place, x, keys.size).astype(np.int64)) for x in n)], ["gram", "n0", "n1", "n2", "n3"])

        for batch in batches:
            for part in A.slices(batch, "text", BLOCK_BYTES):
                accepted, held = (part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("accepted", "held"))
                kind = 2 * held + ~accepted
                for k in np.unique(kind):
                    pairs, contexts, _ = _grams(part.column("text").filter(pa.array(kind == k)))
                    keys, n = np.unique(np.concatenate([pairs.ravel(), contexts.ravel()]), return_counts=True)
                    grams.append(keys)
                    counts.append(np.zeros((4, keys.size), np.int64))
                    counts[-1][k] = n
                    total += keys.size
                if total >= BUFFER:
                    yield flush()
                    grams, counts, total = [], [], 0
        if grams:
            yield flush()

    return labelled.mapInArrow(run, "gram long, n0 long, n1 long, n2 long, n3 long").groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n2", "n3")))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``block``, the number of about ``BLOCK_BYTES`` of text that stand together; written, so that it stays."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for part in A.slices(batch, "text", BLOCK_BYTES):
                more = int(A.text_bytes(part.column("text"))[1][-1])
                if size and size + more > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += more + part.num_rows
                yield part.append_column("block", pa.array(np.full(part.num_rows, block), pa.int64()))

    return cut_lineage(rows.mapInArrow(run, rows.withColumn("block", F.lit(0).cast("long")).schema), "urls")


def differences(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``d``, the accepted minus rejected log-likelihood of the text by its number of characters and the end, and ``d_held``,
    the same without the held URLs for a row that is one of them."""
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            for b in np.unique(block):
                keys = _numbered(batch.column("text").filter(pa.array(block == b)))[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, b)), pa.array(keys)], ["block", "gram"])

    def score(mine: pa.Table, found: pa.Table) -> pa.Table:
        keys, pairs, contexts, at = _numbered(mine.column("text"))
        n = np.zeros((4, keys.size))
        n[:, np.searchsorted(keys, found.column("gram").to_numpy())] = [found.column(f"n{i}").to_numpy() for i in range(4)]

        def of(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
            each = log_likelihood(pairs, contexts, np.array([accepted, accepted])) - log_likelihood(pairs, contexts, np.array([rejected, rejected]))
            total = np.concatenate([[0], np.cumsum(each)])
            return (total[at[1:]] - total[at[:-1]]) / np.diff(at)

        held = mine.column("held").to_numpy().astype(bool)
        out = mine.select(KEPT).append_column("d", pa.array(of(n[0] + n[2], n[1] + n[3])))
        return out.append_column("d_held", pa.array(of(n[0], n[1]), mask=~held))

    # Catalyst takes the n-grams of either side for smaller than the written URLs, so it would broadcast many times its threshold
    found = rows.select("block", "text").mapInArrow(ask, "block long, gram long").join(model.hint("merge"), "gram")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        score, "page_id long, host string, path string, rule string, verdict string, d double, d_held double")


KEPT = ["page_id", "host", "path", "rule", "verdict"]


def calibrate(held: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve, from counts by bin of score over all rows ``(d_held, accepted)``."""
    rows = held.groupBy(F.greatest(F.least(F.floor(F.col("d_held") * BINS / 8), F.lit(BINS)), F.lit(-BINS)).cast("int").alias("bin"), "accepted").agg(
        F.count("*").alias("n")).orderBy("bin", "accepted").toPandas()
    if rows["accepted"].nunique() < 2:
        return 4.0, 0.0
    weight = rows.groupby("accepted")["n"].transform("sum").to_numpy(np.float64)
    w = rows["n"].to_numpy(np.float64) / weight / 2  # both verdicts weigh the same
    x = np.stack([(rows["bin"].to_numpy() + 0.5) * 8 / BINS, np.ones(len(rows))], 1)
    y = np.where(rows["accepted"], 1 - 1 / (weight + 2), 1 / (weight + 2))
    beta = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (w * (p - y)) + 1e-4 * (beta - np.array([4.0, 0.0])))
        beta = beta - np.clip(step, -5, 5)
    return float(beta[0]), float(beta[1])


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score``, the probability that the URL is an accepted one.

    ``rules`` are pairs of ``allow`` or ``block`` and ``host/path``; the longest that fits decides. A URL without a rule is
    allowed if its score is ``threshold`` or more.

    * A null URL, or one without ``://``, has an empty host and path, no rule, and the score of an empty text.
    * Repeated rows each give a row and are each counted; a labelled URL is among those that score it. If no URL is accepted or none is rejected, all scores are 0.5.
    * No pages: no rows. URLs are taken whole. Other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("text"))
    rows = _in_blocks(rows.withColumn("held", F.col("verdict").isNotNull() & (F.crc32(F.col("text").cast("binary")) % HELD == 0)))
    accepted = (F.col("verdict") == ALLOW).alias("accepted")
    labelled = rows.where("verdict is not null").select("text", accepted, "held")
    there = {(r.accepted, r.held) for r in labelled.select("accepted", "held").distinct().collect()}
    if len({a for a, _ in there}) < 2:
        out = rows.select(*KEPT, F.lit(0.5).alias("score"))
    else:
        scored = cut_lineage(differences(rows, count_models(labelled)), "scores")
        # without URLs of both verdicts beside the held ones there is nothing to hold them against
        fitted = calibrate(scored.where("d_held is not null").select("d_held", accepted)) if {(True, False), (False, False)} <= there else (4.0, 0.0)
        margin = F.greatest(F.least(F.col("d") * fitted[0] + fitted[1], F.lit(30.0)), F.lit(-30.0))
        out = scored.select(*KEPT, (1 / (1 + F.exp(-margin))).alias("score"))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK)))
