"""Seeded random orders and draws, equal on every engine with 64-bit whole numbers.

The order of a permutation and the index of a bootstrap draw come from a hash of
(seed and key, replicate, position). They need no state, so replicates can be
spread over tasks and recomputed after a lost executor with the same result. A
key's replicates are computed as one matrix in numpy; ``hash_sql`` is the same
hash as SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 20260915
PERMUTATIONS = 10_000
BOOTSTRAPS = 1_000
#: Replicates of a key that one row of work stands for.
BLOCK = 2_500
#: Numbers of a replicate matrix that are held at a time.
CELLS = 1 << 20

_MASK = (1 << 31) - 1
_REPLICATE, _POSITION, _FIRST, _SECOND = 668265263, 374761393, 0x2C1B3C6D, 0x297A2D39


def key_number(seed: int, key: str) -> int:
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16) & _MASK


def _mix(x):
    x = x ^ (x >> 15)
    x = (x * _FIRST) & _MASK
    x = x ^ (x >> 12)
    x = (x * _SECOND) & _MASK
    return x ^ (x >> 15)


def hashes(number: int, replicates: np.ndarray, n: int) -> np.ndarray:
    """31-bit hashes, a row for each replicate and a column for each of ``n`` positions."""
    rows = _mix(number ^ ((replicates.astype(np.int64) * _REPLICATE) & _MASK))
    return _mix(rows[:, None] ^ ((np.arange(n, dtype=np.int64) * _POSITION) & _MASK)[None, :])


def orders(number: int, replicates: np.ndarray, n: int) -> np.ndarray:
    """The positions of each replicate in its order; equal hashes keep their positions' order."""
    return np.argsort((hashes(number, replicates, n) << 20) | np.arange(n), axis=1)


def draws(number: int, replicates: np.ndarray, n: int) -> np.ndarray:
    """``n`` positions a replicate, with replacement."""
    return hashes(number, replicates, n) % n


def _mix_sql(x: str) -> str:
    for shift, factor in ((15, _FIRST), (12, _SECOND)):
        x = f"((xor({x}, ({x}) >> {shift}) * {factor}) & {_MASK})"
    return f"xor({x}, ({x}) >> 15)"


def row_sql(key: str, replicate: str, seed: int = SEED) -> str:
    """The part of the hash that a replicate of a key shares, as SQL."""
    number = f"(CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT) & {_MASK})"
    return _mix_sql(f"xor({number}, ({replicate} * {_REPLICATE}) & {_MASK})")


def position_sql(row: str, position: str) -> str:
    """The hash at a position, from ``row_sql``."""
    return _mix_sql(f"xor({row}, ({position} * {_POSITION}) & {_MASK})")


def count_extremes(df: DataFrame, keys: Sequence[str], count: int, compute: Callable[[dict, np.ndarray], np.ndarray],
                   schema: str, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``compute(row, replicates)`` for all replicates of every row, as rows of ``keys`` and ``schema`` (one column).

    A row here holds one key's series, bounded by the observation window. Blocks of
    replicates are rows of their own and dealt to ``spark.sql.shuffle.partitions`` tasks, so that a few
    keys still use the whole cluster; a key takes some hundredths of a second.
    """
    if count < 100:
        raise ValueError(f"at least 100 replicates are needed: {count}")
    blocks = -(-count // block)
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(width, "_key", "_block")
    name = schema.split()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked: list[int] = []
            values: list = []
            for i, row in enumerate(batch.to_pylist()):
                row["_number"] = key_number(seed, row["_key"])
                first, last = row["_block"] * block, min(count, (row["_block"] + 1) * block)
                step = max(1, CELLS // max(1, row["_size"]))
                for b in range(first, last, step):
                    found = np.atleast_1d(compute(row, np.arange(b, min(b + step, last))))
                    picked += [i] * len(found)
                    values += found.tolist()
            plain = batch.select(list(keys)).take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(values, out_type)], [*keys, name])

    out = T.StructType([df.schema[k] for k in keys]).add(*schema.split())
    out_type = {"long": pa.int64(), "double": pa.float64()}[schema.split()[1]]
    return spread.mapInArrow(run, out)
