"""Vector codes against plain whole-number code, limbs against Python's numbers, and cases of rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from deltatree.llm import vector_codes as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def plain(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = len(kept[0][1]) // 4
    raw = {id(k): v for k, v in zip(kept, (r[1] for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), strict=True)}
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, raw[id(k)]))[:entries]
    books = [[k[1][p * d:(p + 1) * d] for k in first] for p in range(4)]

    def assign(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                part = v[p * d:(p + 1) * d]
                groups.setdefault(assign(part, books[p])[1], []).append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    out, total = [], {}
    for i, v, label in kept:
        found = [assign(v[p * d:(p + 1) * d], books[p]) for p in range(4)]
        error = sum(f[0] for f in found)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in out), key=repr)


def run(spark, rows, **more):
    got = V.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS code", "2 AS error", "3 AS place"), **more)
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(n, size=8, seed=1, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(size)] for _ in range(7)]
    return [(i, [c + r.gauss(0, scale / 5) for c in r.choice(centres)], r.choice([None, 1, 2])) for i in r.sample(range(5 * n), n)]


def test_against_plain_code(spark):
    rows = vectors(400)
    assert run(spark, rows, entries=16) == plain(rows, 16)


def test_fewer_vectors_than_entries_and_ties(spark):
    rows = vectors(30) + [(1000 + i, [0.5] * 8, 1) for i in range(300)] + [(5000, [0.5] * 8, 9)] * 40
    assert run(spark, rows) == plain(rows)
    few = [(1, [0.25, -0.25, 1.0, 2.0], None), (2, [0.0, 0.0, 0.0, -0.0001], 3)]
    assert run(spark, few) == plain(few)


def test_dropped_rows_and_missing_ids(spark):
    bad = [(1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (3, [math.nan, 1.0, 1.0, 1.0], 1), (4, [1.0, 1.0, -math.inf, 1.0], None)]
    good = [(None, [1.0, 2.0, 3.0, 4.0], None), (None, [0.0, 2.0, 3.0, 4.0], 1), (7, [1.0, 2.0, 3.0, 4.0], None), (7, [1.0, 2.0, 3.0, 5.0], None)]
    assert run(spark, bad + good, entries=3) == plain(bad + good, 3)
    assert run(spark, bad) == [] and run(spark, []) == []
    assert run(spark, [(1, [], None), (2, [], 1)])[0][1:4] == ("00000000", 0, 0)


@pytest.mark.parametrize("scale", [1e3, 1e5, 1e8])
def test_large_components(spark, scale):
    """One limb, several, and Python's whole numbers where int64 is too small."""
    rows = vectors(60, 4, 2, scale) if scale < 1e8 else [(i, [x * 1e-3 + 2.0 ** 40 for x in v], label) for i, v, label in vectors(60, 4, 2, 1e3)]
    assert run(spark, rows, entries=5) == plain(rows, 5)


def test_refused(spark):
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e300] * 4, 1)]):
        with pytest.raises(Exception, match="one length|fit a long"):
            run(spark, rows)


@pytest.mark.parametrize("bits", [5, 24, 26, 28])
def test_limbs_are_exact(bits):
    r = np.random.default_rng(bits)
    x, c = (r.integers(-(1 << bits), 1 << bits, (n, 16)) for n in (50, 30))
    x[0], c[0] = (1 << bits) - 1, -(1 << bits)
    assert (V.dot_products(x, c) == (x.astype(object) @ c.T.astype(object))).all()
    width = V.limb_width(16)
    assert 2 * width + 4 <= 53
    assert (sum(a.astype(np.int64) << (width * i) for i, a in enumerate(V.limbs(x, width))) == x).all()
    code, distance = V.nearest(x, c)
    want = ((x[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(2)
    assert (distance == want.min(1)).all() and [int(k) for k in code] == [row.index(min(row)) for row in want.tolist()]
