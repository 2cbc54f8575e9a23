"""Merkle manifest: against a plain tree, all cases of the layout, and cases of rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from deltatree.llm import merkle as M

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The root of digests, and for each the levels of its path as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            low = p - p % 3
            paths[i].append((nodes[low:p], nodes[p + 1:low + 3]))
            at[i] = p // 3
        nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """The expected rows, sorted."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s], key=lambda x: x[:3]),) for s in order}
    trees = {s: (rows, *plain_tree([x[2] for x in rows])) for s, (rows,) in trees.items()}
    root, crown = plain_tree([trees[s][1] for s in order])
    out = []
    for s, above in zip(order, crown, strict=True):
        for (_, _, leaf, r), path in zip(trees[s][0], trees[s][2], strict=True):
            levels = path + above
            text = r[1].replace("\n", "") if r[0] is not None and r[1] and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf_of(r[0], text, *r[2:])
            for left, right in levels:
                node = H(*left, node, *right)
            out.append((r[0], leaf, trees[s][1], root, H(*(x for left, right in levels for x in left + right)), node, node == root))
    return sorted(out, key=repr)


def made(n, sources, seed=1, hot=0.3):
    rng = random.Random(seed)
    texts = ["", None, "one\ntwo", "é\n漢", "plain", "x" * 5000 + "\n"]
    return [(i, rng.choice(texts), rng.choice([None, "en"]), "hot" if rng.random() < hot else rng.choice(sources), rng.choice([None, i]))
            for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("height", [1, 4])
def test_against_plain_tree(spark, height):
    rows = made(700, [None, "", "a", "B", "é", "z", "src10", "src9"])
    got = M.verified(spark.createDataFrame(rows, SCHEMA).repartition(5), height).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert {r.verified for r in got} == {True, False}


def test_small_trees(spark):
    sizes = [1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 82]
    rows = [(1000 * n + i, f"t{i}\n", "en", f"s{n}", 1) for n in sizes for i in range(n)]
    got = M.verified(spark.createDataFrame(rows, SCHEMA).repartition(3), 2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    one = [(7, "t\n", "en", "s", 1)]
    assert [tuple(r) for r in M.verified(spark.createDataFrame(one, SCHEMA)).collect()] == plain(one)


def test_ties_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "a", "en", "s", 1)] * 40 + [(1, "b\n", "en", "s", 1), (None, "n\n", None, None, None), (None, None, None, None, None), (2, "", None, "t", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS at", "'x' AS digest", "3 AS total", "4 AS block")
    got = M.verified(docs.repartition(4), 1).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.verified(empty).collect() == [] and M.manifest(empty).root is None


def test_many_sources(spark):
    rows = [(i, "t", "en", f"host{i}", 1) for i in range(300)]
    got = M.verified(spark.createDataFrame(rows, SCHEMA).repartition(3), 2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout(levels):
    """Every place is taken once; an aligned subtree of half the height lies in one piece."""
    places = [M.address(levels, d, np.arange(3 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(M.tree_size(levels)))
    upper = levels // 2
    if upper:
        for top in range(3 ** upper):
            below = np.concatenate([M.address(levels, d, np.arange(top * 3 ** (d - upper), (top + 1) * 3 ** (d - upper))) for d in range(upper, levels)])
            assert np.ptp(below) == below.size - 1


def test_paths_and_stored_blocks(spark):
    rows = made(400, ["a", "b"], seed=3)
    manifest = M.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), 2)
    assert len(manifest.tiers) >= 3
    for r in M.proofs(manifest).collect():
        assert M.fold(r.leaf, r.path) == r.root == manifest.root
    for tier in manifest.tiers:
        for b in tier.collect():
            assert len(b.nodes) == M.WIDTH * M.tree_size(b.steps + 1) and b.nodes[:M.WIDTH] == b.digest and b.leaves == len(b["keys"])
