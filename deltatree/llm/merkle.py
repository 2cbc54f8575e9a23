"""Merkle manifest of a dataset: a ternary hash tree of each source, and one over the sources' roots.

``H`` is the lowercase hex SHA-256 of its inputs put together, digests as hex text. Leaves of a tree stand in the order of
their key; while there are several nodes, each three consecutive ones (the last run: fewer, even one) become their ``H``.

Trees are stored as aligned subtrees (blocks) of ``height`` steps, one row each. The digests of a block lie in the van Emde
Boas layout: the levels are split at half their number, the upper half is stored first, then each lower subtree, and both are
laid out by the same rule. ``address`` gives the place of a node without pointers; construction and siblings both use it. The
roots of the blocks are the leaves of the next tier, until a tier of a tree is one block.

Spark ranks the leaves by ranges (no task holds a tree), deals them out by (tree, block) and builds all blocks of a tier at once.
Paths go the other way: a tier hands each block below the siblings above it, so that every leaf needs its own block alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltatree.session import cut_lineage

FAN, WIDTH = 3, 32
#: Steps of hashing inside a block: 81 leaves, 121 digests.
HEIGHT = 4
#: Blocks of an Arrow batch that a task hands back.
BLOCKS = 64
#: A path has one part a level, from the leaf up: the digests left of the node, ``OWN`` for the node, those right of it.
OWN, LEVEL = "*", "/"


def combine(digests: bytes) -> bytes:
    """``H`` of digests put together, as bytes."""
    return hashlib.sha256(digests.hex().encode()).digest()


def tree_size(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a depth (0: the root) in a complete tree of so many levels."""
    upper = levels // 2
    if not upper:
        return np.zeros_like(index)
    if depth < upper:
        return address(upper, depth, index)
    span = FAN ** (depth - upper)
    return tree_size(upper) + index // span * tree_size(levels - upper) + address(levels - upper, depth - upper, index % span)


@lru_cache(maxsize=64)
def places(levels: int) -> tuple[tuple[int, ...], ...]:
    """Byte offsets of all nodes, by depth."""
    return tuple(tuple((address(levels, d, np.arange(FAN ** d)) * WIDTH).tolist()) for d in range(levels))


def steps(leaves: int) -> int:
    """Steps of hashing until one node is left."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FAN), n + 1
    return n


def build_block(leaves: Sequence[bytes], height: int) -> bytes:
    """The layout of a block; places without a node are zero."""
    at = places(height + 1)
    nodes = bytearray(WIDTH * tree_size(height + 1))
    for place, digest in zip(at[height], leaves, strict=False):
        nodes[place:place + WIDTH] = digest
    count = len(leaves)
    for depth in range(height - 1, -1, -1):
        below = at[depth + 1]
        for i in range(-(-count // FAN)):
            run = b"".join(nodes[p:p + WIDTH] for p in below[FAN * i:min(FAN * i + FAN, count)])
            nodes[at[depth][i]:at[depth][i] + WIDTH] = combine(run)
        count = -(-count // FAN)
    return bytes(nodes)


def block_paths(nodes: bytes, leaves: int, height: int) -> list[str]:
    """The path of each leaf of a block up to the block's root."""
    at, paths = places(height + 1), [""]
    for depth in range(1, height + 1):
        count = -(-leaves // FAN ** (height - depth))
        hexes = [nodes[p:p + WIDTH].hex() for p in at[depth][:count]]
        level = []
        for i in range(count):
            low = i - i % FAN
            part = "".join(hexes[low:i]) + OWN + "".join(hexes[i + 1:low + FAN])
            level.append(part + (LEVEL + paths[i // FAN] if depth > 1 else ""))
        paths = level
    return paths


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path give."""
    for level in path.split(LEVEL) if path else ():
        leaf = hashlib.sha256(level.replace(OWN, leaf).encode()).hexdigest()
    return leaf


def siblings(path: str) -> str:
    """All digests of a path, level by level, left to right."""
    return path.replace(OWN, "").replace(LEVEL, "")


def framed(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 bytes' count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _ranked(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with ``at``, the place within the tree (from 0, by key, digest), and ``total``, the tree's leaves.

    Rows are sorted by ranges and numbered inside each range while they are written; the rows of the ranges before are added. Equal
    rows are told apart by their place in the input, so a range never has to hold all of them.
    """
    held = cut_lineage(rows, "merkle-leaves").withColumn("tie", F.monotonically_increasing_id())

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, done = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column("tree").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(trees[1:] != trees[:-1]) + 1])
            at = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.concatenate([starts, [batch.num_rows]])))
            if batch.column("tree")[0].as_py() == now:
                at[:starts[1] if starts.size > 1 else None] += done
            now, done = batch.column("tree")[batch.num_rows - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("tree", "key", "digest", "changed")), pa.array(at, pa.int64()), pa.array(np.full(batch.num_rows, part), pa.int32())],
                ["tree", "key", "digest", "changed", "at", "part"])

    schema = f"tree {dict(rows.dtypes)['tree']}, key {dict(rows.dtypes)['key']}, digest binary, changed binary, at long, part int"
    keys = ["tree", "key", "digest"]
    numbered = cut_lineage(held.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys).mapInArrow(number, schema), kind)
    whole = Window.partitionBy("tree")
    parts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("tree").alias("of"), F.col("part").alias("range"), F.sum("rows").over(whole).alias("total"),
        F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(parts, F.col("tree").eqNullSafe(F.col("of")) & (F.col("part") == F.col("range"))).select(
        "tree", "key", "digest", "changed", (F.col("at") + F.col("before")).alias("at"), "total")


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """One row per block: ``tree``, ``block``, ``leaves``, ``total`` (of the tier), ``steps``, ``nodes`` (the layout), ``digest`` (the
    block's root), and the leaves' ``keys`` and ``changed`` digests."""
    span = FAN ** height
    kinds = dict(rows.dtypes)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part in _whole_blocks(batches, span):
            total, at = part["total"][0].as_py(), part["at"][0].as_py()
            high = min(height, steps(total))
            nodes = build_block(part["digest"].to_pylist(), high)
            out.append((part["tree"][0].as_py(), at // span, part.num_rows, total, high, nodes, nodes[:WIDTH], part["key"].to_pylist(), part["changed"].to_pylist()))
            if len(out) == BLOCKS:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    key = kinds["key"]
    schema = f"tree {kinds['tree']}, block long, leaves int, total long, steps int, nodes binary, digest binary, keys array<{key}>, changed array<binary>"
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    types = [arrow[kinds["tree"]], pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(arrow[key]), pa.list_(pa.binary())]
    names = ["tree", "block", "leaves", "total", "steps", "nodes", "digest", "keys", "changed"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.withColumn("block", F.floor(F.col("at") / span)).repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(build, schema)


def _whole_blocks(batches: Iterable[pa.RecordBatch], span: int) -> Iterator[pa.Table]:
    """The rows of one block at a time, of a stream sorted by block and place: a block begins where ``at`` is a multiple of ``span``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not table.num_rows:
            continue
        starts = np.flatnonzero(table["at"].to_numpy() % span == 0).tolist()
        for low, high in zip(starts, starts[1:], strict=False):
            yield table.slice(low, high - low)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def forest(rows: DataFrame, height: int = HEIGHT, kind: str = "merkle") -> list[DataFrame]:
    """Tiers of blocks, lowest first, for rows ``(tree, key, digest, changed)``; every tier is a written table.

    A tree ends in the tier where its ``total`` fits into one block, whose ``digest`` is its root.
    """
    span = FAN ** height
    tiers = [cut_lineage(_blocks(_ranked(rows, f"{kind}-ranks"), height), f"{kind}-blocks")]
    while (tiers[-1].agg(F.max("total")).first()[0] or 0) > span:
        roots = tiers[-1].where(F.col("total") > span).select(
            "tree", F.col("block").alias("key"), "digest", F.lit(None).cast("binary").alias("changed"), F.col("block").alias("at"),
            F.ceil(F.col("total") / span).alias("total"))
        tiers.append(cut_lineage(_blocks(roots, height), f"{kind}-blocks"))
    return tiers


def forest_roots(tiers: Sequence[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``(tree, digest)`` of every tree."""
    tops = [t.where(F.col("total") <= FAN ** height).select("tree", "digest") for t in tiers]
    return reduce(DataFrame.unionByName, tops)


def _handed(tier: DataFrame, given: DataFrame) -> DataFrame:
    """Blocks with ``above``, the path from their root on, and ``carried``, what their tree has besides."""
    right = given.select(F.col("tree").alias("of"), F.col("block").alias("place"), "above", "carried")
    return tier.join(right, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("place"))).drop("of", "place")


def _paths_of(nodes: bytes, leaves: int, height: int, above: str) -> list[str]:
    return [LEVEL.join(p for p in (path, above) if p) for path in block_paths(nodes, leaves, height)]


def descend(tiers: Sequence[DataFrame], given: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest tier's blocks, each with ``above`` and ``carried``; ``given`` has both for the root of every ``tree``."""
    span = FAN ** height
    schema = f"tree {dict(tiers[0].dtypes)['tree']}, block long, above string, carried string"

    def hand_down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, block, leaves, high, nodes, above, carried = (batch.column(c)[row].as_py() for c in (
                    "tree", "block", "leaves", "steps", "nodes", "above", "carried"))
                paths = _paths_of(nodes, leaves, high, above)
                yield pa.RecordBatch.from_arrays([
                    pa.array([tree] * leaves, batch.schema.field("tree").type), pa.array(np.arange(leaves) + block * span, pa.int64()),
                    pa.array(paths, pa.string()), pa.array([carried] * leaves, pa.string())], ["tree", "block", "above", "carried"])

    handed = None
    for i in range(len(tiers) - 1, -1, -1):
        here = given.select("tree", F.lit(0).cast("long").alias("block"), "above", "carried")
        if len(tiers) > 1:  # a tree is handed its own where it is one block
            tops = tiers[i].where(F.col("total") <= span).select(F.col("tree").alias("top"))
            here = here.join(tops, F.col("tree").eqNullSafe(F.col("top")), "left_semi")
        if handed is not None:
            here = here.unionByName(handed)
        blocks = _handed(tiers[i], here)
        if i:
            handed = cut_lineage(blocks.mapInArrow(hand_down, schema), "merkle-paths")
    return blocks


@dataclass(frozen=True)
class Manifest:
    """``tiers``: the blocks of all sources' trees; ``crown``: those of the tree over the subroots; ``root``: its hex digest, or None."""

    tiers: list[DataFrame]
    crown: list[DataFrame]
    root: str | None
    height: int


def manifest(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of ``documents``.

    * A leaf is ``H`` of doc_id, source, lang, n_chars and text, framed; nulls are ``-``, empty texts ``0:``. Texts are hashed whole.
    * Null sources are a tree of their own, first of all. Leaves without a ``doc_id`` come first; of one ``doc_id`` the smaller digest
      comes first, so repeated rows are leaves of their own. No documents: no blocks and no root. Other columns don't count.
    """
    doc_id, head = F.col("doc_id").cast("long"), [framed(F.col(c)) for c in ("source", "lang", "n_chars")]
    tampered = (F.crc32(doc_id.cast("string")) % 2 == 0) & (F.instr("text", "\n") > 0)
    rows = docs.select(
        F.col("source").cast("string").alias("tree"), doc_id.alias("key"), digest_of(framed(doc_id), *head, framed(F.col("text"))).alias("digest"),
        F.when(tampered, digest_of(framed(doc_id), *head, framed(F.replace("text", F.lit("\n"), F.lit(""))))).alias("changed"))
    tiers = forest(rows, height)
    subroots = forest_roots(tiers, height).select(F.lit(0).alias("tree"), F.col("tree").alias("key"), "digest", F.lit(None).cast("binary").alias("changed"))
    crown = forest(subroots, height, "merkle-crown")
    top = crown[-1].select("digest").first()
    return Manifest(tiers, crown, top and bytes(top[0]).hex(), height)


def _each_leaf(tier: DataFrame, of: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    """``of(keys, leaves, subroot, paths, changed)`` of every block of a tier that ``descend`` gave, as columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                leaves, high, nodes, above, carried, changed = (batch.column(c)[row].as_py() for c in (
                    "leaves", "steps", "nodes", "above", "carried", "changed"))
                own = [nodes[p:p + WIDTH].hex() for p in places(high + 1)[high][:leaves]]
                yield pa.RecordBatch.from_arrays(of(
                    batch.column("keys")[row].values, own, carried, _paths_of(nodes, leaves, high, above), [c and c.hex() for c in changed]), names)

    return tier.mapInArrow(run, schema)


def _text(values: Iterable[str | None]) -> pa.Array:
    return pa.array(list(values), pa.string())


def _documents(made: Manifest) -> DataFrame:
    """The lowest blocks of all sources, each with the path from its root to the dataset's and its source's subroot."""
    spark = made.tiers[0].sparkSession
    start = spark.range(1).select(F.col("id").cast("int").alias("tree"), F.lit("").alias("above"), F.lit("").alias("carried"))
    given = _each_leaf(descend(made.crown, start, made.height), lambda keys, own, _, paths, __: [keys, _text(paths), _text(own)],
                       "tree string, above string, carried string")
    return descend(made.tiers, cut_lineage(given, "merkle-subroots"), made.height)


def proofs(made: Manifest) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``path`` (its levels joined by ``/``, ``*`` for the node itself) and ``changed``, the leaf
    of the tampered document where tampering changes it."""
    root = made.root
    return _each_leaf(_documents(made), lambda keys, own, subroot, paths, changed: [
        keys, _text(own), _text([subroot] * len(own)), _text([root] * len(own)), _text(paths), _text(changed),
    ], "doc_id long, leaf string, subroot string, root string, path string, changed string")


def verified(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (``H`` of its siblings), ``folded_root`` (from the
    tampered, else original, leaf) and ``verified``. Cases as in ``manifest``; a document without siblings has ``H`` of nothing."""
    made = manifest(docs, height)
    root = made.root

    def check(keys: pa.Array, own: list[str], subroot: str, paths: list[str], changed: list[str | None]) -> list[pa.Array]:
        folded = [fold(c or o, p) for c, o, p in zip(changed, own, paths, strict=True)]
        proof = [hashlib.sha256(siblings(p).encode()).hexdigest() for p in paths]
        return [keys, _text(own), _text([subroot] * len(own)), _text([root] * len(own)), _text(proof), _text(folded), pa.array([f == root for f in folded])]

    return _each_leaf(_documents(made), check,
                      "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
