"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.session import remove_scratch, scratch_path


def _write(df: DataFrame, paths: list[str]) -> DataFrame:
    path = scratch_path(df.sparkSession, "edges")
    df.write.parquet(path)
    paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame, larger: bool, paths: list[str]) -> DataFrame:
    """Each node's larger (or smaller) neighbours, linked with its smallest neighbour.

    The smallest neighbour is an aggregate with partial sums, so a node with very
    many neighbours isn't gathered. It is written, so that both sides of the join back are
    plain exchanges and AQE can split such a node there.
    """
    if larger:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = _write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), paths)
    linked = both.join(lowest, "a").select(F.col("b").alias("x"), "root", "a")
    if larger:
        out = linked.where("x > a").select(F.col("x").alias("a"), F.col("root").alias("b"))
    else:
        out = linked.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("root").alias("b")), F.struct("a", F.col("root").alias("b")))).alias("e")).select("e.*")
    return out.where("a <> b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour, and none if it is one itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("child")), F.struct(F.col("b").alias("node"), F.lit(0).alias("child")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.child").alias("up"), F.min("e.child").alias("low"))
    return not nodes.where("up > 1 or (up = 1 and low = 0)").limit(1).count()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)``: ``root`` is the smallest node that is linked with ``node``, over any number of links.

    Only nodes that have an edge to another node appear; repeated edges, loops and
    edges with a null end are no matter. Works for any type with an order. Large and small
    stars alternate until every component is a star, which takes a number of rounds in the
    logarithm of the component's size; every round is written to the shared folder.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    paths: list[str] = []
    now = _write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), paths)
    for _ in range(rounds):
        if _are_stars(now):
            break
        large = _write(_stars(now, True, paths), paths)
        now = _write(_stars(large, False, paths).distinct(), paths)
        remove_scratch(edges.sparkSession, paths[:-1])  # nothing reads the rounds before
        del paths[:-1]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
