"""Connected components by randomised contraction, over edge tables of any key type."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds

#: Edges that one task joins by itself; a larger graph is contracted first.
ONE_TASK = 200_000


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of all ends of the edges (a, b)."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(parent, pa.int64()), pa.array([root(v) for v in parent], pa.int64())], ["v", "root"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = ONE_TASK) -> DataFrame:
    """``vertex`` and ``component`` (its least reachable vertex) of every vertex with an edge.

    Vertices are numbered, and each round every vertex goes over to the one of
    its closed neighbourhood whose number hashes lowest in that round; edges
    within a group vanish.  Each round leaves at most three quarters of the
    vertices on average, whatever the graph, so rounds follow the logarithm of
    the size and all rounds together cost as much as a few.  Once ``one_task``
    edges or fewer are left, one task joins them.  Rounds are tables in the
    shared folder; only their sizes come to the driver.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark)
    pairs = rounds.keep(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    # Written once, so that every reader sees the same numbers.
    names = rounds.keep(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("vertex"), F.monotonically_increasing_id().alias("v")))
    numbered = pairs.join(names.select(F.col("vertex").alias("a"), F.col("v").alias("x")), "a").join(names.select(F.col("vertex").alias("b"), F.col("v").alias("y")), "b")
    graph = rounds.keep(_plain(numbered, "x", "y"))
    moves: list[DataFrame] = []
    while (left := graph.count()) > one_task:
        both = graph.union(graph.select("b", "a"))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        move = rounds.keep(both.groupBy(F.col("a").alias("v")).agg(F.min(ranked("b")).alias("near")).select("v", F.least("near", ranked("v"))["x"].alias("root")))
        moves.append(move)
        moved = graph.join(move.select(F.col("v").alias("a"), F.col("root").alias("x")), "a").join(move.select(F.col("v").alias("b"), F.col("root").alias("y")), "b")
        nxt = rounds.keep(_plain(moved, "x", "y"))
        rounds.drop(graph)
        graph = nxt
    if left:
        moves.append(graph.coalesce(1).mapInArrow(union_find, "v long, root long"))
    labels = None
    for move in reversed(moves):
        if labels is not None:
            further = labels.select(F.col("v").alias("root"), F.col("root").alias("end"))
            move = rounds.keep(move.join(further, "root", "left").select("v", F.coalesce("end", "root").alias("root")))
        labels = move
    by_number = names if labels is None else names.join(labels, "v", "left")
    rooted = by_number.select("vertex", F.col("v") if labels is None else F.coalesce("root", "v").alias("root")).toDF("vertex", "root")
    least = rooted.groupBy("root").agg(F.min("vertex").alias("component"))
    found = rounds.keep(rooted.join(least, "root").select("vertex", "component"))
    rounds.only(found)
    return found


def _plain(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct edges (a < b)."""
    return frame.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()
