"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Hang each vertex's neighbours on its smallest neighbour (large: the larger ones only)."""
    if large:
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # from the larger end only
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.table(pairs.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")), "least")
    if large:
        moved = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        joined = pairs.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """a, b: long vertices joined by an edge -> node, component (its smallest vertex).

    Vertices without an edge are not returned. Each step is a table in the shared folder;
    no step holds a vertex's neighbours together.
    """
    current = scratch.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    last = None
    for _ in range(rounds):
        large = scratch.table(_star(current, True, scratch), "large")
        current = scratch.table(_star(large, False, scratch), "small")
        # For a finished forest of stars neither step changes an edge.
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not converge")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
