"""Candidate statistics of a workload and which queries they can affect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scores import candidate_id


def generate(predicates: DataFrame, positions: DataFrame, mechanisms: Sequence[str] = ("mcv", "fd")) -> DataFrame:
    """relation, mechanism, c1, c2, p1, p2: column pairs that occur together in a query.

    positions: relation, column, position. A query has few columns, so the self join of its
    columns stays small whatever the table.
    """
    placed = predicates.select("query_id", "relation", "column").distinct().join(positions, ["relation", "column"])
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.relation") == F.col("b.relation")) & (F.col("a.position") < F.col("b.position")))
    return (
        pairs.select(
            F.col("a.relation").alias("relation"), F.col("a.column").alias("c1"), F.col("b.column").alias("c2"),
            F.col("a.position").alias("p1"), F.col("b.position").alias("p2"),
        )
        .distinct()
        .withColumn("mechanism", F.explode(F.array(*map(F.lit, mechanisms))))
    )


def _order() -> list:
    return [F.when(F.col("mechanism") == "mcv", 0).otherwise(1), F.col("p1"), F.col("p2"), F.col("c1"), F.col("c2")]


def ranked(candidates: DataFrame, cap: int | None = None) -> DataFrame:
    """candidates with id and precedence rank from 0; at most cap a relation, cut before ranking."""
    if cap is not None:
        own = Window.partitionBy("relation").orderBy(*_order())
        candidates = candidates.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= cap).drop("_n")
    # A catalog has thousands of candidates at most; one window orders them all.
    everything = Window.orderBy("relation", *_order())
    return candidates.select(
        candidate_id(F.col("relation"), F.col("mechanism"), F.array("c1", "c2")).alias("candidate_id"),
        "relation", "mechanism", "c1", "c2",
        (F.row_number().over(everything) - 1).alias("precedence_rank"),
    )


def incidence(candidates: DataFrame, inspection: DataFrame) -> DataFrame:
    """candidate_id, query_id, reason: queries that a candidate may affect. None is missed."""
    columns = inspection.select("query_id", "relation", "mode", F.array_distinct(F.transform("leaves", lambda x: x["column"])).alias("cols"))
    both = F.array_contains("cols", F.col("c1")) & F.array_contains("cols", F.col("c2"))
    fallback = F.col("mode") == "conservative-fallback"
    return candidates.join(columns, "relation").where(fallback | both).select(
        "candidate_id", "query_id", F.when(fallback, "fallback").otherwise("columns").alias("reason")
    )


def affected(edges: DataFrame, candidate_ids: Sequence[str]) -> DataFrame:
    """Queries that a move of these candidates may affect (two of them for a swap)."""
    return edges.where(F.col("candidate_id").isin(list(candidate_ids))).select("query_id").distinct()


def diversity(edges: DataFrame) -> DataFrame:
    """queries, candidates, pairs with shared queries and their mean Jaccard similarity."""
    sizes = edges.groupBy("candidate_id").agg(F.countDistinct("query_id").alias("size"))
    sized = edges.select("candidate_id", "query_id").distinct().join(sizes, "candidate_id")
    a, b = sized.alias("a"), sized.alias("b")
    shared = (
        a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.candidate_id") < F.col("b.candidate_id")))
        .groupBy(F.col("a.candidate_id").alias("x"), F.col("b.candidate_id").alias("y"))
        .agg(F.count("*").alias("both"), F.first("a.size").alias("sx"), F.first("b.size").alias("sy"))
    )
    similarity = F.col("both") / (F.col("sx") + F.col("sy") - F.col("both"))
    pairs = shared.agg(F.count("*").alias("overlapping_pairs"), F.avg(similarity).alias("mean_jaccard")).withColumn("_k", F.lit(1))
    whole = edges.agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("candidate_id").alias("candidates")).withColumn("_k", F.lit(1))
    return whole.join(pairs, "_k").drop("_k")


def duplicate_incidence(edges: DataFrame) -> DataFrame:
    """candidates: groups of candidates that affect exactly the same queries."""
    signature = edges.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("query_id")), ",").alias("queries"))
    groups = signature.groupBy("queries").agg(F.array_join(F.array_sort(F.collect_list("candidate_id")), ",").alias("candidates"), F.count("*").alias("n"))
    return groups.where("n > 1").select("queries", "candidates", "n")
