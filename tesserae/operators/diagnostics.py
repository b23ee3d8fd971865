"""Where errors come from and how candidates, lists and rankings relate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composition(df: DataFrame, order: Sequence[Column], k: int, by: str) -> DataFrame:
    """What the first k rows are made of."""
    return df.orderBy(*order).limit(k).groupBy(by).agg(F.count("*").alias("n"))


def column_use(predicates: DataFrame) -> DataFrame:
    """columns, queries: how many queries use a column, or two columns together."""
    own = predicates.select("query_id", "column").distinct()
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.column") < F.col("b.column")))
    both = pairs.select(F.col("a.query_id").alias("query_id"), F.concat_ws(",", "a.column", "b.column").alias("columns"))
    return own.select("query_id", F.col("column").alias("columns")).unionByName(both).groupBy("columns").agg(F.count("*").alias("queries"))


def constant_use(predicates: DataFrame) -> DataFrame:
    return predicates.groupBy("column", "value").agg(F.countDistinct("query_id").alias("queries"))


def constant_places(constants: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """In which of two MCV lists a workload's constants are."""
    flags = constants.select("column", "value").distinct()
    for side, name in ((left, "_l"), (right, "_r")):
        flags = flags.join(side.select("column", "value", F.lit(True).alias(name)), ["column", "value"], "left")
    place = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left-only").when(F.col("_r"), "right-only").otherwise("neither")
    return flags.select("column", "value", place.alias("place"))


def list_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, added, removed: an MCV list's values under two targets."""
    lists = lambda d, n: d.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias(n))
    both = lists(before, "b").join(lists(after, "a"), "column", "full")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    return both.select("column", F.array_join(F.array_except(a, b), ",").alias("added"), F.array_join(F.array_except(b, a), ",").alias("removed"))


def twin_candidates(candidates: DataFrame) -> DataFrame:
    """Column pairs for which both mechanisms are candidates."""
    return candidates.groupBy("relation", "c1", "c2").agg(F.countDistinct("mechanism").alias("mechanisms")).where("mechanisms > 1")


def explicit(wanted: DataFrame, positions: DataFrame) -> DataFrame:
    """A user's candidates (relation, mechanism, a, b) with their columns in table order.

    Candidates with unknown or equal columns are not returned.
    """
    at = lambda n: positions.select("relation", F.col("column").alias(n), F.col("position").alias(f"p_{n}"))
    placed = wanted.join(at("a"), ["relation", "a"]).join(at("b"), ["relation", "b"]).where("p_a <> p_b")
    first = F.col("p_a") < F.col("p_b")
    return placed.select(
        "relation", "mechanism", F.when(first, F.col("a")).otherwise(F.col("b")).alias("c1"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("c2"),
        F.least("p_a", "p_b").alias("p1"), F.greatest("p_a", "p_b").alias("p2"),
    ).distinct()


def known_edges(edges: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """The edges of a document whose ends both exist."""
    return edges.join(candidates.select("candidate_id"), "candidate_id", "left_semi").join(queries.select("query_id"), "query_id", "left_semi").select("candidate_id", "query_id")


def screening_recall(profile: DataFrame, rankings: dict[str, Sequence[Column]], actual: Sequence[Column], top: int, percents: Sequence[int]) -> DataFrame:
    """ranking, percent, kept, recall: of the best `top` rows, how many each screen would keep."""
    wide = profile.withColumns(
        {"_best": F.row_number().over(Window.orderBy(*actual)) <= top}
        | {f"_rank_{n}": F.row_number().over(Window.orderBy(*order)) for n, order in rankings.items()}
    )
    cells = F.array(*[F.struct(F.lit(n).alias("ranking"), F.col(f"_rank_{n}").alias("rank")) for n in rankings])
    ranked = wide.select("_best", F.inline(cells)).withColumn("rows", F.count("*").over(Window.partitionBy("ranking")))
    cut = ranked.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).where(F.col("rank") <= F.ceil(F.col("rows") * F.col("percent") / 100.0))
    return cut.groupBy("ranking", "percent").agg(F.count("*").alias("kept"), (F.count_if("_best") / top).alias("recall"))


def knee(gains: DataFrame, least: float) -> DataFrame:
    """The first target after which the gain stays under `least`; the last target if none does."""
    later = F.max("gain").over(Window.orderBy("target").rowsBetween(1, Window.unboundedFollowing))
    marked = gains.withColumn("_later", later)
    return marked.where((F.col("_later") < least) | F.col("_later").isNull()).agg(F.min("target").alias("knee"))


def best_context(trajectory: DataFrame) -> DataFrame:
    """candidate_id, round, improvement: each candidate's best round, the earliest on a tie."""
    return trajectory.groupBy("candidate_id").agg(F.max_by(F.struct("round", "improvement"), F.struct("improvement", -F.col("round"))).alias("m")).select("candidate_id", "m.*")


def retrospective(accepted: DataFrame, ranked: DataFrame) -> DataFrame:
    """Where the accepted candidates stood in the singleton ranking."""
    return accepted.join(ranked.select("candidate_id", "rank", "percentile", "bucket"), "candidate_id", "left")


def profile_violations(profile: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, problem: rows of a profile that cannot be right, and candidates without a row."""
    counts = F.col("improved") + F.col("unchanged") + F.col("worsened")
    joined = candidates.select("candidate_id").join(profile, "candidate_id", "full").join(candidates.select("candidate_id", F.lit(True).alias("_known")), "candidate_id", "left")
    problem = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("affected").isNull(), "missing")
        .when(counts != F.col("affected"), "counts")
        .when(F.col("reduction").isNull() | F.isnan("reduction"), "reduction")
    )
    return joined.select("candidate_id", problem.alias("problem")).where("problem is not null")


def frozen_precedence(profile: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, precedence_rank: most reduction first, then cheapest, then the old rank."""
    joined = candidates.join(profile.select("candidate_id", "reduction"), "candidate_id")
    order = Window.orderBy(F.desc("reduction"), F.when(F.col("mechanism") == "mcv", 0).otherwise(1), "precedence_rank", "candidate_id")
    return joined.select("candidate_id", (F.row_number().over(order) - 1).alias("precedence_rank"))


def calibration_pool(columns: DataFrame) -> DataFrame:
    """All column pairs of each relation by both mechanisms; columns: relation, column, position."""
    a, b = columns.alias("a"), columns.alias("b")
    pairs = a.join(b, (F.col("a.relation") == F.col("b.relation")) & (F.col("a.position") < F.col("b.position")))
    return pairs.select(F.col("a.relation").alias("relation"), F.col("a.column").alias("c1"), F.col("b.column").alias("c2"), F.explode(F.array(F.lit("mcv"), F.lit("fd"))).alias("mechanism"))


def target_cells(spark, targets: Sequence[int], samples: Sequence[str], seed: str) -> DataFrame:
    """target, sample, seed, capacity: the cells of a target grid, each with a seed of its own."""
    cells = spark.createDataFrame([(t, s) for t in targets for s in samples], "target int, sample string")
    own = F.sha2(F.concat_ws("/", F.lit(seed), F.col("target").cast("string"), "sample"), 256)
    return cells.select("target", "sample", F.substring(own, 1, 16).alias("seed"), (F.col("target") * 300).alias("capacity"))


def relevant_overrides(overrides: DataFrame, candidates: DataFrame) -> DataFrame:
    """column, target of columns that a candidate uses and that do not inherit (-1)."""
    used = candidates.select(F.explode(F.array("c1", "c2")).alias("column")).distinct()
    return overrides.where("target <> -1").join(used, "column", "left_semi").select("column", "target")
