"""Cardinality estimates of conjunctive queries under a set of statistics.

The model: pair statistics are taken in design order, MCV lists before dependencies. One whose
two columns both still have predicates that are not accounted for gives their joint
selectivity (MCV: the summed frequencies of the value pairs; dependency of degree d:
P(a) (d + (1 - d) P(b))) and accounts for both. The other columns multiply as if independent.
This is an estimator of its own, not a copy of a database's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scores import q_error


def single_selectivities(predicates: DataFrame, mcv: DataFrame, columns: DataFrame) -> DataFrame:
    """query_id, column, sel. predicates: query_id, column, value (one row for each constant).

    mcv: column, value, freq; columns: column, n_distinct (negative: a share), rows. A value
    outside the list has 1 / n_distinct; the constants of a list add up to 1 at most.
    """
    spread = F.when(F.col("n_distinct") < 0, -F.col("n_distinct") * F.col("rows")).otherwise(F.col("n_distinct"))
    one = predicates.join(mcv.select("column", "value", "freq"), ["column", "value"], "left").join(
        columns.select("column", spread.alias("distinct")), "column", "left"
    )
    value = F.coalesce("freq", F.when(F.col("distinct") > 0, 1 / F.col("distinct")), F.lit(0.0))
    return one.groupBy("query_id", "column").agg(F.least(F.lit(1.0), F.sum(value)).alias("sel"))


def pair_factors(predicates: DataFrame, singles: DataFrame, candidates: DataFrame, pair_mcv: DataFrame, fd: DataFrame) -> DataFrame:
    """query_id, candidate_id, mechanism, precedence_rank, c1, c2, factor for present candidates."""
    wanted = candidates.where("state = 'PRESENT'") if "state" in candidates.columns else candidates
    a = predicates.select("query_id", F.col("column").alias("c1"), F.col("value").alias("v1"))
    b = predicates.select("query_id", F.col("column").alias("c2"), F.col("value").alias("v2"))
    keep = ["query_id", "candidate_id", "mechanism", "precedence_rank", "c1", "c2"]
    joint = (
        wanted.where("mechanism = 'mcv'").join(a, "c1").join(b, ["query_id", "c2"])
        .join(pair_mcv.select("c1", "c2", "v1", "v2", "freq"), ["c1", "c2", "v1", "v2"], "left")
        .groupBy(*keep)
        .agg(F.coalesce(F.sum("freq"), F.lit(0.0)).alias("factor"))
    )
    x = singles.select("query_id", F.col("column").alias("c1"), F.col("sel").alias("s1"))
    y = singles.select("query_id", F.col("column").alias("c2"), F.col("sel").alias("s2"))
    degrees = fd.select(F.col("determinant").alias("c1"), F.col("dependent").alias("c2"), "degree")
    depends = (
        wanted.where("mechanism = 'fd'").join(x, "c1").join(y, ["query_id", "c2"]).join(degrees, ["c1", "c2"])
        .select(*keep, (F.col("s1") * (F.col("degree") + (1 - F.col("degree")) * F.col("s2"))).alias("factor"))
    )
    return joint.unionByName(depends)


def estimates(singles: DataFrame, factors: DataFrame, truths: DataFrame, rows: int, design: Sequence[str] | None = None) -> DataFrame:
    """query_id, estimate, truth, contribution under a design (default: all candidates given)."""
    if design is not None:
        factors = factors.where(F.col("candidate_id").isin(list(design)))
    order = F.when(F.col("mechanism") == "mcv", 0).otherwise(1)
    # A query has few columns and few candidates; both lists are as short as its text.
    used = factors.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("kind"), "precedence_rank", "c1", "c2", "factor"))).alias("statistics")
    )
    own = singles.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("column", "sel"))).alias("columns"))
    start = F.struct(F.lit(1.0).alias("sel"), F.array().cast("array<string>").alias("done"))
    step = lambda acc, s: F.when(
        F.array_contains(acc["done"], s["c1"]) | F.array_contains(acc["done"], s["c2"]), acc
    ).otherwise(F.struct((acc["sel"] * s["factor"]).alias("sel"), F.concat(acc["done"], F.array(s["c1"], s["c2"])).alias("done")))
    state = F.aggregate(F.coalesce("statistics", F.array().cast(used.schema["statistics"].dataType)), start, step)
    rest = F.aggregate("columns", F.col("state")["sel"], lambda s, c: F.when(F.array_contains(F.col("state")["done"], c["column"]), s).otherwise(s * c["sel"]))
    estimate = F.greatest(F.lit(1.0), F.rint(F.lit(float(rows)) * F.col("sel")))
    return (
        own.join(used, "query_id", "left").withColumn("state", state).withColumn("sel", rest).join(truths, "query_id")
        .select("query_id", estimate.alias("estimate"), F.col("truth").cast("double").alias("truth"))
        .withColumn("contribution", q_error(F.col("estimate"), F.col("truth")))
    )


def design_objectives(singles: DataFrame, factors: DataFrame, truths: DataFrame, rows: int, designs: DataFrame) -> DataFrame:
    """design, objective, changed: many designs (design, candidate_id) over a workload in one job.

    Only a design's affected queries are estimated for it; the others keep what they have
    under no statistics at all.
    """
    base = estimates(singles, factors.limit(0), truths, rows).select("query_id", F.col("contribution").alias("before"))
    total = base.agg(F.sum("before").alias("total")).withColumn("_k", F.lit(1))
    key = F.concat_ws("\u0001", "design", "query_id")
    hit = factors.join(designs.select("design", "candidate_id").distinct(), "candidate_id").withColumn("_id", key)
    pairs = hit.select("design", "query_id", "_id").distinct()
    as_query = lambda d: d.drop("query_id").withColumnRenamed("_id", "query_id")
    own = estimates(
        as_query(singles.join(pairs, "query_id")).drop("design"), as_query(hit).drop("design"), as_query(truths.join(pairs, "query_id")).drop("design"), rows
    ).select(F.col("query_id").alias("_id"), F.col("contribution").alias("after"))
    gains = own.join(pairs, "_id").join(base, "query_id").groupBy("design").agg(F.sum(F.col("after") - F.col("before")).alias("gain"), F.count("*").alias("changed"))
    return (
        designs.select("design").distinct().join(gains, "design", "left").withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")  # one row
        .select("design", (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("objective"), F.coalesce("changed", F.lit(0)).cast("long").alias("changed"))
    )


def objective(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.sum("contribution").alias("objective"), F.count("*").alias("queries"))


def reuse(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """An evaluation in which affected queries have their new contribution and others the old."""
    new = fresh.select("query_id", F.col("contribution").alias("_new"), F.col("estimate").alias("_estimate"))
    return before.join(new, "query_id", "left").select(
        "query_id", F.coalesce("_estimate", "estimate").alias("estimate"), "truth", F.coalesce("_new", "contribution").alias("contribution"),
        F.col("_new").isNull().alias("reused"),
    )


def lower_bounds(evaluated: DataFrame, edges: DataFrame) -> DataFrame:
    """candidate_id, affected, bound: no state of its affected queries gives less than this."""
    hit = edges.select("candidate_id", "query_id").distinct().join(evaluated.select("query_id", "contribution"), "query_id")
    whole = evaluated.agg(F.sum("contribution").alias("total")).withColumn("_k", F.lit(1))
    return (
        hit.groupBy("candidate_id").agg(F.count("*").alias("affected"), F.sum("contribution").alias("own")).withColumn("_k", F.lit(1))
        .join(F.broadcast(whole), "_k")  # one row
        .select("candidate_id", "affected", (F.col("total") - F.col("own") + F.col("affected")).alias("bound"))
    )


def singleton_profile(singles: DataFrame, factors: DataFrame, truths: DataFrame, rows: int) -> DataFrame:
    """Each candidate by itself: what it improves and worsens, for all candidates in one job."""
    base = estimates(singles, factors.limit(0), truths, rows).select("query_id", F.col("contribution").alias("before"))
    alone = factors.join(singles.groupBy("query_id").agg(F.collect_list(F.struct("column", "sel")).alias("columns")), "query_id")
    rest = F.aggregate(
        "columns", F.col("factor"),
        lambda s, c: F.when(c["column"].isin(F.col("c1"), F.col("c2")), s).otherwise(s * c["sel"]),
    )
    estimate = F.greatest(F.lit(1.0), F.rint(F.lit(float(rows)) * rest))
    after = alone.join(truths, "query_id").join(base, "query_id").withColumn("after", q_error(estimate, F.col("truth").cast("double")))
    return after.groupBy("candidate_id").agg(
        F.count("*").alias("affected"),
        F.sum(F.col("before") - F.col("after")).alias("reduction"),
        F.count_if(F.col("after") < F.col("before")).alias("improved"),
        F.count_if(F.col("after") == F.col("before")).alias("unchanged"),
        F.count_if(F.col("after") > F.col("before")).alias("worsened"),
    )
