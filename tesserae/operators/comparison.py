"""Comparing evaluations, designs and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scores import direction, ratio_bucket
from tesserae.operators.running import in_order, materialize, numbered, quantiles


def average_ranks(df: DataFrame, value: str, out: str, rows: str | None = None) -> DataFrame:
    """Ranks in which ties share their mean; a row of df stands for as many as the column rows says, or for one."""
    counts = df.groupBy(F.col(value).alias("_value")).agg((F.sum(rows) if rows else F.count("*")).alias("_ties"))
    placed = in_order(counts, [F.asc_nulls_last("_value")], {"_before": "_ties"}, "ranks")
    ranks = placed.select("_value", (F.col("_before") + (F.col("_ties") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """The correlation of average ranks, from the counts of distinct pairs; NaN where one side is constant."""
    pairs = materialize(df.groupBy(F.col(x).alias("_a"), F.col(y).alias("_b")).agg(F.count("*").alias("_rows")), "pairs")
    both = average_ranks(average_ranks(pairs, "_a", "_x", "_rows"), "_b", "_y", "_rows")
    mean = pairs.agg(((F.sum("_rows") + 1) / 2.0).alias("_mean"))  # of either side's ranks
    dx, dy, n = F.col("_x") - F.col("_mean"), F.col("_y") - F.col("_mean"), F.col("_rows")
    sums = both.crossJoin(F.broadcast(mean)).agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))
    spread = F.sqrt("xx") * F.sqrt("yy")
    return sums.select(F.when(spread == 0, F.lit(float("nan"))).otherwise(F.col("xy") / F.when(spread != 0, spread)).alias("spearman"))


def ordinal_spearman(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """As spearman, with ties ordered by a third column."""
    both = df.select(F.col(x).alias("_a"), F.col(y).alias("_b"), F.col(tie).alias("_tie"))
    for value, out in (("_a", "_x"), ("_b", "_y")):
        both = numbered(both, [F.asc_nulls_last(value), F.asc_nulls_last("_tie")], out, "ordinal").drop(value)
    found = F.corr(F.col("_x").cast("double"), F.col("_y").cast("double"))
    return both.agg(F.coalesce(found, F.when(F.count("*") > 0, F.lit(float("nan")))).alias("spearman"))  # one row has no spread


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, before, after, drift, direction; both need query_id and contribution."""
    a = before.select("query_id", F.col("contribution").alias("before"))
    b = after.select("query_id", F.col("contribution").alias("after"))
    joined = a.join(b, "query_id", "full")
    return joined.withColumns(
        {"drift": F.abs(F.col("after") - F.col("before")), "direction": direction(F.col("before"), F.col("after"))}
    ).withColumn("direction", F.when(F.col("before").isNull() | F.col("after").isNull(), "unmatched").otherwise(F.col("direction")))


def change_summary(changed: DataFrame) -> DataFrame:
    return changed.agg(
        *[F.count_if(F.col("direction") == d).alias(d) for d in ("improved", "unchanged", "worsened")],
        F.coalesce(F.sum("before"), F.lit(0.0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0.0)).alias("after"),
    )


def vector_diagnostics(changed: DataFrame) -> DataFrame:
    """Median and 90th percentile of |log ratio|, and the shares that went up and down."""
    log = F.abs(F.log(F.col("after") / F.col("before")))
    both = quantiles(changed, log, [0.5, 0.9]).agg(
        F.max(F.when(F.col("k") == 0, F.col("value"))).alias("median_abs_log_ratio"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("p90_abs_log_ratio")
    )
    shares = changed.agg(
        (F.count_if(F.col("after") > F.col("before")) / F.count("*")).alias("greater"),
        (F.count_if(F.col("after") < F.col("before")) / F.count("*")).alias("less"),
    )
    return both.crossJoin(F.broadcast(shares))  # one row


def ratio_buckets(evaluated: DataFrame, value: str = "contribution") -> DataFrame:
    return evaluated.groupBy(ratio_bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("queries"))


def trimmed(evaluated: DataFrame, excluded: DataFrame) -> DataFrame:
    """The objective without a set of queries."""
    left = evaluated.join(excluded.select("query_id"), "query_id", "left_anti")
    return left.agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("objective"), F.count("*").alias("queries"))


def design_overlap(members: DataFrame) -> DataFrame:
    """design_a, design_b, shared, either, jaccard; members: design, candidate_id."""
    sizes = members.groupBy("design").agg(F.count("*").alias("size"))
    pairs = sizes.alias("a").join(sizes.alias("b"), F.col("a.design") < F.col("b.design")).select(
        F.col("a.design").alias("design_a"), F.col("b.design").alias("design_b"), F.col("a.size").alias("sa"), F.col("b.size").alias("sb")
    )
    a, b = members.alias("a"), members.alias("b")
    both = (
        a.join(b, (F.col("a.candidate_id") == F.col("b.candidate_id")) & (F.col("a.design") < F.col("b.design")))
        .groupBy(F.col("a.design").alias("design_a"), F.col("b.design").alias("design_b")).agg(F.count("*").alias("shared"))
    )
    joined = pairs.join(both, ["design_a", "design_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    either = F.col("sa") + F.col("sb") - F.col("shared")
    return joined.select("design_a", "design_b", "shared", either.alias("either"), F.when(either == 0, 1.0).otherwise(F.col("shared") / either).alias("jaccard"))


def selection_frequency(members: DataFrame) -> DataFrame:
    """candidate_id, designs, share, core: how many designs hold each candidate."""
    n = members.agg(F.countDistinct("design").alias("n"))
    counts = members.groupBy("candidate_id").agg(F.countDistinct("design").alias("designs"))
    return counts.crossJoin(F.broadcast(n)).select(  # one row
        "candidate_id", "designs", (F.col("designs") / F.col("n")).alias("share"), (F.col("designs") == F.col("n")).alias("core")
    )


def query_stability(runs: DataFrame) -> DataFrame:
    """query_id, category over runs; runs: run, query_id, before, after."""
    way = direction(F.col("before"), F.col("after"))
    kinds = runs.groupBy("query_id").agg(F.count("*").alias("n"), *[F.count_if(way == d).alias(d) for d in ("improved", "unchanged", "worsened")])
    out = F.lit("mixed")
    for d in ("improved", "unchanged", "worsened"):
        out = F.when(F.col(d) == F.col("n"), f"always_{d}").otherwise(out)
    return kinds.select("query_id", out.alias("category"))


def mcv_overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """column, value, where, delta of the values of two MCV lists."""
    a = one.select("column", "value", F.col("freq").alias("fa"))
    b = other.select("column", "value", F.col("freq").alias("fb"))
    place = F.when(F.col("fa").isNull(), "right-only").when(F.col("fb").isNull(), "left-only").otherwise("both")
    return a.join(b, ["column", "value"], "full").select("column", "value", place.alias("where"), F.abs(F.col("fa") - F.col("fb")).alias("delta"))


def cross_matrix(evaluations: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row a design, one column a sample; evaluations: design, sample, contribution."""
    return evaluations.groupBy("design").pivot("sample", list(samples)).agg(F.sum("contribution"))


def cross_gaps(evaluations: DataFrame) -> DataFrame:
    """design, sample, objective, gap to the design that belongs to the sample, relative."""
    cells = evaluations.groupBy("design", "sample").agg(F.sum("contribution").alias("objective"))
    own = cells.where("design = sample").select("sample", F.col("objective").alias("own"))
    return cells.join(own, "sample").select("design", "sample", "objective", ((F.col("objective") - F.col("own")) / F.col("own")).alias("gap"))


def interaction_gain(profile: DataFrame, trajectory: DataFrame) -> DataFrame:
    """candidate_id, alone, in_context, gain, kind; trajectory: round, candidate_id, improvement."""
    most = trajectory.groupBy("candidate_id").agg(F.max(F.struct("improvement", (-F.col("round")).alias("r"))).alias("m"))
    joined = profile.join(most, "candidate_id").select(
        "candidate_id", F.col("reduction").alias("alone"), F.col("m.improvement").alias("in_context"), (-F.col("m.r")).alias("round")
    )
    gain = F.col("in_context") - F.col("alone")
    kind = F.when(F.col("alone") <= 0, F.when(F.col("in_context") > 0, "rescued").otherwise("useless")).when(gain > 0, "synergy").when(gain < 0, "overlap").otherwise("additive")
    return joined.select("candidate_id", "alone", "in_context", "round", gain.alias("gain"), kind.alias("kind"))


def objective_summary(runs: DataFrame) -> DataFrame:
    """target, runs, mean, sd, range_over_mean, cv; runs: target, objective."""
    mean = F.avg("objective")
    return runs.groupBy("target").agg(
        F.count("*").alias("runs"), mean.alias("mean"), F.stddev_samp("objective").alias("sd"),
        ((F.max("objective") - F.min("objective")) / F.nullif(mean, F.lit(0.0))).alias("range_over_mean"),
        (F.stddev_samp("objective") / F.nullif(mean, F.lit(0.0))).alias("cv"),
    )


def marginal_gains(summary: DataFrame) -> DataFrame:
    """target, gain: relative improvement of the mean over the target before."""
    last = F.lag("mean").over(Window.orderBy("target"))
    return summary.select("target", ((last - F.col("mean")) / F.nullif(last, F.lit(0.0))).alias("gain"))


def same_statistics(one: DataFrame, other: DataFrame) -> DataFrame:
    """name_a, name_b: objects of the same kind over the same columns under two names."""
    keyed = lambda d, n: d.select(F.col("name").alias(n), "kind", F.array_join(F.array_sort("keys"), ",").alias("k"))
    both = keyed(one, "name_a").join(keyed(other, "name_b"), ["kind", "k"])
    return both.where("name_a <> name_b").select("name_a", "name_b", "kind")


def unexpected(present: DataFrame, planned: DataFrame, prefix: str) -> DataFrame:
    """Names under the advisor's prefix that no plan holds."""
    return present.where(F.col("name").startswith(prefix)).join(planned.select("name"), "name", "left_anti").select("name")


def payload_changes(frozen: DataFrame, fresh: DataFrame) -> DataFrame:
    """candidate_id, change from states and digests; both: candidate_id, state, digest."""
    a = frozen.select("candidate_id", F.col("state").alias("sa"), F.col("digest").alias("da"))
    b = fresh.select("candidate_id", F.col("state").alias("sb"), F.col("digest").alias("db"))
    present = lambda s: F.col(s) == "PRESENT"
    change = (
        F.when(present("sa") & present("sb"), F.when(F.col("da") == F.col("db"), "present-same").otherwise("present-changed"))
        .when(~present("sa") & ~present("sb"), "absent-same")
        .when(present("sa"), "present-to-absent").otherwise("absent-to-present")
    )
    return a.join(b, "candidate_id").select("candidate_id", change.alias("change"))
