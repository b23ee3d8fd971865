"""Single-column and column-pair statistics, samples and exact counts.

All columns of a table are unpivoted and counted in one shuffle; counts combine before it, so
a value that fills a third of the table sends one row from each task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.running import quantiles

PREDICATES_A_JOB = 200


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value: each row's values as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return unpivot(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def column_mcv(df: DataFrame, columns: Sequence[str], target: int) -> DataFrame:
    """column, value, rank, freq: the target most common values of each column."""
    counts = value_counts(df, columns)
    rows = counts.groupBy("column").agg(F.sum("n").alias("rows"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    # The rank filter right above the window lets Spark cut each task's rows before the shuffle.
    top = counts.where("value is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= target)
    return top.join(rows, "column").select("column", "value", "rank", (F.col("n") / F.col("rows")).alias("freq"))


def null_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = value_counts(df, columns)
    share = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")
    return counts.groupBy("column").agg(share.alias("null_frac"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_counts(df, columns).groupBy("column").agg(F.count("value").alias("n_distinct"))


def histogram_bounds(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket, bound: equi-depth bounds of a numeric column, linear between values."""
    found = quantiles(df, column, [k / buckets for k in range(buckets + 1)])
    return found.select(F.col("k").alias("bucket"), F.col("value").alias("bound"))


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """c1, c2, v1, v2, n: all pairs in one shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(a).cast("string").alias("v1"), F.col(b).cast("string").alias("v2"))
            for a, b in pairs
        ]
    )
    return df.select(F.inline(cells)).groupBy("c1", "c2", "v1", "v2").agg(F.count("*").alias("n"))


def pair_mcv(df: DataFrame, pairs: Sequence[tuple[str, str]], target: int) -> DataFrame:
    """c1, c2, v1, v2, rank, freq, base_freq: common value pairs, and what independence gives them."""
    counts = pair_counts(df, pairs)
    order = Window.partitionBy("c1", "c2").orderBy(F.desc("n"), "v1", "v2")
    totals = counts.groupBy("c1", "c2").agg(F.sum("n").alias("rows"))
    left = counts.groupBy("c1", "c2", "v1").agg(F.sum("n").alias("n1"))
    right = counts.groupBy("c1", "c2", "v2").agg(F.sum("n").alias("n2"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= target)
    return (
        top.join(totals, ["c1", "c2"])
        .join(left, ["c1", "c2", "v1"])
        .join(right, ["c1", "c2", "v2"])
        .select(
            "c1", "c2", "v1", "v2", "rank", (F.col("n") / F.col("rows")).alias("freq"),
            (F.col("n1") / F.col("rows") * (F.col("n2") / F.col("rows"))).alias("base_freq"),
        )
    )


def fd_degrees(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """determinant, dependent, degree: the share of rows whose determinant has one dependent only."""
    counts = pair_counts(df, pairs)
    out = None
    for a, b, key in (("c1", "c2", "v1"), ("c2", "c1", "v2")):
        groups = counts.groupBy("c1", "c2", key).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        degree = F.sum(F.when(F.col("kinds") == 1, F.col("n")).otherwise(0)) / F.sum("n")
        one = groups.groupBy("c1", "c2").agg(degree.alias("degree")).select(
            F.col(a).alias("determinant"), F.col(b).alias("dependent"), "degree"
        )
        out = one if out is None else out.unionByName(one)
    return out


def acquire(df: DataFrame, candidates: DataFrame, pairs: Sequence[tuple[str, str]], target: int) -> DataFrame:
    """candidates with state: PRESENT, or ABSENT_NATIVE where the data gives the mechanism nothing."""
    rows = pair_mcv(df, pairs, target).groupBy("c1", "c2").agg(F.count("*").alias("kept"))
    fd = fd_degrees(df, pairs).groupBy(
        F.least("determinant", "dependent").alias("c1"), F.greatest("determinant", "dependent").alias("c2")
    ).agg(F.max("degree").alias("degree"))
    found = (
        candidates.join(rows.withColumns({"c1": F.least("c1", "c2"), "c2": F.greatest("c1", "c2")}), ["c1", "c2"], "left")
        .join(fd, ["c1", "c2"], "left")
    )
    present = F.when(F.col("mechanism") == "mcv", F.coalesce("kept", F.lit(0)) > 0).otherwise(F.coalesce("degree", F.lit(0.0)) > 0)
    return found.select(*candidates.columns, F.when(present, "PRESENT").otherwise("ABSENT_NATIVE").alias("state"))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and a digest of the schema (names and types in order)."""
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(F.count("*").alias("rows")).select("rows", F.sha2(F.lit(schema), 256).alias("schema_digest"))


def bottom_k(df: DataFrame, key: str, k: int, seed: str = "") -> DataFrame:
    """k rows in the order of a seeded hash: the same rows for any partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(k)


def sample_grid(df: DataFrame, key: str, sizes: Sequence[int], seeds: Sequence[str]) -> DataFrame:
    """size, seed, position, key: one bottom-k sample for each size and seed.

    A seed's samples share one order; its first rows come from a bounded queue in each task, not from a sort.
    """
    first, most = None, max(sizes)
    for seed in seeds:
        hashed = df.select(F.lit(seed).alias("seed"), F.col(key).alias("key")).withColumn("hash", F.md5(F.concat("seed", F.lit("/"), F.col("key").cast("string"))))
        one = hashed.orderBy(F.asc_nulls_last("hash"), F.asc_nulls_last("key")).limit(most)
        first = one if first is None else first.unionByName(one)
    order = Window.partitionBy("seed").orderBy(F.asc_nulls_last("hash"), F.asc_nulls_last("key"))
    ranked = first.withColumn("position", F.row_number().over(order)).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    return ranked.where(F.col("position") <= F.col("size")).select("size", "seed", "position", "key")


def truth_counts(df: DataFrame, predicates: Mapping[str, str]) -> DataFrame:
    """query_id, truth: exact counts of all predicates, a scan for every PREDICATES_A_JOB."""
    names = list(predicates)
    out = None
    for a in range(0, len(names), PREDICATES_A_JOB):
        part = names[a : a + PREDICATES_A_JOB]
        one = df.agg(*[F.count_if(F.expr(predicates[q])).alias(q) for q in part])
        cells = F.array(*[F.struct(F.lit(q).alias("query_id"), F.col(f"`{q}`").alias("truth")) for q in part])
        rows = one.select(F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out
