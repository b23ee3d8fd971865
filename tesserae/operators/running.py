"""Shared tables, and sums over an order of all rows without a task that sees them all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where none is set, a local session gets a temporary one; a cluster gets an error, since its
    executors would each write to a disk of their own.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Cuts the lineage with files that outlive any executor, and fixes values that must not
    be computed twice (partition numbers, model tables).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_before(
    df: DataFrame, bucket: Sequence[str], order: Sequence, sums: dict[str, str], within: Sequence[str] = ()
) -> DataFrame:
    """Add for each new name in sums the sum of its column over all rows that come before.

    Rows are ordered by the bucket columns and then by order, separately for each value of
    the within columns. Only bucket totals (one row for each bucket) meet in a window over
    all buckets; the rows themselves are summed inside their own bucket.
    """
    keys = [*within, *bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
    over = Window.partitionBy(*within).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_total_{n}").over(over), F.lit(0)).cast("long").alias(f"_before_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = df.join(offsets, on=same, how="inner")
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long").alias(n)
            for n, c in sums.items()
        ],
    )
    return out


def in_order(df: DataFrame, order: Sequence[Column], sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each new name in sums, the sum of its column over all rows that come before in the given order.

    The rows are dealt by ranges of the order into a table that holds each row's range; only the
    ranges' totals meet.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    return running_before(dealt, ["_range"], order, sums).drop("_range")


def numbered(df: DataFrame, order: Sequence[Column], out: str, name: str) -> DataFrame:
    """df with each row's number in the given order of all rows, from 1."""
    placed = in_order(df.withColumn("_one", F.lit(1)), order, {out: "_one"}, name)
    return placed.drop("_one").withColumn(out, F.col(out) + 1)


def quantiles(df: DataFrame, value: Column | str, shares: Sequence[float]) -> DataFrame:
    """k, share, value: exact quantiles, linear between values; null where there are none. NaN is the largest value."""
    counts = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
    placed = in_order(counts, [F.asc("_v")], {"_before": "_n"}, "quantiles")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)])
    wanted = placed.agg(F.sum("_n").alias("_rows")).select("_rows", F.inline(cells)).select("k", "share", ((F.col("_rows") - 1) * F.col("share")).alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    ends = (
        placed.join(F.broadcast(wanted), (F.col("_before") <= high) & (F.col("_before") + F.col("_n") > low))  # a row a share
        .groupBy("k").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    between = (high - F.col("_at")) * F.col("_low") + (F.col("_at") - low) * F.col("_high")
    return wanted.join(ends, "k", "left").select("k", "share", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("value"))
