"""Exact histogram of encoded document lengths, with suffix sums for every context limit.

Defined results: a null or empty text has length 1 (its end id); an empty table gives no
rows; repeated rows count each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bounded_batches, gathered, materialize, running_before, text_or_empty
from tesserae.llm.tokens import default_tokenizer, encoder


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length, end id included."""
    tokenizer = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in gathered(batches):
            _, lengths = coder.encode(text_or_empty(batch))
            values, counts = np.unique(lengths + 1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["n_tokens", "n"])

    partial = docs.select("text").mapInArrow(count, "n_tokens long, n long")
    # A row for each length; written, since the table of sums reads it more than once.
    with bounded_batches(docs.sparkSession):
        return materialize(partial.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")), "lengths")


def length_table(histogram: DataFrame) -> DataFrame:
    """A row for each length that occurs, with what holds for it as a context limit.

    docs_at_least and tokens_at_least are suffix sums; truncated_tokens is what all documents
    keep when cut at n_tokens; cut_tokens what they lose; quantile the share of documents of
    at most this length.
    """
    wide = histogram.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "_bucket", -F.shiftright("n_tokens", 10)
    )
    longer = running_before(
        wide, ["_bucket"], [F.desc("n_tokens")], {"docs_longer": "n_docs", "tokens_longer": "_tokens"}
    )
    both = running_before(
        longer.withColumn("_bucket", F.shiftright("n_tokens", 10)), ["_bucket"], ["n_tokens"],
        {"docs_shorter": "n_docs", "tokens_shorter": "_tokens"},
    )
    at_least = F.col("docs_longer") + F.col("n_docs")
    tokens_at_least = F.col("tokens_longer") + F.col("_tokens")
    return both.select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("tokens_shorter") + F.col("n_tokens") * at_least).alias("truncated_tokens"),
        (tokens_at_least - F.col("n_tokens") * at_least).alias("cut_tokens"),
        ((F.col("docs_shorter") + F.col("n_docs")) / (F.col("docs_shorter") + at_least)).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, docs_longer, truncated_tokens for any limits, read off length_table.

    The shortest length above a limit carries the suffix sums that the limit needs; a limit
    that no document passes gets all tokens.
    """
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    above = (
        F.broadcast(asked)
        .join(table, F.col("n_tokens") > F.col("context_limit"), "left")
        .groupBy("context_limit")
        .agg(
            F.min_by("docs_at_least", "n_tokens").alias("over"),
            (F.min_by("truncated_tokens", "n_tokens") - F.min("n_tokens") * F.min_by("docs_at_least", "n_tokens")).alias("under"),
        )
    )
    whole = table.agg(F.max("truncated_tokens").alias("all_tokens")).withColumn("_one", F.lit(1))
    return (
        above.withColumn("_one", F.lit(1))
        .join(F.broadcast(whole), "_one")
        .select(
            "context_limit",
            F.coalesce("over", F.lit(0)).cast("long").alias("docs_longer"),
            F.coalesce(F.col("under") + F.col("over") * F.col("context_limit"), "all_tokens", F.lit(0))
            .cast("long")
            .alias("truncated_tokens"),
        )
    )
