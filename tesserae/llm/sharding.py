"""Contiguous shards of near-equal bytes from global prefix sums.

Documents are range-partitioned by doc_id; each partition's byte total (one row each) is
summed up globally, and inside its partition a document adds the bytes before it. Cuts at
equal targets of the grand total give shards that follow one another in doc_id order.

Defined results: a null text has size 1 (no bytes, plus 1) and the checksum of no bytes;
rows with equal doc_id follow one another in size and checksum order; a null doc_id comes
first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize, running_before


def assign_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: law "bytes"."""
    spark = docs.sparkSession
    # A few ranges for each reducer, so that ranges that share one stay even.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),  # a doc_id with many rows may span ranges
    )
    ranged = materialize(
        sized.repartitionByRange(parts, "doc_id", "size", "text_crc32", "_tie").withColumn("_part", F.spark_partition_id()),
        "shards",
    ).withColumn("_one", F.lit(1))
    order = [F.asc_nulls_first("doc_id"), "size", "text_crc32", "_tie"]
    placed = running_before(ranged, ["_part"], order, {"_before": "size", "_row": "_one"})
    total = ranged.agg(F.sum("size").alias("_total"))  # one row
    sharded = placed.join(F.broadcast(total.withColumn("_all", F.lit(1))), F.col("_one") == F.col("_all")).withColumn(
        "shard", (F.expr(f"({n_shards} * (2 * _before + size)) div (2 * _total)")).cast("int")
    )
    firsts = sharded.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Shards of documents with distinct ids; the checksum's table comes from its polynomial.
ORACLE_SQL = """
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
             lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)::BIGINT AS text_crc32 FROM d, k),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(size) OVER () AS total FROM s),
q AS (SELECT *, ((8 * (2 * before + size)) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM q
"""
