"""Best-fit packing of encoded documents by matching large items first.

Documents above a third of the capacity meet at most in twos: going down in length, each
takes the longest other large one that still fits. Shorter ones then go, longest first, into
the tightest gap that holds them. The plan needs only how many pieces have each length (at
most `capacity` numbers), so it is made on counts, and a document finds its place from its
rank among the pieces of its length. Nothing about a single document reaches the driver.

Defined results: a null or empty text is the end id alone; a text longer than the capacity is
cut into full pieces and a rest; an empty table gives no rows; rows with equal doc_id are
packed each; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import bounded_batches, gathered, materialize, text_or_empty
from tesserae.llm.tokens import default_tokenizer, encoder, with_end

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[length] pieces of each length.

    Returns (length, first_rank, n_sequences, first_sequence, per_sequence, offset): the
    pieces of that length from first_rank on go, per_sequence at a time and from offset on,
    into n_sequences sequences that follow first_sequence.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}  # residual -> runs (first sequence, how many)
    sizes: list[int] = []  # residuals in use, ascending
    new = 0

    def put(length: int, first: int, n: int, each: int, offset: int) -> None:
        slots.append((length, taken[length], n, first, each, offset))
        taken[length] += n * each
        left[length] -= n * each

    def leave(residual: int, first: int, n: int) -> None:
        if residual and n:
            if residual not in gaps:
                gaps[residual] = []
                insort(sizes, residual)
            gaps[residual].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, capacity - a + 1) - 1
            while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
                k -= 1
            b = large[k] if k >= 0 else None
            if b is None:
                n = left[a]
                put(a, new, n, 1, 0)
                leave(capacity - a, new, n)
            elif b == a:
                n = left[a] // 2
                put(a, new, n, 2, 0)
                leave(capacity - 2 * a, new, n)
            else:
                n = min(left[a], left[b])
                put(a, new, n, 1, 0)
                put(b, new, n, 1, a)
                leave(capacity - a - b, new, n)
            new += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(sizes, s)
            if k == len(sizes):  # no gap holds it: open as many sequences as it needs
                each = min(left[s], capacity // s)
                n = left[s] // each
                put(s, new, n, each, 0)
                leave(capacity - each * s, new, n)
                new += n
                continue
            residual = sizes[k]
            first, n = gaps[residual].pop()
            if not gaps[residual]:
                del gaps[residual]
                sizes.pop(k)
            each = min(left[s], residual // s)
            use = min(n, left[s] // each)
            put(s, first, use, each, capacity - residual)
            leave(residual - each * s, first, use)
            leave(residual, first + use, n - use)
    return slots


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Encode and cut documents; rank counts a partition's pieces of the same length."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches):
            ids, lengths = with_end(*coder.encode(text_or_empty(batch)))
            ends = np.cumsum(lengths)
            n_pieces = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(capacity, lengths[doc] - start)
            base = (ends - lengths)[doc] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(base, base + length, strict=True)]
            order = np.argsort(length, kind="stable")
            in_order = length[order]
            firsts = np.searchsorted(in_order, in_order, "left")
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - firsts + seen[in_order]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                       pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)),
                       pa.array(rank)]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each piece's sequence and its offset there."""
    spark = docs.sparkSession
    with bounded_batches(spark):
        cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    # A partition's first rank in each length; then counts of at most `capacity` lengths.
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    over = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_part.select("length", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        pack_counts(counts, capacity),
        "slot_length long, from_rank long, n_sequences long, first_sequence long, per_sequence long, at long",
    )
    ranked = cut.join(firsts, ["length", "part"]).withColumn("of_length", F.col("first") + F.col("rank"))
    # The table of slots has a few rows for each of `capacity` lengths, whatever the input.
    inside = F.col("of_length") - F.col("from_rank")
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("slot_length"))
        & (F.col("of_length") >= F.col("from_rank"))
        & (F.col("of_length") < F.col("from_rank") + F.col("n_sequences") * F.col("per_sequence")),
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.expr("(of_length - from_rank) div per_sequence")).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(inside, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )
