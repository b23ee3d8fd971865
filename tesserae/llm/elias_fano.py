"""Token ids on file with Elias-Fano coded document boundaries.

One segment holds the concatenated ids of a run of documents, the run's document ends and its
doc_ids. Ends and doc_ids are Elias-Fano codes: each value's low bits packed, its high bits in
unary, about 2 + log2(greatest value / documents) bits each, and a sampled position for every
64th value, from which select() finds any value by a few bytes. Nothing of a document is held
in 64 bits. Segments are rows of a Parquet table that Spark writes and commits.

Defined results: a null text is an empty one and holds only the end id; rows with equal doc_id
follow one another in the order of their texts' hashes; null doc_ids come first; an empty table
gives no segments; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import bounded_batches, gathered, materialize, text_or_empty
from tesserae.llm.tokens import END_ID, default_tokenizer, encoder, with_end

SAMPLE = 64
SEGMENT_IDS = 1 << 20
WIDEST = 1 << 62  # of a segment's doc_ids
SEGMENTS = (
    "part int, chunk int, first_in_part long, n_docs int, n_null int, n_ids long, first_id long, doc_ids binary, "
    "width int, ids binary, bounds binary"
)
#: In a byte, the place of its k-th set bit.
_IN_BYTE = np.array([(places + [0] * 8)[:8] for places in ([k for k in range(8) if b >> k & 1] for b in range(256))], np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little").tobytes()
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8").tobytes()
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = (int(x) for x in np.frombuffer(data[:32], "<u8"))
        return cls(n, low_bits, data[32 : 32 + a], data[32 + a : 32 + a + b], np.frombuffer(data[32 + a + b :], "<u4"))

    def select(self, at: np.ndarray) -> np.ndarray:
        """The values at these places, each read from its sample on."""
        at = np.asarray(at, np.int64)
        if len(at) and (int(at.min()) < 0 or int(at.max()) >= self.n):
            raise IndexError("no such place")
        high = np.frombuffer(self.high, np.uint8)
        ones = np.bitwise_count(high).astype(np.int64)
        sample = self.samples.astype(np.int64)[at // SAMPLE]
        byte = sample >> 3
        # Set bits to pass from the byte's begin on; those before the sample count as passed.
        left = at % SAMPLE + np.bitwise_count(high[byte] & ((1 << (sample & 7)) - 1).astype(np.uint8)).astype(np.int64)
        live = np.flatnonzero(left >= ones[byte])
        while len(live):
            left[live] -= ones[byte[live]]
            byte[live] += 1
            live = live[left[live] >= ones[byte[live]]]
        return (byte * 8 + _IN_BYTE[high[byte], left] - at << self.low_bits) | self._low(at)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.int64)
        first = at * self.low_bits
        padded = np.frombuffer(self.low + bytes(9), np.uint8)
        near = np.lib.stride_tricks.sliding_window_view(padded, 8)[first >> 3].copy().view("<u8").ravel()
        shift = (first & 7).astype(np.uint64)
        ninth = padded[(first >> 3) + 8].astype(np.uint64)
        wide = (near >> shift) | np.where(shift > 0, ninth << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (wide & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Encode sorted documents; cut segments at document ends."""
    schema = pa.schema(
        [("part", pa.int32()), ("chunk", pa.int32()), ("first_in_part", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()),
         ("n_ids", pa.int64()), ("first_id", pa.int64()), ("doc_ids", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()),
         ("bounds", pa.binary())]
    )
    part, chunk, before = TaskContext.get().partitionId(), 0, 0
    coder = encoder(tokenizer)
    for batch in gathered(batches):
        ids, lengths = with_end(*coder.encode(text_or_empty(batch)))
        names = batch.column("doc_id")
        nulls = names.null_count  # they come first
        known = names.slice(nulls).to_numpy()
        ends = np.cumsum(lengths)
        i = 0
        while i < len(ends):
            base = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT_IDS, "right")))
            n_null = max(0, min(j, nulls) - i)
            first = int(known[i + n_null - nulls]) if j > i + n_null else 0
            if j > i + n_null:
                j = nulls + int(np.searchsorted(known[: j - nulls], min(first + WIDEST, 2**63 - 1), "right"))
            own = ids[base : ends[j - 1]]
            width = 2 if int(own.max()) < 1 << 16 else 4
            row = {
                "part": part, "chunk": chunk, "first_in_part": before, "n_docs": j - i, "n_null": n_null, "n_ids": len(own),
                "first_id": first, "doc_ids": EliasFano.encode(known[i + n_null - nulls : j - nulls] - first if j > i + n_null else []).to_bytes(),
                "width": width, "ids": own.astype(f"<u{width}").tobytes(), "bounds": EliasFano.encode(ends[i:j] - base).to_bytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=schema)
            before += len(own)
            chunk += 1
            i = j


def write_segments(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode documents (doc_id, text) in doc_id order and store the segments' table."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The text's hash lets ranges split a doc_id that has many rows.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    ordered = keyed.repartitionByRange(parts, "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    with bounded_batches(spark):
        return materialize(ordered.mapInArrow(lambda it: _segments(it, tokenizer), SEGMENTS), "ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            every = np.arange(row["n_docs"])
            ends = EliasFano.from_bytes(row["bounds"]).select(every)
            names = EliasFano.from_bytes(row["doc_ids"]).select(every[row["n_null"] :] - row["n_null"]) + row["first_id"]
            starts = np.concatenate([[0], ends[:-1]])
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(ends), pa.int32()), pa.array([None] * row["n_null"] + names.tolist(), pa.int64()),
                 pa.array(starts + row["first_in_part"], pa.int64()), pa.array(ends - starts, pa.int64()),
                 pa.array(crc, pa.int64())],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )


def read_documents(segments: DataFrame) -> DataFrame:
    """Each document's place and checksum, from the stored segments alone."""
    rows = segments.drop("chunk", "n_ids").mapInArrow(_read, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = (
        segments.groupBy("part")
        .agg(F.sum("n_ids").alias("n_ids"))
        .select("part", F.coalesce(F.sum("n_ids").over(over), F.lit(0)).alias("part_start"))
    )
    placed = rows.join(parts, "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
    with bounded_batches(segments.sparkSession, rows=4):
        return materialize(placed, "places")


__all__ = ["END_ID", "EliasFano", "read_documents", "write_segments"]
