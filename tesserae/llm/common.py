"""Shared pieces of the text operators: inputs, shared tables, two-level prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.running import materialize, running_before, shared_dir  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """The tables of one operator: keep() those that are its result, drop() the others."""

    def __init__(self, spark: SparkSession, codec: str = "snappy"):
        self.spark = spark
        self.codec = codec
        self.paths: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tesserae-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=self.codec)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, or all; nothing lazy may read them any more."""
        context = self.spark.sparkContext
        gone = [p for p in self.paths if not names or p.rsplit("/tesserae-", 1)[1].rsplit("-", 1)[0] in names]
        for path in gone:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
            self.paths.remove(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let each job run inside delete its shuffle files when it has ended.

    For jobs that write a table each: later ones read the tables, and a lost file of a table's
    own job is made again within that job, as ever.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 8) -> Iterator[None]:
    """Bound the Arrow batches of the jobs run inside, by rows and by bytes.

    Settings count when a job runs, so the jobs must run inside; they are restored behind it.
    """
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(mb << 20),
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def text_or_empty(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A batch's texts as large strings, nulls as empty texts."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def gathered(batches: Iterator[pa.RecordBatch], mb: int = 6) -> Iterator[pa.RecordBatch]:
    """Join small batches and slice large ones to about mb megabytes; a larger row passes alone."""
    held: list[pa.RecordBatch] = []
    size, most = 0, mb << 20
    for whole in batches:
        step = max(1, whole.num_rows * most // max(whole.nbytes, 1))
        for at in range(0, whole.num_rows, step):
            # A copy: text functions of Arrow misread the offsets of slices.
            batch = whole if step >= whole.num_rows else whole.take(pa.array(range(at, min(at + step, whole.num_rows)), pa.int64()))
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
