"""Shared helpers of the training-data operators.

``materialize`` writes an intermediate result as Parquet into the folder all
executors share (``spark.checkpoint.dir``) and reads it back.  That cuts lineage in
a way that survives lost executors, and lets Spark drop the shuffle files of the
step as soon as it is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.session import ensure_checkpoint_dir

# Word separators of the word contracts: space and the control characters 9..13.
WORD_SPACE = "\\x20\\x09-\\x0D"
WORD_PATTERN = f"[^{WORD_SPACE}]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.step_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written steps that no DataFrame still in use reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.step_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of ``column``
    (one row at least), which bounds the working memory of a Python task."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def prefix_sums(arr: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array<int>, as array<bigint>.

    Done block by block, so that growing the result array costs n * block instead of
    n * n element copies.
    """
    n = F.size(arr)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(block)).cast("int")),
                                       lambda b: F.slice(arr, b * block + 1, block))
                    ).otherwise(F.array().cast("array<array<int>>"))

    def running(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(
            (acc["at"] + x).cast("bigint").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
    starts = running(totals, F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, running))
