"""Shared steps of the conversation operators: ordering and digests of unbounded groups.

One conversation may hold any share of all rows, so no step here puts a whole group into
one task: rows are sorted by range (a long group lies in several partitions), and a digest
over a group is made from packed parts, of which the last step reads a few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import materialize

BLOB_BYTES = 1 << 18       # size of the packed parts of a digest


def crc32_mod(text: Column, n: int) -> Column:
    return (F.crc32(text.cast("binary")) % n).cast("int")


def sorted_parts(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` written in parts by range of (``key``, ``order``), sorted: adds ``_part`` and
    ``_i``, the number of a row, which both grow in that order.  Rows that are equal in all
    of it are interchangeable and lie side by side."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    total = [F.col(key).asc(), *order, F.col("_tie").asc()]
    sorted_rows = spread.repartitionByRange(*total).sortWithinPartitions(*total).drop("_tie")
    return materialize(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_i")))


def pack_in_order(rows: DataFrame, keys: list[str], text: str, part: Column, sep: str) -> DataFrame:
    """Joins the ``text`` of consecutive rows of a group into parts of about ``BLOB_BYTES``:
    keys, part, no, blob.  The rows of a partition must lie group by group, in order; a
    group may go on in partitions of higher ``part``."""
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", part long, no long, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = out_schema = None
        out: list[tuple] = []
        current, texts, size, no = None, [], 0, 0

        def close() -> None:
            nonlocal texts, size, no
            if texts:
                out.append((*current, no, sep.join(texts).encode()))
                texts, size, no = [], 0, no + 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * (len(keys) + 3)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target)], schema=out_schema)

        for batch in batches:
            if target is None:
                target = [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.int64(), pa.binary()]
                out_schema = pa.schema(list(zip([*keys, "part", "no", "blob"], target)))
            for *group, value in zip(*(batch.column(c).to_pylist() for c in [*keys, "_in", "_text"])):
                if group != current:
                    close()
                    current, no = group, 0
                if size > BLOB_BYTES:
                    close()
                texts.append(value)
                size += len(value)
            if len(out) > 1000:
                yield flush()
        if target is not None:
            close()
            yield flush()

    return rows.select(*keys, part.cast("long").alias("_in"), F.col(text).alias("_text")).mapInArrow(run, schema)


def digest_parts(parts: DataFrame, keys: list[str], sep: str) -> DataFrame:
    """SHA-256 of each group's parts, joined by ``sep`` in order of (part, no): keys, sha256.
    A group of one part is digested at once; of others, one task reads the packed parts as
    a stream."""
    parts = materialize(parts)
    number = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = parts.alias("p").join(number.alias("n"), same).select("p.*", "n._n")
    single = joined.where("_n = 1").select(*keys, F.sha2("blob", 256).alias("sha256"))
    fields = [parts.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, target = None, None, None
        out: list[tuple] = []
        for batch in batches:
            target = [batch.schema.field(k).type for k in keys] + [pa.string()]
            for i in range(batch.num_rows):
                group = [batch.column(k)[i].as_py() for k in keys]
                blob = batch.column("blob")[i].as_py()
                if group != current:
                    if digest:
                        out.append((*current, digest.hexdigest()))
                    current, digest = group, hashlib.sha256(blob)
                else:
                    digest.update(sep.encode())
                    digest.update(blob)
        if digest:
            out.append((*current, digest.hexdigest()))
        if target is not None:
            columns = list(zip(*out)) if out else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target)], names=[*keys, "sha256"])

    many = joined.where("_n > 1").repartition(*keys).sortWithinPartitions(*keys, "part", "no").drop("_n")
    return single.unionByName(many.mapInArrow(run, schema))


def ordered_digest(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str) -> DataFrame:
    """SHA-256 of ``text`` joined by ``sep`` in ``order``, for each group of ``keys``."""
    spread = rows.repartitionByRange(*(F.col(c) for c in [*keys, *order])).sortWithinPartitions(*keys, *order)
    return digest_parts(pack_in_order(spread, keys, text, F.spark_partition_id(), sep), keys, sep)
