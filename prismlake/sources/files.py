"""File sources and sinks: delimited text, dataset discovery, run logs, predictions.

Temporary round-trip folders live under the session's checkpoint folder (a shared
filesystem on a cluster), never under a machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.session import ensure_checkpoint_dir

# Fixed value: a run-log line is ``<Prep>_<model>: R2=<r2>, RMSE=<rmse>``.
RUN_LOG_PATTERN = r"^(.*)_([^_:]+): R2=(-?[0-9.]+), RMSE=(-?[0-9.]+)$"


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as rows of a scratch folder, so that what reads it several times computes it once."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch file or folder that no DataFrame still in use reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True,
             sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header; explicit schema when known, else inferred types."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def discover_datasets(spark: SparkSession, path_glob: str, schema: str | None = None,
                      pattern: str = r"([^/]+?)(\.[a-z]+)?/[^/]*$") -> DataFrame:
    """Read every file matched by ``path_glob`` and key rows by dataset, taken from
    the file path with ``pattern`` (default: the folder / file stem)."""
    df = scan_csv(spark, path_glob, schema)
    return df.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def parse_run_log(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Run-log text -> (…, preprocessing, model, r2, rmse); malformed lines dropped.

    A line is split once into label, R2 and RMSE; the pattern is tested in the same
    filter, and fields are read null-safe, so a malformed line cannot raise.
    """
    keep = [c for c in lines.columns if c != line_col]
    # a generator's output is a column that filters above cannot replace by its expression,
    # so a line is built, tested and split once each
    once = lines.select(*keep, F.explode(F.array(F.col(line_col))).alias("_line")).where(F.col("_line").rlike(RUN_LOG_PATTERN))
    split = once.select(*keep, F.explode(F.array(F.split("_line", ": R2=|, RMSE="))).alias("_parts"))
    label, r2, rmse = (F.get("_parts", F.lit(k)) for k in range(3))
    fields = F.struct(label.alias("label"), F.substring_index(label, "_", -1).alias("model"), r2.try_cast("double").alias("r2"),
                      rmse.try_cast("double").alias("rmse"))
    rows = split.where(F.size("_parts") == 3).select(*keep, F.explode(F.array(fields)).alias("x"))
    rows = rows.where(F.col("x.r2").isNotNull() & F.col("x.label").contains("_"))
    preprocessing = F.expr("left(x.label, length(x.label) - length(x.model) - 1)")
    return rows.select(*keep, preprocessing.alias("preprocessing"), "x.model", "x.r2", "x.rmse").where("preprocessing <> ''")


def append_run(summary: DataFrame, path: str) -> None:
    """Append rows of a run to the runs table."""
    summary.write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(spark.read.text(path).withColumnRenamed("value", "line"))


def best_from_log(parsed: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Max-R2 entry per log; ties go to the lower RMSE, then name order."""
    best = F.max_by(F.struct("preprocessing", "model", "r2", "rmse"),
                    F.struct(F.col("r2"), -F.col("rmse"), F.col("preprocessing"), F.col("model")))
    return parsed.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "dataset") -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_text_log(lines: DataFrame, path: str, line_col: str = "line") -> str:
    lines.select(line_col).write.mode("overwrite").text(path)
    return path
