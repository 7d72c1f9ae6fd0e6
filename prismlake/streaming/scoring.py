"""Structured Streaming scoring.

Prediction is stateless (align -> transform -> dot product -> floor), so the same
operator runs on ``readStream`` input.  The fitted coefficient table is a static
DataFrame joined to every micro-batch (stream-static join).  Progress and output
live under the shared checkpoint folder, so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.operators.predict import batch_predict
from prismlake.sources.files import scratch_path


def stream_predict(stream: DataFrame, models: DataFrame, transform=None) -> DataFrame:
    """Streaming DataFrame of predictions (dataset, sample_id, ..., y_pred)."""
    src = transform(stream) if transform else stream
    return batch_predict(src, models)


def run_available_now(spark: SparkSession, scored: DataFrame, name: str = "stream-predict") -> str:
    """Process everything currently available, write parquet, return the sink path."""
    sink = scratch_path(spark, name)
    q = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", sink + "-checkpoint")
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return sink
