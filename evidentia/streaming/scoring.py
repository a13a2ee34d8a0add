"""Scoring streams with fitted models.

The reference work has no streaming of its own. Scoring with a fitted network is stateless (joins
with fixed tables), so the batch ``transform`` serves a stream as it is; fitting stays batch.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model: Model, stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Score a streaming table into files; each trigger takes what has arrived, then stops."""
    if not stream.isStreaming:
        raise ValueError("a streaming table is needed; use transform for a batch table")
    return (
        model.transform(stream)
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
