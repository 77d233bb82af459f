"""Scoring a stream with a saved model: the batch path on an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.artifacts import FittedModel


def score_stream(
    model: FittedModel, stream: DataFrame, path: str, checkpoint: str, keep: list[str] | None = None, **trigger
) -> StreamingQuery:
    """Write predictions of a streaming table as parquet, once each."""
    scored = model.score(stream, keep)
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
