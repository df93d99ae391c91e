"""Flows over streams: stateless, so any flow without choices among rows applies to a streaming root."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.flow import Flow


def apply_stream(flow: Flow, stream: DataFrame, **options) -> DataFrame:
    """The flow's outputs for each row of a streaming root, joined with the tree's static nodes."""
    if not stream.isStreaming:
        raise ValueError("the source is not a stream")
    return flow.load(stream, **options)


def write_stream(out: DataFrame, path: str, checkpoint: str, *, available_now: bool = True):
    """Starts appending to Parquet; with available_now the query ends when the source is read."""
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
