"""Closed usage windows of a stream, written once each; late rows and expired state from the query's progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_closed(windows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append windows once the watermark has passed their end. `windows` aggregates a stream with a watermark."""
    return windows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_counts(query: StreamingQuery) -> dict[str, int]:
    """Rows that came too late, state rows that expired, and state rows that are left, of an ended run."""
    steps = [s for p in query.recentProgress for s in p["stateOperators"]]
    return {
        "late": sum(s["numRowsDroppedByWatermark"] for s in steps), "expired": sum(s["numRowsRemoved"] for s in steps),
        "left": steps[-1]["numRowsTotal"] if steps else 0,
    }
