"""Usage in event-time windows: tumbling, sliding and session windows, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MEASURES = ["calls", "input", "input_calls", "output", "output_calls", "nano", "credit_calls"]


def timed_calls(spans: DataFrame) -> DataFrame:
    """Model calls with their time as a timestamp."""
    return spans.where(F.col("operation") == "chat").withColumn("at", F.timestamp_millis("start_ms"))


def _usage(calls: DataFrame, window: Column, by: list[str]) -> DataFrame:
    """Sums stay NULL where nothing was reported; the counts beside them tell how many calls did."""
    return calls.groupBy(window.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.count("input").alias("input_calls"), F.sum("output").alias("output"),
        F.count("output").alias("output_calls"), F.sum("nano").alias("nano"), F.count("nano").alias("credit_calls"),
    ).select(F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), *by, *MEASURES)


def usage_windows(calls: DataFrame, size: str = "1 hour", slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Usage per window of `size`; windows that start every `slide` overlap, without it they tumble."""
    return _usage(calls, F.window("at", size, slide or size), by or [])


def usage_sessions(calls: DataFrame, gap: str = "30 minutes", by: list[str] | None = None) -> DataFrame:
    """Usage per stretch of activity: calls of a key no further apart than `gap`, which also follows the last call."""
    return _usage(calls, F.session_window("at", gap), by or ["session_id"])
