"""Structured Streaming ingestion: landed feed segments to typed tables, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import quality_signals
from ..sources import feed


def feed_stream(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Lines of immutable, rotated segments `<feed>/<n>.jsonl` as they land; a bounded amount per trigger."""
    return (
        spark.readStream.schema("value STRING").option("recursiveFileLookup", "true").option("maxBytesPerTrigger", str(max_bytes)).text(path)
        .select(
            F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("feed"),
            F.coalesce(F.regexp_extract("_metadata.file_name", r"(\d+)\D*$", 1).try_cast("bigint"), F.lit(0)).alias("segment"),
            F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    )


def parsed(batch: DataFrame) -> DataFrame:
    """Records of one micro-batch."""
    return feed.feed_scan(batch.select("feed", F.struct("segment", "block", F.monotonically_increasing_id().alias("row")).alias("seq"), "line"))


def silver_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of one micro-batch; no raw text or content leaves here."""
    return {
        "stats": feed.feed_stats(records), "points": feed.metric_points(records), "spans": feed.file_spans(records),
        "signals": quality_signals(feed.log_events(records)),
    }


def land(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch under `<table>/batch=<id>`; a replayed batch replaces its own files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        held = parsed(batch).persist()
        try:
            for name, table in silver_tables(held).items():
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
