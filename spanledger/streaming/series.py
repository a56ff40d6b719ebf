"""Verdicts on metric points of a stream: the running maximum of each series goes from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import counters
from .carried import Carried

KEYS = "feed STRING, session STRING, start_ms BIGINT, metric STRING, series_key STRING"


def late_feed(points: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write every batch of counter points with `ok` and `late` under `verdicts/batch=<id>`.

    Batches arrive in the order of `seq`; rows within a batch need no order.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        marks = Carried(batch.sparkSession, f"{out}/marks", f"{KEYS}, opened_at BIGINT, mark BIGINT", counters.SERIES, {"opened_at": F.any_value("opened_at"), "mark": F.max("mark")})
        path = f"{out}/verdicts/batch={batch_id}"
        rows = counters.judged_after(batch, marks.before(batch_id))
        rows.write.mode("overwrite").parquet(path)
        told = batch.sparkSession.read.schema(rows.schema).parquet(path)
        marks.step(batch_id, told.groupBy(*counters.SERIES).agg(F.any_value("opened_at").alias("opened_at"), F.max(F.when(F.col("ok"), F.col("at_ms"))).alias("mark")))

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
