"""One dashboard snapshot as rows, and its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import counters
from ..session import cut
from .sections import cost_section, long_form, period_rollup, quality_section, trace_credits, union
from .speed import speed_section


def snapshot(
    spans: DataFrame, counter_series: DataFrame, histogram_runs: DataFrame, signals: DataFrame, buckets: DataFrame,
    totals: DataFrame, sessions: DataFrame, now_ms: int,
) -> DataFrame:
    """(generated_ms, section, measure, value, text) of cost, speed, quality, credits and period.

    sessions: `session_compare`; its transcript credits are the reported cost.
    """
    none = F.lit(None).cast("string")
    # Each of these feeds several sections; written once, they are not computed again per section.
    counter_series, histogram_runs, buckets, totals, sessions = map(cut, (counter_series, histogram_runs, buckets, totals, sessions))
    series = counters.all_series(counter_series, signals)
    speed = speed_section(spans, counter_series, histogram_runs).select(F.lit("speed").alias("section"), "measure", "value", F.col("source").alias("text"))
    credits = trace_credits(spans).select(
        F.lit("credits").alias("section"), F.concat_ws(": ", "breakdown", "label").alias("measure"), F.col("credits").alias("value"), none.alias("text"))
    reported = sessions.agg(F.sum("transcript_credits").alias("transcript_credits"))
    rows = union(
        cost_section(spans, counter_series, buckets, totals, reported), speed, long_form(quality_section(series, spans), "quality"), credits,
        long_form(period_rollup(sessions, now_ms), "period"))
    return rows.select(F.lit(now_ms).alias("generated_ms"), "section", "measure", "value", "text")


def write_snapshot(rows: DataFrame, path: str) -> None:
    """One directory per snapshot and section; writing the same snapshot again replaces it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generated_ms", "section").parquet(path)


def is_fresh(at_ms, now_ms: int, max_age_ms: int):
    """A reading counts while it is neither from the future nor older than `max_age_ms`."""
    return (F.lit(now_ms) - at_ms).between(0, max_age_ms)
