"""Span identity: de-duplicate, merge copies from several stores, keep runtime traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Columns where the store's known value wins and the file copy fills gaps.
KNOWN_FIRST = [
    "operation", "conversation_id", "trace_id", "model", "start_ms", "end_ms", "input", "output", "cached",
    "cache_write", "reasoning", "nano", "sdk_nano", "ttft_ms", "first_chunk_ms", "turns", "tool", "prompt_limit",
    "agent", "parent_session_id", "effort", "repository", "branch", "user_name", "actor_id", "failed", "host",
]
FLAGS = ["sdk", "auxiliary", "parent_known"]


def span_dedup(spans: DataFrame) -> DataFrame:
    """First copy of each span in input order. Partial aggregation collapses copies before the shuffle."""
    rest = [c for c in spans.columns if c != "span_id"]
    first = spans.groupBy("span_id").agg(F.min_by(F.struct(*rest), F.struct("ord")).alias("s"))
    return first.select("span_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def span_merge(file: DataFrame, store: DataFrame) -> DataFrame:
    """Full outer merge by span id; both sides hold one row per span."""
    f, s = file.alias("f"), store.alias("s")

    def pick(name: str) -> Column:
        return F.coalesce(F.col(f"s.{name}"), F.col(f"f.{name}"))

    def either(name: str) -> Column:
        return F.coalesce(F.col(f"s.{name}"), F.lit(False)) | F.coalesce(F.col(f"f.{name}"), F.lit(False))

    native = pick("native_session_id")
    out = [
        pick("span_id").alias("span_id"), F.coalesce(F.col("f.ord"), F.col("s.ord")).alias("ord"), native.alias("native_session_id"),
        F.coalesce(native, pick("session_id")).alias("session_id"),
        F.when(F.coalesce(F.col("s.parent_known"), F.lit(False)) | F.col("f.span_id").isNull(), F.col("s.parent_span_id"))
        .otherwise(F.col("f.parent_span_id")).alias("parent_span_id"),
        F.when(F.col("s.user_name").isNotNull(), F.col("s.user_source")).otherwise(F.col("f.user_source")).alias("user_source"),
        *[pick(c).alias(c) for c in KNOWN_FIRST], *[either(c).alias(c) for c in FLAGS],
    ]
    merged = f.join(s, F.col("f.span_id") == F.col("s.span_id"), "full_outer").select(*out)
    return merged.select(*[c for c in file.columns if c in merged.columns])


def harness_only(agent_host: DataFrame, *local: DataFrame) -> DataFrame:
    """Ids the agent host recorded that no local source holds."""
    seen = local[0].select("span_id")
    for df in local[1:]:
        seen = seen.unionByName(df.select("span_id"))
    return agent_host.select("span_id").distinct().join(seen, "span_id", "left_anti")


def span_union(file: DataFrame, local_store: DataFrame, agent_host: DataFrame, cutoff_ms: int) -> DataFrame:
    """File feed, then the local store, then the agent-host store, merged by id inside the window."""
    kept = [df.where(F.col("start_ms") >= cutoff_ms) for df in (file, local_store, agent_host)]
    return span_merge(span_merge(kept[0], kept[1]), kept[2])


def runtime_only(spans: DataFrame, attributes: DataFrame, marker: str = "github.copilot.") -> DataFrame:
    """Spans of traces that carry at least one runtime attribute."""
    marked = (
        attributes.where(F.col("key").startswith(marker)).select("span_id")
        .join(spans.select("span_id", "trace_id"), "span_id").select("trace_id").distinct()
    )
    return spans.join(marked, "trace_id", "left_semi")


def retention(spans: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    return spans.where(F.col("start_ms") >= now_ms - days * 86_400_000)
