"""Relational stores: trace stores with key-value attributes, and the CLI session store.

Columns vary by version; what a store lacks reads as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .feed import span_columns, valid_spans
from .once import computed_once
from ..functions.parsing import MAX_OPTIONS_CHARS, date_only, in_rolling_window, timestamp_ms, usage_day
from ..functions.names import repository_name
from ..functions.values import reported_nano, short_text, span_failed, token_count

# Attributes read as numbers, and as short texts.
NUMERIC_KEYS = [
    "copilot_chat.request.max_prompt_tokens", "copilot_chat.turn_count", "copilot_chat.copilot_usage_nano_aiu",
    "gen_ai.usage.reasoning.output_tokens", "github.copilot.nano_aiu", "github.copilot.cost", "github.copilot.turn_count",
    "gen_ai.response.time_to_first_chunk", "gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write.input_tokens",
]
TEXT_KEYS = [
    "copilot_chat.parent_chat_session_id", "copilot_chat.debug_log_label", "github.copilot.git.repository",
    "github.copilot.git.branch", "copilot_chat.repo.remote_url", "copilot_chat.repo.head_branch_name", "user.name",
    "enduser.pseudo.id", "gen_ai.request.reasoning.level", "server.address",
]
OPTIONS_KEY = "copilot_chat.request.options"
# Store column behind each attribute.
COLUMN_OF = {
    "gen_ai.operation.name": "operation_name", "gen_ai.tool.name": "tool_name", "gen_ai.conversation.id": "conversation_id",
    "copilot_chat.chat_session_id": "chat_session_id", "gen_ai.request.model": "request_model",
    "gen_ai.response.model": "response_model", "gen_ai.usage.input_tokens": "input_tokens",
    "gen_ai.usage.output_tokens": "output_tokens", "gen_ai.usage.cache_read.input_tokens": "cached_tokens",
    "gen_ai.usage.reasoning_tokens": "reasoning_tokens", "copilot_chat.time_to_first_token": "ttft_ms", "gen_ai.agent.name": "agent_name",
}


def select_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, cast; a column the store lacks is NULL."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()
    ])


def attr_pivot(attributes: DataFrame) -> DataFrame:
    """span_id and attrs MAP of the listed keys; only the effort word is taken from the options blob.

    At most one entry per listed key and span remains, so the collected list is bounded by the key list.
    """
    small = F.when(F.length("value") <= MAX_OPTIONS_CHARS, F.try_parse_json("value"))
    effort = F.coalesce(F.try_variant_get(small, "$.reasoning.effort", "string"), F.try_variant_get(small, "$.reasoning_effort", "string"))
    options = F.when(effort.isNotNull(), F.to_json(F.struct(F.struct(effort.alias("effort")).alias("reasoning"))))
    kept = attributes.where(F.col("key").isin(*NUMERIC_KEYS, *TEXT_KEYS, OPTIONS_KEY)).select(
        "span_id", "key", F.when(F.col("key") == OPTIONS_KEY, options).otherwise(F.col("value")).alias("value")
    ).where(F.col("value").isNotNull())
    one = kept.groupBy("span_id", "key").agg(F.max("value").alias("value"))
    return one.groupBy("span_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attrs"))


def span_store_scan(spans: DataFrame, attributes: DataFrame, since_ms: int) -> DataFrame:
    """Canonical spans of a trace store within the window. The column filter reaches the Parquet scan."""
    typed = {c: "string" for c in (
        "span_id", "trace_id", "parent_span_id", "operation_name", "tool_name", "conversation_id", "chat_session_id",
        "request_model", "response_model", "agent_name", "status_code")}
    typed |= {c: "double" for c in ("start_time_ms", "end_time_ms", "input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "ttft_ms")}
    links = "parent_span_id" in spans.columns
    rows = select_or_null(spans.where(F.col("start_time_ms") >= since_ms), typed)
    joined = rows.join(attr_pivot(attributes), "span_id", "left")
    attrs = F.col("attrs")

    def read_text(name: str) -> Column:
        return F.coalesce(attrs[name], F.col(COLUMN_OF[name])) if name in COLUMN_OF else attrs[name]

    def read_number(name: str) -> Column:
        given = F.trim(attrs[name]).try_cast("double")
        return F.coalesce(given, F.col(COLUMN_OF[name])) if name in COLUMN_OF else given

    operation = short_text(F.col("operation_name"))
    out = joined.select(
        short_text(F.col("span_id")).alias("span_id"), operation.alias("operation"), short_text(F.col("trace_id")).alias("trace_id"),
        short_text(F.col("parent_span_id")).alias("parent_span_id"),
        (F.lit(links) & (F.col("parent_span_id").isNull() | short_text(F.col("parent_span_id")).isNotNull())).alias("parent_known"),
        F.col("start_time_ms").alias("start_ms"), F.col("end_time_ms").alias("end_ms"),
        *span_columns(read_text, read_number, operation), span_failed(F.col("status_code")).alias("failed"),
    )
    return valid_spans(out.withColumn("user_source", F.when(F.col("user_name").isNotNull(), F.lit("span"))))


def span_ancestors(spans: DataFrame, since_ms: int) -> DataFrame:
    """Parent links of spans without an operation; they only serve root classification."""
    if "parent_span_id" not in spans.columns:
        return spans.select("span_id").limit(0).selectExpr(
            "span_id", "CAST(NULL AS STRING) trace_id", "CAST(NULL AS STRING) parent_span_id", "false AS parent_known")
    rows = select_or_null(spans.where(F.col("start_time_ms") >= since_ms), {c: "string" for c in ("span_id", "trace_id", "parent_span_id", "operation_name")})
    return rows.where(F.coalesce("operation_name", F.lit("")) == "").select(
        short_text(F.col("span_id")).alias("span_id"), short_text(F.col("trace_id")).alias("trace_id"),
        short_text(F.col("parent_span_id")).alias("parent_span_id"),
        (F.col("parent_span_id").isNull() | short_text(F.col("parent_span_id")).isNotNull()).alias("parent_known"),
    ).where(F.col("span_id").isNotNull())


# ---- CLI session store --------------------------------------------------------------------------

EVENT_COLUMNS = {
    "session_id": "string", "agent_id": "string", "model": "string", "input_tokens": "double", "output_tokens": "double",
    "cache_read_tokens": "double", "cache_write_tokens": "double", "reasoning_tokens": "double", "total_nano_aiu": "string",
    "initiator": "string", "reasoning_effort": "string", "created_at": "string",
}


def store_status(tables: dict[str, DataFrame]) -> tuple[str, list[str]]:
    """('ok' | 'schema' | 'missing', notes) from the tables found, without reading them."""
    if not tables:
        return "missing", ["the session store was not found"]
    events = tables.get("assistant_usage_events")
    if events is None or "session_id" not in events.columns:
        return "schema", ["assistant_usage_events is missing or lacks session_id"]
    notes = ["No user identity is stored per session"]
    if "created_at" not in events.columns:
        notes.append("created_at is missing, so the window cannot be applied")
    refs = tables.get("session_refs")
    if refs is None or not {"session_id", "ref_type"} <= set(refs.columns):
        notes.append("session_refs is missing or lacks session_id / ref_type")
    return "ok", notes


def usage_context(tables: dict[str, DataFrame], cutoff_ms: int | None) -> DataFrame:
    """Usage events with their session's work context and reference flags, never fanned out."""
    raw = tables["assistant_usage_events"]
    created = F.col("created_at")
    events = computed_once(select_or_null(raw, EVENT_COLUMNS), at_ms=timestamp_ms(created), dated=date_only(created))
    if "created_at" in raw.columns and cutoff_ms is not None:
        events = events.where(in_rolling_window(F.col("at_ms"), F.col("dated"), cutoff_ms))
    refs = tables.get("session_refs")
    out = events.select(
        "session_id", "agent_id", "model", *[token_count(F.col(c)).alias(o) for c, o in (
            ("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_tokens", "cached"),
            ("cache_write_tokens", "cache_write"), ("reasoning_tokens", "reasoning"))],
        reported_nano(F.col("total_nano_aiu")).alias("nano"), "initiator", "reasoning_effort",
        "at_ms", usage_day(F.col("at_ms"), F.col("dated")).alias("day"),
    )
    if "sessions" in tables:
        sessions = select_or_null(tables["sessions"], {"id": "string", "repository": "string", "branch": "string"})
        one = sessions.groupBy(F.col("id").alias("session_id")).agg(F.any_value("repository").alias("r"), F.any_value("branch").alias("b"))
        work = one.select("session_id", repository_name(F.col("r")).alias("repository"), short_text(F.col("b")).alias("branch"))
        out = out.join(work, "session_id", "left")
    else:
        out = out.selectExpr("*", "CAST(NULL AS STRING) AS repository", "CAST(NULL AS STRING) AS branch")
    if refs is not None and {"session_id", "ref_type"} <= set(refs.columns):
        flags = refs.groupBy("session_id").agg(
            F.bool_or(F.col("ref_type").isin("issue", "commit", "pr")).alias("has_work_ref"), F.bool_or(F.col("ref_type") == "pr").alias("has_pr"))
        return out.join(flags, "session_id", "left").select(
            *out.columns, F.coalesce("has_work_ref", F.lit(False)).alias("has_work_ref"), F.coalesce("has_pr", F.lit(False)).alias("has_pr"))
    return out.selectExpr("*", "CAST(NULL AS BOOLEAN) AS has_work_ref", "CAST(NULL AS BOOLEAN) AS has_pr")


def session_store_report(spark: SparkSession, tables: dict[str, DataFrame], cutoff_ms: int | None) -> DataFrame:
    """One row of what a session store can tell: status, notes, and calls in the window with what they report.

    A store that cannot be read tells so instead of reporting zero calls.
    """
    status, notes = store_status(tables)
    told = [F.lit(status).alias("status"), F.array(*[F.lit(n) for n in notes]).alias("notes")]
    if status != "ok":
        unknown = [F.lit(None).cast("bigint").alias(c) for c in ("calls", "dated_calls", "credited_calls", "linked_calls")]
        return spark.range(1).select(*told, *unknown)
    usage = usage_context(tables, cutoff_ms)
    linked = F.col("has_work_ref")
    return usage.agg(
        F.count(F.lit(1)).alias("calls"), F.count("at_ms").alias("dated_calls"), F.count("nano").alias("credited_calls"),
        F.when(F.count(linked) == 0, F.lit(None).cast("bigint")).otherwise(F.count_if(linked)).alias("linked_calls"),
    ).select(*told, "calls", "dated_calls", "credited_calls", "linked_calls")
