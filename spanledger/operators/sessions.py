"""Per-session rollups of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import work_label
from ..functions.values import credit_sum
from .tally import chat

LABEL_NAMES = 3


def session_rollup(spans: DataFrame) -> DataFrame:
    """One row per session; all aggregates combine map-side, so a hot session is no problem.

    The model is that of the latest-ending span naming one; equal ends are
    settled by start and input order.
    """
    is_chat = F.col("operation") == "chat"
    last = F.struct("end_ms", "start_ms", "ord")

    def of_chat(value: Column) -> Column:
        return F.when(is_chat, value)

    def tokens(name: str) -> Column:
        return F.coalesce(F.sum(of_chat(F.col(name))), F.lit(0)).cast("bigint")

    agent_named = (F.col("operation") == "invoke_agent") & F.col("agent").isNotNull()
    return spans.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.min("start_ms").alias("started_ms"), F.max("end_ms").alias("ended_ms"),
        (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"),
        F.max_by("model", F.when(F.col("model").isNotNull(), last)).alias("model"),
        F.max_by("agent", F.when(agent_named, F.col("ord"))).alias("agent_name"),
        F.count_if(is_chat).alias("llm_calls"), F.count_if(F.col("operation") == "execute_tool").alias("tool_calls"),
        tokens("input").alias("input"), tokens("output").alias("output"), tokens("cached").alias("cached"),
        credit_sum(of_chat(F.col("nano"))).alias("credits"), F.count(of_chat(F.col("nano"))).alias("credit_calls"),
        F.count_if(is_chat & F.col("input").isNotNull() & F.col("output").isNotNull()).alias("token_calls"),
        F.coalesce(F.sum(of_chat(F.col("end_ms") - F.col("start_ms"))), F.lit(0)).cast("bigint").alias("active_ms"),
    )


def distinct_users(spans: DataFrame) -> DataFrame:
    """(session_id, position, user_name): each session's agent users in first-seen order."""
    seen = (
        spans.where((F.col("operation") == "invoke_agent") & F.col("user_name").isNotNull() & F.col("session_id").isNotNull())
        .groupBy("session_id", "user_name").agg(F.min(F.struct("start_ms", "ord")).alias("first"))
    )
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("first"))
    return seen.select("session_id", place.alias("position"), "user_name")


def session_users(spans: DataFrame) -> DataFrame:
    """(session_id, users, user_label): up to three names, then "+N more"."""
    named = distinct_users(spans).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("users"),
        *[F.max(F.when(F.col("position") == i, F.col("user_name"))).alias(f"n{i}") for i in range(1, LABEL_NAMES + 1)],
    )
    more = F.when(F.col("users") > LABEL_NAMES, F.concat(F.lit("+"), (F.col("users") - LABEL_NAMES).cast("string"), F.lit(" more")))
    return named.select("session_id", "users", F.concat_ws(", ", "n1", "n2", "n3", more).alias("user_label"))


def session_work(spans: DataFrame) -> DataFrame:
    """Work context of each session's latest agent span that names one, with its users."""
    has_work = (F.col("operation") == "invoke_agent") & F.coalesce("repository", "branch").isNotNull()
    work = (
        spans.where(has_work & F.col("session_id").isNotNull()).groupBy("session_id")
        .agg(F.max_by(F.struct("repository", "branch"), F.struct("start_ms", "ord")).alias("w"))
        .select("session_id", F.col("w.repository").alias("repository"), F.col("w.branch").alias("branch"))
    )
    joined = work.join(session_users(spans), "session_id", "full_outer")
    return joined.withColumn("work", work_label(F.col("repository"), F.col("branch")))


def latest_call(spans: DataFrame) -> DataFrame:
    """Latest non-auxiliary chat per session ('' holds sessionless calls); the earlier row wins equal starts."""
    return (
        chat(spans).where(~F.col("auxiliary")).groupBy(F.coalesce("session_id", F.lit("")).alias("session_id"))
        .agg(F.max_by(
            F.struct("model", "effort", "prompt_limit", "host", "input", F.col("start_ms").alias("at_ms"), "ord"),
            F.struct("start_ms", -F.col("ord")),
        ).alias("c"))
        .select("session_id", "c.model", "c.effort", "c.prompt_limit", "c.host", "c.input", "c.at_ms", "c.ord")
    )


def newest(rows: DataFrame) -> DataFrame:
    """The single newest row by instant, then input order: a one-row aggregate."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct("at_ms", -F.col("ord"))).alias("r")).where(
        F.col("r").isNotNull()
    ).select("r.*")


def prompt_context(latest: DataFrame) -> DataFrame:
    """Prompt occupancy of each latest call; a call without limit or input has no context."""
    return latest.where((F.col("prompt_limit") > 0) & F.col("input").isNotNull()).select(
        "session_id", F.col("input").alias("used"), F.col("prompt_limit").alias("limit"), "model", "at_ms", "ord"
    )


def session_compare(transcripts: DataFrame, traces: DataFrame) -> DataFrame:
    """Full outer join of transcript and trace sessions. Their credits stay side by side.

    transcripts: session_id, title, updated_ms, credits, model. traces:
    session_rollup plus repository and branch.
    """
    t = transcripts.select("session_id", "title", "updated_ms", F.col("credits").alias("transcript_credits"))
    s = traces.select(
        "session_id", "ended_ms", F.col("credits").alias("trace_credits"), F.col("input").alias("trace_input"),
        F.col("output").alias("trace_output"), work_label(F.col("repository"), F.col("branch")).alias("work"),
        F.lit(True).alias("traced"),
    )
    return t.join(s, "session_id", "full_outer").select(
        "session_id", F.col("title").alias("name"), F.greatest("updated_ms", "ended_ms").alias("updated_ms"),
        "transcript_credits", "trace_credits", "trace_input", "trace_output", "work",
        F.coalesce("traced", F.lit(False)).alias("traced"),
    )


def session_select(sessions: DataFrame, pinned: str | None) -> DataFrame:
    """The pinned session; a missing pin is an empty row with that id, no pin is no row."""
    spark = sessions.sparkSession
    pin = spark.range(1).select(F.lit(pinned).cast("string").alias("session_id")).where(F.col("session_id").isNotNull())
    found = sessions.where(F.col("session_id") == F.lit(pinned))
    return pin.join(found, "session_id", "left").withColumn("updated_ms", F.coalesce("updated_ms", F.lit(0).cast("bigint")))
