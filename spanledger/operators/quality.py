"""Quality signals: log events as instrument measurements, tool outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json as j
from ..functions.values import MAX_SAFE_INTEGER

# Instrument names.
EDIT_ACCEPTANCE = "copilot_chat.edit.acceptance.count"
CHAT_EDIT_OUTCOME = "copilot_chat.chat_edit.outcome.count"
LINES_OF_CODE = "copilot_chat.lines_of_code.count"
SURVIVAL_FOUR_GRAM = "copilot_chat.edit.survival.four_gram"
SURVIVAL_NO_REVERT = "copilot_chat.edit.survival.no_revert"
PULL_REQUESTS = "copilot_chat.pull_request.count"
CLOUD_SESSIONS = "copilot_chat.cloud.session.count"
USER_FEEDBACK = "copilot_chat.user.feedback.count"
USER_ACTIONS = "copilot_chat.user.action.count"
EDIT_RESPONSES = "copilot_chat.agent.edit_response.count"
SUMMARIZATIONS = "copilot_chat.agent.summarization.count"
TOOL_CALL_COUNT = "copilot_chat.tool.call.count"
SDK_TOOL_CALL_COUNT = "github.copilot.tool.call.count"
OUTCOME = "copilot_chat.edit.outcome"


def _signal(when: Column, metric: str, value: Column, key: str | None = None, tag: Column | None = None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    attrs = F.create_map(F.lit(key), tag) if key else empty
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), attrs.alias("attrs")))


def quality_signals(events: DataFrame) -> DataFrame:
    """events: name, attributes VARIANT. Rows (metric, value, attrs) of the seven known events; unknown outcomes are dropped."""
    a, one = F.col("attributes"), F.lit(1.0)
    outcome, rating = j.text(a, "outcome"), j.text(a, "rating")

    def named(name: str) -> Column:
        return F.col("name") == name

    decided = outcome.isin("accepted", "rejected")
    hunk = named("copilot_chat.edit.hunk.action")
    inline = j.flag(a, "accepted")
    kept_branch = ~F.coalesce(j.flag(a, "did_branch_change"), F.lit(False))
    success = j.flag(a, "success")
    signals = [
        _signal((named("copilot_chat.edit.feedback") | hunk) & decided, EDIT_ACCEPTANCE, one, OUTCOME, outcome),
        _signal(named("copilot_chat.inline.done") & inline.isNotNull(), EDIT_ACCEPTANCE, one, OUTCOME,
                F.when(inline, F.lit("accepted")).otherwise(F.lit("rejected"))),
        _signal(named("copilot_chat.user.feedback") & rating.isin("positive", "negative"), USER_FEEDBACK, one, "rating", rating),
        _signal(named("copilot_chat.cloud.session.invoke"), CLOUD_SESSIONS, one),
        _signal(named("copilot_chat.tool.call") & success.isNotNull(), TOOL_CALL_COUNT, one, "success", success.cast("string")),
    ]
    for kind in ("added", "removed"):
        lines = j.number(a, f"lines_{kind}")
        whole = (lines >= 0) & (lines == F.floor(lines)) & (lines <= MAX_SAFE_INTEGER)
        signals.append(_signal(hunk & (outcome == "accepted") & whole, LINES_OF_CODE, lines, "type", F.lit(kind)))
    for field, metric in (("survival_rate_four_gram", SURVIVAL_FOUR_GRAM), ("survival_rate_no_revert", SURVIVAL_NO_REVERT)):
        rate = j.number(a, field)
        signals.append(_signal(named("copilot_chat.edit.survival") & kept_branch & rate.between(0, 1), metric, rate))
    # The outer form keeps the optimizer from evaluating the whole array a second time as a filter.
    return events.select(F.explode_outer(F.array(*signals)).alias("s")).where(F.col("s").isNotNull()).select("s.*")


def tool_status(spans: DataFrame) -> DataFrame:
    """Tool spans with a reported status and the failures among them; no status is unknown, not success."""
    return spans.where(F.col("operation") == "execute_tool").agg(
        F.count("failed").alias("status_calls"), F.count_if("failed").alias("failed"))


def tool_breakdown(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("operation") == "execute_tool").groupBy(F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"), F.count("failed").alias("status_calls"), F.count_if("failed").alias("failed"))
