"""Report sections assembled from operators: quality, credits, cost, period, gauge, pace.

One-row parts are folded together by a union and an aggregate, so no section
needs a cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pace
from ..functions.values import month_start_ms, round_half_up
from ..operators import counters, quality as q, tally
from ..operators.ancestry import sdk_root_credits
from ..operators.context import attributed_calls
from ..operators.ledger import drift

CONTEXT_STALE_MS = 30 * 60 * 1000
ACCOUNT_STALE_MS = 15 * 60 * 1000


def fold(*one_row: DataFrame) -> DataFrame:
    """Side-by-side columns of one-row frames with distinct column names."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return wide.agg(*[F.first(c, ignorenulls=True).alias(c) for c in wide.columns])


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def long_form(one_row: DataFrame, section: str) -> DataFrame:
    """(section, measure, value, text) from the columns of one row."""
    numeric = [c for c, t in one_row.dtypes if t != "string"]
    cells = [
        F.struct(F.lit(c).alias("measure"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("value"),
                 (F.lit(None).cast("string") if c in numeric else F.col(c)).alias("text")) for c in one_row.columns
    ]
    return one_row.select(F.lit(section).alias("section"), F.explode(F.array(*cells)).alias("c")).select("section", "c.*")


def quality_section(series: DataFrame, spans: DataFrame) -> DataFrame:
    """One row of outcome counts and rates. series: `all_series`. Feed tool measurements win, even a measured zero."""
    metric = F.col("metric")

    def total(name: str, key: str | None = None, value: str = "") -> Column:
        match = (metric == name) if key is None else (metric == name) & (F.coalesce(F.col("attrs")[key], F.lit("")) == value)
        return F.coalesce(F.sum(F.when(match, F.col("total"))), F.lit(0.0))

    def rounded(*args) -> Column:
        return round_half_up(total(*args))

    def mean(name: str) -> Column:
        n = F.sum(F.when(metric == name, F.col("count")))
        return F.when(n > 0, F.sum(F.when(metric == name, F.col("total"))) / n)

    def observed(name: str) -> Column:
        return F.coalesce(F.sum(F.when(metric == name, F.col("count"))), F.lit(0.0))

    counts = {
        "edits_accepted": (q.EDIT_ACCEPTANCE, q.OUTCOME, "accepted"), "edits_rejected": (q.EDIT_ACCEPTANCE, q.OUTCOME, "rejected"),
        "chat_edits_accepted": (q.CHAT_EDIT_OUTCOME, q.OUTCOME, "accepted"), "chat_edits_rejected": (q.CHAT_EDIT_OUTCOME, q.OUTCOME, "rejected"),
        "chat_edits_saved": (q.CHAT_EDIT_OUTCOME, q.OUTCOME, "saved"),
        "lines_added": (q.LINES_OF_CODE, "type", "added"), "lines_removed": (q.LINES_OF_CODE, "type", "removed"),
        "pull_requests": (q.PULL_REQUESTS,), "cloud_sessions": (q.CLOUD_SESSIONS,),
        "feedback_positive": (q.USER_FEEDBACK, "rating", "positive"), "feedback_negative": (q.USER_FEEDBACK, "rating", "negative"),
        **{f"action_{a}": (q.USER_ACTIONS, "action", a) for a in ("copy", "insert", "apply", "followup")},
        "edit_response_errors": (q.EDIT_RESPONSES, "outcome", "error"),
        "summarizations_applied": (q.SUMMARIZATIONS, "outcome", "applied"), "summarizations_failed": (q.SUMMARIZATIONS, "outcome", "failed"),
    }
    feed = series.agg(
        *[rounded(*args).alias(n) for n, args in counts.items()],
        mean(q.SURVIVAL_FOUR_GRAM).alias("survival_four_gram"), mean(q.SURVIVAL_NO_REVERT).alias("survival_no_revert"),
        observed(q.TOOL_CALL_COUNT).alias("_own"), observed(q.SDK_TOOL_CALL_COUNT).alias("_sdk"),
        rounded(q.TOOL_CALL_COUNT).alias("_own_calls"), rounded(q.SDK_TOOL_CALL_COUNT).alias("_sdk_calls"),
        rounded(q.TOOL_CALL_COUNT, "success", "false").alias("_own_failed"), rounded(q.SDK_TOOL_CALL_COUNT, "success", "false").alias("_sdk_failed"),
    )
    both = fold(feed, q.tool_status(spans).select(F.col("status_calls").alias("_span_calls"), F.col("failed").alias("_span_failed")))
    source = F.when((F.col("_own") > 0) | (F.col("_sdk") > 0), "metrics").when(F.col("_span_calls") > 0, "spans").otherwise("none")

    def tool(kind: str) -> Column:
        from_feed = F.when(F.col("_own") > 0, F.col(f"_own_{kind}")).otherwise(F.col(f"_sdk_{kind}"))
        return F.when(source == "spans", F.col(f"_span_{kind}")).otherwise(from_feed)

    decided, votes = F.col("edits_accepted") + F.col("edits_rejected"), F.col("feedback_positive") + F.col("feedback_negative")
    missing = F.concat_ws(
        ", ", F.when(decided == 0, F.lit("edit accept / reject")), F.when(F.col("survival_four_gram").isNull(), F.lit("edit survival")),
        F.when(F.col("pull_requests") == 0, F.lit("pull requests")), F.when(votes == 0, F.lit("thumbs up / down")),
    )
    seen = reduce(lambda a, b: a + b, [F.col(n) for n in counts])
    return both.select(
        *counts, "survival_four_gram", "survival_no_revert",
        F.when(decided > 0, F.col("edits_accepted") / decided).alias("accept_rate"),
        F.when(votes > 0, F.col("feedback_positive") / votes).alias("feedback_rate"),
        tool("calls").alias("tool_calls"), tool("failed").alias("tool_failures"),
        F.when(tool("calls") > 0, (tool("calls") - tool("failed")) / tool("calls")).alias("tool_success_rate"),
        source.alias("tool_source"), missing.alias("missing"),
        ((seen > 0) | (tool("calls") > 0) | F.coalesce("survival_four_gram", "survival_no_revert").isNotNull()).alias("available"),
    )


CREDIT_KEYS = {
    "model": ("model", "unknown model"), "repository": ("work_repository", "no repository"), "user": ("user_by", "no user identity"),
    "caller": ("agent", "unnamed caller"), "effort": ("effort", "not reported"), "actor": ("actor_by", "no SDK actor id"),
}


def trace_credits(spans: DataFrame) -> DataFrame:
    """(breakdown, label, calls, credit_calls, credits): totals, sessionless calls, user calls and six top-k breakdowns.

    Calls are attributed once and counted under all breakdowns in one aggregate.
    """
    def under(name: str, key: Column, unknown: str | None) -> Column:
        return F.struct(F.lit(name).alias("breakdown"), key.alias("key"), F.lit(unknown).cast("string").alias("unknown"))

    none = F.lit(None).cast("string")
    keys = [under("total", none, None)] + [under(n, F.col(c), u) for n, (c, u) in CREDIT_KEYS.items()]
    keys += [F.when(F.col("session_id").isNull(), under("sessionless", none, None)), F.when(F.col("user_by").isNotNull(), under("with user", none, None))]
    each = attributed_calls(spans).select("nano", F.explode(F.array_compact(F.array(*keys))).alias("b"))
    rows = each.groupBy("b.breakdown", "b.key", "b.unknown").agg(
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credit_calls"),
        F.coalesce(F.sum(F.col("nano").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("nano"))
    return tally.topk_by(rows, ["breakdown"])


def period_rollup(sessions: DataFrame, now_ms: int) -> DataFrame:
    """Sessions updated since the month began. sessions: `session_compare`. Transcript credits win per session."""
    reported = F.coalesce("transcript_credits", "trace_credits")
    since = month_start_ms(now_ms)
    return sessions.where(F.col("updated_ms") >= since).agg(
        F.lit(since).alias("since_ms"), F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(reported), F.lit(0.0)).alias("credits"),
        F.count(reported).alias("credit_sessions"),
        F.count_if(F.col("transcript_credits").isNull() & F.col("trace_credits").isNotNull()).alias("trace_credit_sessions"),
        F.coalesce(F.sum("trace_input"), F.lit(0)).alias("input"), F.coalesce(F.sum("trace_output"), F.lit(0)).alias("output"),
        F.count_if("traced").alias("traced_sessions"),
    )


def cost_section(spans: DataFrame, series: DataFrame, buckets: DataFrame, totals: DataFrame, transcript_credits: DataFrame) -> DataFrame:
    """(section, measure, value, text) of the cost report. totals: `meter_totals`, so headline and health share a ledger."""
    coverage = tally.token_coverage(tally.chat(spans)).select(
        F.lit("cost").alias("section"), F.concat(F.lit("coverage_"), F.col("field")).alias("measure"), F.col("share").alias("value"),
        F.lit(None).cast("string").alias("text"))
    chat = tally.chat_totals(spans).select("cached", "reasoning", "cache_write")
    ratio = tally.cache_read_ratio(tally.chat(spans)).select(F.col("ratio").alias("cache_read_ratio"), F.col("share").alias("cache_read_coverage"))
    head = drift(totals).select(
        (F.col("input") + F.col("output")).alias("total_tokens"), "input", "output", F.col("total").alias("counted_tokens"), "manual_tokens",
        "delta_tokens", "delta_percent", "agreeing", "pending", "source")
    models = counters.tokens_by_model(series).select(
        F.lit("cost").alias("section"), F.concat(F.lit("share_"), F.col("model")).alias("measure"), F.col("share").alias("value"),
        F.lit(None).cast("string").alias("text"))
    burn = counters.burn_rate(buckets).agg(F.coalesce(F.sum("burn_per_hour"), F.lit(0.0)).alias("burn_per_hour"))
    return union(long_form(fold(head, chat, ratio, burn, transcript_credits), "cost"), coverage, models)


def gauge_basis(context: DataFrame, account: DataFrame, totals: DataFrame, now_ms: int, budget: int, session_pinned: bool = False) -> DataFrame:
    """What the gauge measures and its health: prompt context, account allowance, own budget, or nothing.

    context: one row used, limit, at_ms. account: one row of `quota_parse`.
    """
    c = context.select(F.col("used").cast("double").alias("used"), F.col("limit").cast("double").alias("limit"), F.col("at_ms").alias("c_at"))
    a = account.select("status", "unlimited", "percent_remaining", F.col("fetched_ms").alias("a_at"), "reset_ms")
    age, held = F.lit(now_ms) - F.col("c_at"), F.lit(now_ms) - F.col("a_at")
    live_context = (F.col("limit") > 0) & (F.col("used") >= 0) & age.between(0, CONTEXT_STALE_MS)
    live_account = (
        F.lit(not session_pinned) & (F.col("status") == "ready") & ~F.col("unlimited") & F.col("percent_remaining").isNotNull()
        & held.between(0, ACCOUNT_STALE_MS) & F.coalesce(F.lit(now_ms) < F.col("reset_ms"), F.lit(True)))
    all_ = fold(c, a, totals.select("total"))
    health = (
        F.when(live_context, 1 - F.col("used") / F.col("limit")).when(live_account, F.col("percent_remaining") / 100)
        .when(F.lit(budget > 0), 1 - F.col("total") / F.lit(float(max(budget, 1)))).otherwise(F.lit(1.0)))
    basis = F.when(live_context, "context").when(live_account, "account").when(F.lit(budget > 0), "budget").otherwise("unavailable")
    return all_.select(basis.alias("basis"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), health)).alias("health"))


def model_pace(latest: DataFrame, by_model: DataFrame, now_ms: int, local_hosts: tuple[str, ...] = ()) -> DataFrame:
    """Credit pace of each latest call's model; no row when stale, unknown or under-sampled.

    A local endpoint needs no credits and takes the aurora band.
    """
    age = F.lit(now_ms) - F.col("at_ms")
    fresh = latest.where(F.col("model").isNotNull() & age.between(0, pace.STALE_MS))
    rate = by_model.select(F.col("key").alias("model"), "credit_calls", "credits")
    joined = fresh.join(rate, "model", "left").withColumn("local", pace.local_endpoint(F.col("host"), local_hosts))
    samples = F.coalesce("credit_calls", F.lit(0))
    per_call = F.when(samples > 0, F.col("credits") / samples).otherwise(F.lit(0.0))
    local = F.col("local").isNotNull()
    weight = F.when(local, F.lit(0.0)).otherwise(pace.credit_weight(per_call))
    return joined.where(local | (samples >= pace.MIN_CREDIT_CALLS)).select(
        "session_id", "model", per_call.alias("credits_per_call"), samples.alias("sample_calls"), weight.alias("weight"),
        F.when(local, F.lit("aurora")).otherwise(pace.pace_band(weight)).alias("band"), "local",
        F.when(local, pace.plain_host(F.col("host"))).alias("host"), "effort", pace.effort_level(F.col("effort")).alias("effort_level"),
        F.col("prompt_limit").alias("context_limit"), pace.context_level(F.col("prompt_limit")).alias("context_level"), "at_ms",
    )


def telemetry_diagnostics(records: DataFrame, spans: DataFrame, totals: DataFrame) -> DataFrame:
    """(section, measure, value, text): record counts, coverage, identity, drift, root credits."""
    calls = attributed_calls(spans)
    kinds = records.groupBy("kind").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("records").alias("section"), F.col("kind").alias("measure"), "value", F.lit(None).cast("string").alias("text"))
    traces = fold(
        tally.chat_totals(spans).select("calls", "credit_calls", "credits"),
        tally.sessionless_credits(spans).select(F.col("calls").alias("sessionless_calls")),
        q.tool_status(spans).select(F.col("status_calls").alias("tool_status_calls"), F.col("failed").alias("tool_failures")),
        calls.agg(F.count("user_by").alias("user_calls"), F.count_distinct("user_by").alias("users")),
    )
    return union(
        kinds, long_form(traces, "traces"),
        long_form(drift(totals).select("input", "output", "delta_tokens", "delta_percent", "pending", "agreeing", "source"), "reconciliation"),
        long_form(sdk_root_credits(spans), "invocations"),
    )
