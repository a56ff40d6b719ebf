"""Speed: exact percentiles from spans, histogram estimates where spans are silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import counters
from ..operators.quality import SDK_TOOL_CALL_COUNT, TOOL_CALL_COUNT
from ..operators.quantile import exact_quantiles
from ..operators.sessions import session_rollup

# Instrument names.
OPERATION_DURATION = "gen_ai.client.operation.duration"
AGENT_DURATION = "copilot_chat.agent.invocation.duration"
SDK_AGENT_DURATION = "gen_ai.invoke_agent.duration"
TIME_TO_FIRST_TOKEN = "copilot_chat.time_to_first_token"
FIRST_CHUNK_DURATION = "gen_ai.client.operation.time_to_first_chunk"
TOOL_CALL_DURATION = "copilot_chat.tool.call.duration"
SDK_TOOL_CALL_DURATION = "github.copilot.tool.call.duration"
AGENT_TURNS = "copilot_chat.agent.turn.count"
SESSION_COUNT = "copilot_chat.session.count"
OP_NAME = "gen_ai.operation.name"
QS = [0.5, 0.95]


def span_latencies(spans: DataFrame) -> DataFrame:
    """(name, ms): durations by kind, from one pass over spans plus the session rollup."""
    op, took = F.col("operation"), (F.col("end_ms") - F.col("start_ms")).cast("double")
    kinds = {
        "llm": F.when(op == "chat", took), "agent": F.when(op == "invoke_agent", took), "tool": F.when(op == "execute_tool", took),
        "ttft": F.when(op == "chat", F.col("ttft_ms")), "first_chunk": F.when(op == "chat", F.col("first_chunk_ms")),
    }
    per_span = spans.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("ms")) for n, v in kinds.items()])).alias("l")).select("l.*")
    sessions = session_rollup(spans).where(F.col("duration_ms") > 0).select(F.lit("session").alias("name"), F.col("duration_ms").cast("double").alias("ms"))
    return per_span.where(F.col("ms").isNotNull()).unionByName(sessions)


def latency_percentiles(spans: DataFrame) -> DataFrame:
    """(name, q, value, n) exact."""
    return exact_quantiles(span_latencies(spans), ["name"], "ms", QS)


def estimated_latencies(runs: DataFrame) -> DataFrame:
    """(name, q, value): bucket estimates in ms; the first instrument with samples answers for each name.

    Operation durations are narrowed to chat only where the attribute exists at all.
    """
    typed = runs.groupBy("metric").agg(F.bool_or(F.map_contains_key("attrs", OP_NAME)).alias("typed"))
    op = F.coalesce(F.col("attrs")[OP_NAME], F.lit(""))
    metric = F.col("metric")
    rules = [
        ("agent", 0, 1000.0, metric == AGENT_DURATION), ("agent", 1, 1000.0, metric == SDK_AGENT_DURATION),
        ("agent", 2, 1000.0, (metric == OPERATION_DURATION) & (op == "invoke_agent")),
        ("llm", 0, 1000.0, (metric == OPERATION_DURATION) & (~F.col("typed") | (op == "chat"))),
        ("ttft", 0, 1000.0, metric == TIME_TO_FIRST_TOKEN), ("first_chunk", 0, 1000.0, metric == FIRST_CHUNK_DURATION),
        ("tool", 0, 1.0, metric == TOOL_CALL_DURATION), ("tool", 1, 1000.0, metric == SDK_TOOL_CALL_DURATION),
    ]
    uses = F.filter(F.array(*[
        F.when(cond, F.struct(F.lit(n).alias("name"), F.lit(rank).alias("rank"), F.lit(scale).alias("scale"))) for n, rank, scale, cond in rules
    ]), lambda u: u.isNotNull())
    tagged = runs.join(typed, "metric").select("*", F.explode(uses).alias("u")).select("*", "u.*")
    each = counters.hist_quantiles(tagged, QS, ["name", "rank", "scale"])
    return each.groupBy("name", "q").agg(F.min_by(F.col("value") * F.col("scale"), "rank").alias("value"))


def prefer_exact(exact: DataFrame, estimate: DataFrame) -> DataFrame:
    """(name, q, value, source): the span figure when there is one, else the estimate, labelled."""
    e = exact.select("name", "q", F.col("value").alias("exact"))
    m = estimate.select("name", "q", F.col("value").alias("estimate"))
    return e.join(m, ["name", "q"], "full_outer").select(
        "name", "q", F.coalesce("exact", "estimate").alias("value"),
        F.when(F.col("exact").isNotNull(), "spans").when(F.col("estimate").isNotNull(), "metrics").otherwise("none").alias("source"),
    )


def slowest_tools(spans: DataFrame, n: int = 5) -> DataFrame:
    took = spans.where(F.col("operation") == "execute_tool").select(
        F.coalesce("tool", F.lit("unknown")).alias("tool"), (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    median = exact_quantiles(took, ["tool"], "ms", [0.5])
    return median.select("tool", F.col("n").alias("calls"), F.col("value").alias("median_ms")).orderBy(F.desc("median_ms"), "tool").limit(n)


def turns_per_invocation(spans: DataFrame, series: DataFrame) -> DataFrame:
    """Mean of reported turn counts, else the metric's mean."""
    exact = spans.where(F.col("operation") == "invoke_agent").agg(F.avg("turns").alias("v"), F.lit(0).alias("rank"), F.lit("spans").alias("source"))
    estimate = counters.metric_total(series, AGENT_TURNS).select(F.col("mean").alias("v"), F.lit(1).alias("rank"), F.lit("metrics").alias("source"))
    best = F.min_by(F.struct("v", "source"), F.when(F.col("v").isNotNull(), F.col("rank")))
    return exact.unionByName(estimate).agg(best.alias("b")).select(F.col("b.v").alias("value"), F.coalesce("b.source", F.lit("none")).alias("source"))


def output_throughput(spans: DataFrame) -> DataFrame:
    """Reported output tokens per minute of model-call time; 0 when either is not positive."""
    busy = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")), F.lit(0))
    tokens = F.coalesce(F.sum("output"), F.lit(0))
    return spans.where(F.col("operation") == "chat").agg(
        F.when((busy > 0) & (tokens > 0), tokens / (busy / F.lit(60000.0))).otherwise(F.lit(0.0)).alias("tokens_per_minute"))


def _count(name: str, spans: DataFrame, spare: DataFrame) -> DataFrame:
    """Measure row: the span count, or the metric's when spans hold none."""
    both = spans.selectExpr("CAST(n AS DOUBLE) AS n", "0 AS rank", "'spans' AS source").unionByName(
        spare.selectExpr("CAST(n AS DOUBLE) AS n", "1 AS rank", "'metrics' AS source"))
    best = F.min_by(F.struct("n", "source"), F.when(F.col("n") > 0, F.col("rank")))
    return both.agg(best.alias("b")).select(
        F.lit(name).alias("measure"), F.coalesce("b.n", F.lit(0.0)).alias("value"), F.coalesce("b.source", F.lit("none")).alias("source"))


def speed_section(spans: DataFrame, series: DataFrame, runs: DataFrame) -> DataFrame:
    """(measure, value, source) rows of the speed report."""
    merged = prefer_exact(latency_percentiles(spans), estimated_latencies(runs))
    suffix = F.when(F.col("q") == 0.5, "_median_ms").otherwise("_p95_ms")
    shown = (F.col("q") == 0.5) | F.col("name").isin("session", "llm")
    latencies = merged.where(shown).select(F.concat("name", suffix).alias("measure"), "value", "source")
    roll = session_rollup(spans)

    def series_sum(metric: str, column: str = "total") -> DataFrame:
        return counters.matching(series, metric).agg(F.floor(F.coalesce(F.sum(column), F.lit(0.0)) + 0.5).alias("n"))

    ops = spans.where(F.col("operation") == "chat").agg(F.count(F.lit(1)).alias("n"))
    tool_metric = series.where(F.col("metric").isin(TOOL_CALL_COUNT, SDK_TOOL_CALL_COUNT)).groupBy("metric").agg(
        F.sum("total").alias("t"), F.sum("count").alias("c")).agg(
        F.coalesce(F.max(F.when((F.col("metric") == TOOL_CALL_COUNT) & (F.col("c") > 0), F.col("t"))),
                   F.max(F.when(F.col("metric") == SDK_TOOL_CALL_COUNT, F.col("t"))), F.lit(0.0)).alias("n"))
    operations = counters.histogram_series(runs).where(F.col("metric") == OPERATION_DURATION).agg(F.coalesce(F.sum("count"), F.lit(0.0)).alias("n"))
    rows = [
        latencies,
        _count("sessions", roll.agg(F.count(F.lit(1)).alias("n")), series_sum(SESSION_COUNT)),
        _count("llm_calls", ops, operations),
        _count("tool_calls", roll.agg(F.sum("tool_calls").alias("n")), tool_metric),
        turns_per_invocation(spans, series).select(F.lit("turns_per_invocation").alias("measure"), "value", "source"),
        output_throughput(spans).select(F.lit("tokens_per_minute").alias("measure"), F.col("tokens_per_minute").alias("value"), F.lit("spans").alias("source")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
