"""Queries of the report sections: latency, quality, cost, ledgers, period, gauge, pace."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import pace
from ..operators import context, counters, ledger, quality, sessions, tally, transcripts
from ..operators.quantile import exact_quantiles
from ..plans import sections, snapshot, speed
from ..session import cut, shared_dir
from ..sources.once import computed_once
from . import bridge, ingest, usage
from .bridge import NOW_MS, with_events, with_histograms, with_points, with_spans
from .metrics import BUCKETS_SQL, TOKENS_SQL

DAY = 86_400_000
CUTOFF = 0  # the whole table
HALF = NOW_MS - 15 * DAY


def _signals(spark, d):
    events = bridge.logs(spark, d).select("name", F.col("attributes").alias("text"))
    return quality.quality_signals(computed_once(events, attributes=F.parse_json("text")))


def _all_series(spark, d):
    """Every metric series; events answer for the instruments that no metric has measured."""
    return counters.all_series(counters.counter_series(bridge.points(spark, d)), _signals(spark, d))


def _runs(spark, d):
    return counters.histogram_runs(bridge.histograms(spark, d))


def _silent(spark, d):
    """Spans of a store that records model calls only, without first-token times."""
    return bridge.spans(spark, d).where(F.col("operation") == "chat").withColumn("ttft_ms", F.lit(None).cast("double"))


def _prefer(spark, d):
    return speed.prefer_exact(speed.latency_percentiles(_silent(spark, d)), speed.estimated_latencies(_runs(spark, d)))


def chats(spark, d):
    """Transcript sessions: cost of their requests with title and activity."""
    return transcripts.session_cost(bridge.requests(spark, d)).selectExpr("session_id", "credits", "model", *bridge.CHAT_COLUMNS)


def _traced(spark, d):
    spans = bridge.spans(spark, d)
    work = sessions.session_work(spans).select("session_id", "repository", "branch")
    return sessions.session_rollup(spans).join(work, "session_id", "left")


def _compared(spark, d):
    return sessions.session_compare(chats(spark, d), _traced(spark, d))


def _ledgers(spark, d):
    """Ledger rows: metric totals, metered local spans, agent-host-only spans, and manual reports from purchases."""
    totals = counters.token_totals(counters.counter_series(bridge.points(spark, d))).selectExpr("'metrics' AS ledger", "input", "output", "0L AS requests")
    spans = bridge.spans(spark, d)
    calls = ledger.metered_calls(spans, 0, CUTOFF)
    host = calls.join(spans.where(F.col("auxiliary")).select("span_id"), "span_id", "left_semi")
    local = calls.join(spans.where(F.col("auxiliary")).select("span_id"), "span_id", "left_anti")

    def summed(frame, name):
        return frame.agg(F.lit(name).alias("ledger"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.count(F.lit(1)).alias("requests"))

    reports = bridge.events(spark, d).where("et = 'purchase'").selectExpr("val - 5 AS input", "CASE WHEN k % 2 = 0 THEN val END AS output")
    return sections.union(totals, summed(local, "traces"), summed(host, "harness"), ledger.manual_reports(reports))


LEDGER_SQL = f""",
calls_ AS (SELECT input, output, auxiliary FROM spans WHERE operation = 'chat' AND start_ms >= {CUTOFF} AND (input IS NOT NULL OR output IS NOT NULL)),
rep AS (SELECT CASE WHEN val - 5 > 0 THEN floor(val - 5 + 0.5) ELSE 0 END AS i, CASE WHEN k % 2 = 0 AND val > 0 THEN floor(val + 0.5) ELSE 0 END AS o FROM ev WHERE et = 'purchase'),
led AS (
  SELECT 'metrics' AS ledger, CAST(floor(sum(total) FILTER (tag = 'input') + 0.5) AS BIGINT) AS input, CAST(floor(sum(total) FILTER (tag = 'output') + 0.5) AS BIGINT) AS output, 0 AS requests
    FROM series WHERE metric = 'gen_ai.client.token.usage'
  UNION ALL SELECT CASE WHEN auxiliary THEN 'harness' ELSE 'traces' END, CAST(sum(input) AS BIGINT), CAST(sum(output) AS BIGINT), count(*) FROM calls_ GROUP BY 1
  UNION ALL SELECT 'manual', CAST(sum(i) AS BIGINT), CAST(sum(o) AS BIGINT), count(*) FILTER (i + o > 0) FROM rep),
w AS (SELECT max(input) FILTER (ledger = 'metrics') AS mi, max(output) FILTER (ledger = 'metrics') AS mo, max(input) FILTER (ledger = 'traces') AS ti,
  max(output) FILTER (ledger = 'traces') AS tq, max(input) FILTER (ledger = 'harness') AS hi, max(output) FILTER (ledger = 'harness') AS ho,
  max(input) FILTER (ledger = 'manual') AS ni, max(output) FILTER (ledger = 'manual') AS no_, sum(requests) AS rq FROM led),
tot AS (SELECT greatest(mi, ti) + hi + ni AS input, greatest(mo, tq) + ho + no_ AS output, greatest(mi, ti) + hi + ni + greatest(mo, tq) + ho + no_ AS total,
  CAST(rq AS BIGINT) AS requests, 'otel' AS source, ni + no_ AS manual_tokens, mi + mo AS metric_tokens, ti + tq AS span_tokens FROM w),
dr AS (SELECT *, metric_tokens - span_tokens AS delta_tokens, (metric_tokens - span_tokens)::DOUBLE / greatest(metric_tokens, span_tokens)::DOUBLE * 100 AS delta_percent FROM tot)"""
LEDGERS_SQL = "WITH " + bridge.SPANS_SQL.strip() + bridge.POINTS_SQL[len(bridge.EVENTS_SQL):] + LEDGER_SQL


def _account(spark):
    """The latest quota reading of the one signed-in account, a user-level setting row."""
    return spark.range(1).selectExpr(
        "'ready' AS status", "false AS unlimited", "62.5D AS percent_remaining", f"{NOW_MS - 60_000} AS fetched_ms", f"{NOW_MS + DAY} AS reset_ms")


def _gauge(spark, d):
    latest = sessions.latest_call(bridge.spans(spark, d))
    newest = sessions.newest(sessions.prompt_context(latest))
    return sections.gauge_basis(newest, _account(spark), ledger.meter_totals(_ledgers(spark, d)), NOW_MS, 1_000_000_000)


def _snapshot(spark, d):
    """The snapshot as its sink holds it after two writes of the same report."""
    spans, points = bridge.spans(spark, d), bridge.points(spark, d)
    rows = cut(snapshot.snapshot(
        spans, counters.counter_series(points), _runs(spark, d), _signals(spark, d), counters.token_series(points, NOW_MS),
        ledger.meter_totals(_ledgers(spark, d)), _compared(spark, d), NOW_MS))
    path = f"{shared_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4()}"
    for _ in range(2):
        snapshot.write_snapshot(rows, path)
    kept = spark.read.schema(rows.schema).parquet(path)
    return kept.withColumn("value", F.round("value", 6))


def _diagnostics(spark, d):
    return sections.telemetry_diagnostics(ingest._records(spark, d), bridge.spans(spark, d), ledger.meter_totals(_ledgers(spark, d)))


def _growth(spark, d):
    """Chats seen before the middle of the month against all of them now."""
    now = chats(spark, d)
    seen = now.where(F.col("updated_ms") < HALF).select("session_id", (F.col("credits") / 2).alias("credits"))
    return transcripts.transcript_growth(seen, now, now)


def _stale(spark, d):
    """Which readings a report at the end of the period may still use."""
    latest = sessions.latest_call(bridge.spans(spark, d))
    now = NOW_MS - DAY
    return latest.select(
        "session_id", "at_ms", snapshot.is_fresh(F.col("at_ms"), now, sections.CONTEXT_STALE_MS).alias("context"),
        snapshot.is_fresh(F.col("at_ms"), now, sections.ACCOUNT_STALE_MS).alias("account"), snapshot.is_fresh(F.col("at_ms"), now, pace.STALE_MS).alias("pace"))


def _pace(spark, d):
    """Pace of every session's latest call, each judged right after it."""
    spans = bridge.spans(spark, d)
    latest = sessions.latest_call(spans).where(F.col("session_id") != "")
    fresh = latest.withColumn("at_ms", F.lit(NOW_MS - 60_000))
    by_model = tally.credits_by(spans, "model")
    return sections.model_pace(fresh, by_model, NOW_MS, ("gpu-box.lan",)).select(
        "session_id", "model", "sample_calls", F.round("credits_per_call", 9).alias("credits_per_call"), F.round("weight", 9).alias("weight"), "band", "local", "host",
        "effort_level", F.round("context_level", 9).alias("context_level"))


def _baseline(spark, d):
    """What each feed held before the middle of the month is history; only growth is charged."""
    def totals(points):
        kind = F.col("attrs")["gen_ai.token.type"]
        series = counters.matching(counters.counter_series(points), counters.TOKEN_USAGE)
        return series.groupBy("feed").agg(*[
            F.coalesce(F.sum(F.when(kind == k, F.col("total"))), F.lit(0.0)).cast("bigint").alias(k) for k in ("input", "output")])

    points = bridge.points(spark, d).join(bridge.events(spark, d).select(F.col("eid").alias("seq"), "ms"), "seq")
    return ledger.metric_baseline(totals(points.where(F.col("ms") < HALF).drop("ms")), totals(points.drop("ms")), ["feed"])


def _metering(spark, d):
    calls = ledger.metered_calls(usage._copies(spark, d), 0, CUTOFF)
    return calls.select("span_id", "input", "output")


def _transfer(spark, d):
    """First scan saw the agent host's calls before the middle of the week; the second sees every source."""
    mid = NOW_MS - 4 * DAY
    spans = bridge.spans(spark, d)
    hosted = usage.host_copy(spark, d)
    first = ledger.metered_calls(hosted.where(F.col("start_ms") < mid), 0, CUTOFF).withColumn("harness", F.lit(True))
    only = usage.merge.harness_only(hosted, usage.file_copy(spark, d), usage.local_copy(spark, d))
    step = ledger.accounting_step(first, ledger.metered_calls(spans, 0, CUTOFF), only, CUTOFF)
    return ledger.ledger_growth(step)


TRANSFER_SQL = f"""
c AS (SELECT span_id, ord, start_ms, coalesce(input, 0) AS i, coalesce(output, 0) AS o FROM spans
  WHERE operation = 'chat' AND start_ms >= {CUTOFF} AND (input IS NOT NULL OR output IS NOT NULL)),
x AS (SELECT *, ord % 5 = 0 AS hosted, ord % 5 = 0 AND ord % 2 <> 0 AND NOT (ord % 3 <> 0 AND ord % 10 < 8) AS only_host,
  ord % 5 = 0 AND start_ms < {NOW_MS - 4 * DAY} AS seen FROM c),
e AS (
  SELECT CASE WHEN only_host THEN 'harness' ELSE 'traces' END AS ledger, CASE WHEN seen THEN 0 ELSE i END AS input, CASE WHEN seen THEN 0 ELSE o END AS output,
    CASE WHEN seen THEN 0 ELSE 1 END AS requests FROM x
  UNION ALL SELECT 'traces', i, o, 1 FROM x WHERE seen AND NOT only_host
  UNION ALL SELECT 'harness', -i, -o, -1 FROM x WHERE seen AND NOT only_host)"""

LATENCY_SQL = """,
lat AS (
  SELECT CASE operation WHEN 'chat' THEN 'llm' WHEN 'invoke_agent' THEN 'agent' ELSE 'tool' END AS name, (end_ms - start_ms)::DOUBLE AS ms FROM spans
  UNION ALL SELECT 'ttft', ttft_ms FROM spans WHERE operation = 'chat' AND ttft_ms IS NOT NULL
  UNION ALL SELECT 'first_chunk', first_chunk_ms FROM spans WHERE operation = 'chat' AND first_chunk_ms IS NOT NULL
  UNION ALL SELECT 'session', d FROM (SELECT (max(end_ms) - min(start_ms))::DOUBLE AS d FROM spans WHERE session_id IS NOT NULL GROUP BY session_id) WHERE d > 0),
srt AS (SELECT name, ms, row_number() OVER (PARTITION BY name ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM lat),
pos AS (SELECT DISTINCT name, n, q, (n - 1) * q AS p FROM srt, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) v(q)),
pct AS (SELECT p.name, p.q, lo.ms + (hi.ms - lo.ms) * (p.p - floor(p.p)) AS value, p.n FROM pos p
  JOIN srt lo ON lo.name = p.name AND lo.i = floor(p.p) JOIN srt hi ON hi.name = p.name AND hi.i = ceil(p.p))"""

SERIES_SQL = """
allser AS (
  SELECT metric, CASE metric WHEN 'copilot_chat.edit.acceptance.count' THEN 'copilot_chat.edit.outcome=' || tag WHEN 'copilot_chat.lines_of_code.count' THEN 'type=' || tag
      WHEN 'copilot_chat.tool.call.count' THEN 'success=' || tag
      ELSE 'gen_ai.request.model=' || req || chr(1) || coalesce('gen_ai.response.model=' || resp || chr(1), '') || 'gen_ai.token.type=' || tag END AS series_key,
    total, 1.0::DOUBLE AS count, 'metrics' AS source FROM series
  UNION ALL
  SELECT metric, series_key, sum(value), count(*)::DOUBLE, 'events' FROM sig
  WHERE metric NOT IN (SELECT metric FROM series) GROUP BY 1, 2)"""
ALL_SERIES_SQL = "WITH " + bridge.SPANS_SQL.strip() + bridge.POINTS_SQL[len(bridge.EVENTS_SQL):] + bridge.SIGNALS_SQL[len(bridge.EVENTS_SQL):] + "," + SERIES_SQL


def _t(metric: str, key: str = "", how: str = "total") -> str:
    cond = f"metric = '{metric}'" + (f" AND series_key = '{key}'" if key else "")
    return f"coalesce(sum({how}) FILTER ({cond}), 0)"


FURTHER = {
    **{f"chat_edits_{o}": (quality.CHAT_EDIT_OUTCOME, f"{quality.OUTCOME}={o}") for o in ("accepted", "rejected", "saved")}, "pull_requests": (quality.PULL_REQUESTS,),
    **{f"action_{a}": (quality.USER_ACTIONS, f"action={a}") for a in ("copy", "insert", "apply", "followup")},
    "edit_response_errors": (quality.EDIT_RESPONSES, "outcome=error"), "summarizations_applied": (quality.SUMMARIZATIONS, "outcome=applied"),
    "summarizations_failed": (quality.SUMMARIZATIONS, "outcome=failed"),
}
QUALITY_SQL = ALL_SERIES_SQL + f""",
a AS (SELECT {_t(quality.EDIT_ACCEPTANCE, 'copilot_chat.edit.outcome=accepted')} AS ea, {_t(quality.EDIT_ACCEPTANCE, 'copilot_chat.edit.outcome=rejected')} AS er,
  {_t(quality.LINES_OF_CODE, 'type=added')} AS la, {_t(quality.LINES_OF_CODE, 'type=removed')} AS lr, {_t(quality.CLOUD_SESSIONS)} AS cs,
  {_t(quality.USER_FEEDBACK, 'rating=positive')} AS fp, {_t(quality.USER_FEEDBACK, 'rating=negative')} AS fn,
  {_t(quality.SURVIVAL_FOUR_GRAM)} / {_t(quality.SURVIVAL_FOUR_GRAM, how='count')} AS s4, {_t(quality.SURVIVAL_NO_REVERT)} / {_t(quality.SURVIVAL_NO_REVERT, how='count')} AS sn,
  {_t(quality.TOOL_CALL_COUNT)} AS tc, {_t(quality.TOOL_CALL_COUNT, 'success=false')} AS tf, {", ".join(f"CAST({_t(*args)} AS BIGINT) AS {name}" for name, args in FURTHER.items())} FROM allser)
SELECT {", ".join(FURTHER)}, CAST(ea AS BIGINT) AS edits_accepted, CAST(er AS BIGINT) AS edits_rejected, CAST(la AS BIGINT) AS lines_added, CAST(lr AS BIGINT) AS lines_removed,
  CAST(cs AS BIGINT) AS cloud_sessions, CAST(fp AS BIGINT) AS feedback_positive, CAST(fn AS BIGINT) AS feedback_negative, round(s4, 9) AS survival_four_gram,
  round(sn, 9) AS survival_no_revert, ea / (ea + er) AS accept_rate, fp / (fp + fn) AS feedback_rate, CAST(tc AS BIGINT) AS tool_calls, CAST(tf AS BIGINT) AS tool_failures,
  (tc - tf) / tc AS tool_success_rate, 'metrics' AS tool_source, 'pull requests' AS missing, TRUE AS available FROM a"""

CHAT_SQL = ("," + bridge.REQUESTS_SQL + f""",
chats AS (SELECT session_id, credits, model, {", ".join(bridge.CHAT_COLUMNS)} FROM cost)""")
COMPARE_SQL = CHAT_SQL + "," + usage.SESSION_SQL + "," + usage.USERS_SQL + """,
cmp AS (SELECT coalesce(t.session_id, s.session_id) AS session_id, t.title AS name, greatest(t.updated_ms, s.ended_ms) AS updated_ms, t.credits AS transcript_credits,
  s.credits AS trace_credits, s.input AS trace_input, s.output AS trace_output, w.work, s.session_id IS NOT NULL AS traced
  FROM chats t FULL OUTER JOIN sess s ON t.session_id = s.session_id LEFT JOIN swork w ON w.session_id = s.session_id)"""

PINNED = "c7"

QUERIES = {
    "latency_percentiles": lambda spark, d: speed.latency_percentiles(bridge.spans(spark, d)),
    "prefer_exact": _prefer,
    "slowest_tools": lambda spark, d: speed.slowest_tools(bridge.spans(spark, d)),
    "turns_per_invocation": lambda spark, d: speed.turns_per_invocation(bridge.spans(spark, d), counters.counter_series(bridge.points(spark, d))),
    "output_throughput": lambda spark, d: speed.output_throughput(bridge.spans(spark, d)),
    "speed_section": lambda spark, d: speed.speed_section(
        bridge.spans(spark, d), counters.counter_series(bridge.points(spark, d)), _runs(spark, d)),
    "tool_status": lambda spark, d: quality.tool_status(bridge.spans(spark, d)),
    "tool_breakdown": lambda spark, d: quality.tool_breakdown(bridge.spans(spark, d)),
    "quality_event_project": lambda spark, d: _signals(spark, d).groupBy("metric", counters.series_key(F.col("attrs")).alias("series_key")).agg(
        F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("events")),
    "event_fallback": lambda spark, d: _all_series(spark, d).where("source = 'events'").select(
        "metric", "series_key", F.round("total", 6).alias("total"), "count"),
    "all_series": lambda spark, d: _all_series(spark, d).groupBy("source", "metric").agg(
        F.count(F.lit(1)).alias("series"), F.round(F.sum("total"), 6).alias("total")),
    "quality_section": lambda spark, d: sections.quality_section(_all_series(spark, d), bridge.spans(spark, d)).withColumns(
        {c: F.round(c, 9) for c in ("survival_four_gram", "survival_no_revert")}),
    "trace_credits": lambda spark, d: sections.trace_credits(bridge.spans(spark, d)),
    "session_cost": lambda spark, d: transcripts.session_cost(bridge.requests(spark, d)),
    "session_compare": _compared,
    "session_select": lambda spark, d: sessions.session_select(_compared(spark, d), PINNED),
    "period_rollup": lambda spark, d: sections.period_rollup(_compared(spark, d), NOW_MS).withColumn("credits", F.round("credits", 6)),
    "manual_reports": lambda spark, d: _ledgers(spark, d).where("ledger = 'manual'"),
    "meter_totals": lambda spark, d: ledger.meter_totals(_ledgers(spark, d)),
    "drift": lambda spark, d: ledger.drift(ledger.meter_totals(_ledgers(spark, d))).select("delta_tokens", "delta_percent", "pending", "agreeing"),
    "metric_baseline": _baseline,
    "span_metering": _metering,
    "ledger_transfer": _transfer,
    "cost_section": lambda spark, d: sections.cost_section(
        bridge.spans(spark, d), counters.counter_series(bridge.points(spark, d)), counters.token_series(bridge.points(spark, d), NOW_MS),
        ledger.meter_totals(_ledgers(spark, d)), chats(spark, d).agg(F.sum("credits").alias("transcript_credits"))).withColumn(
        "value", F.when(F.col("measure") == "burn_per_hour", F.round("value", 6)).otherwise(F.col("value"))),
    "gauge_basis": _gauge,
    "model_pace": _pace,
    "transcript_growth": _growth,
    "staleness": _stale,
    "snapshot_sink": _snapshot,
    "telemetry_diagnostics": _diagnostics,
}

# Bucket estimates in ms per name, after the same quantile rules as `hist_quantile`.
ESTIMATE_SQL = """,
tagged AS (
  SELECT 'agent' AS name, 0 AS rnk, 1000.0::DOUBLE AS scale, slot, c_ FROM runs WHERE metric = 'copilot_chat.agent.invocation.duration'
  UNION ALL SELECT 'agent', 2, 1000.0, slot, c_ FROM runs WHERE metric = 'gen_ai.client.operation.duration' AND op = 'invoke_agent'
  UNION ALL SELECT 'llm', 0, 1000.0, slot, c_ FROM runs WHERE metric = 'gen_ai.client.operation.duration' AND op = 'chat'
  UNION ALL SELECT 'ttft', 0, 1000.0, slot, c_ FROM runs WHERE metric = 'copilot_chat.time_to_first_token'
  UNION ALL SELECT 'tool', 0, 1.0, slot, c_ FROM runs WHERE metric = 'copilot_chat.tool.call.duration'),
tcell AS (SELECT name, rnk, scale, i AS idx, sum(CASE WHEN i = slot THEN c_ ELSE i END)::DOUBLE AS n FROM tagged, range(0, 16) r(i) GROUP BY 1, 2, 3, 4),
tcum AS (SELECT *, sum(n) OVER (PARTITION BY name, rnk ORDER BY idx) AS upto, sum(n) OVER (PARTITION BY name, rnk) AS all_ FROM tcell),
thit AS (SELECT *, CASE WHEN idx = 0 THEN 0.0::DOUBLE ELSE (@B::DOUBLE[])[idx] END AS lo, coalesce((@B::DOUBLE[])[idx + 1], (@B::DOUBLE[])[idx] * 2) AS hi
  FROM tcum, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) v(q) WHERE n > 0 AND upto >= q * all_ QUALIFY row_number() OVER (PARTITION BY name, rnk, q ORDER BY idx) = 1),
est AS (SELECT name, q, arg_min((lo + (hi - lo) * greatest(0, least(1, (q * all_ - (upto - n)) / n))) * scale, rnk) AS value FROM thit GROUP BY 1, 2),
pref AS (SELECT coalesce(p.name, e.name) AS name, coalesce(p.q, e.q) AS q, coalesce(p.value, e.value) AS value, CASE WHEN p.value IS NOT NULL THEN 'spans' ELSE 'metrics' END AS source
  FROM pct p FULL OUTER JOIN est e ON e.name = p.name AND e.q = p.q)""".replace("@B", str([float(b) for b in bridge.BOUNDARIES]))
HIST_TAIL = bridge.HISTOGRAMS_SQL[len(bridge.EVENTS_SQL):]
SILENT_SQL = """,
spans AS (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS ttft_ms) FROM every_span WHERE operation = 'chat')"""
PREFER_SQL = (
    "WITH RECURSIVE " + bridge.SPANS_SQL.strip().replace("\nspans AS (", "\nevery_span AS (") + SILENT_SQL + HIST_TAIL + LATENCY_SQL + ESTIMATE_SQL)
SPEED_SQL = (
    "WITH RECURSIVE " + bridge.SPANS_SQL.strip() + HIST_TAIL + LATENCY_SQL + ESTIMATE_SQL + """
SELECT name || CASE q WHEN 0.5 THEN '_median_ms' ELSE '_p95_ms' END AS measure, value, source FROM pref WHERE q = 0.5 OR name IN ('session', 'llm')
UNION ALL SELECT 'sessions', count(DISTINCT session_id)::DOUBLE, 'spans' FROM spans
UNION ALL SELECT 'llm_calls', count(*)::DOUBLE, 'spans' FROM spans WHERE operation = 'chat'
UNION ALL SELECT 'tool_calls', count(*)::DOUBLE, 'spans' FROM spans WHERE operation = 'execute_tool' AND session_id IS NOT NULL
UNION ALL SELECT 'turns_per_invocation', sum(turns)::DOUBLE / count(turns), 'spans' FROM spans WHERE operation = 'invoke_agent'
UNION ALL SELECT 'tokens_per_minute', sum(output)::DOUBLE / (sum(end_ms - start_ms)::DOUBLE / 60000.0::DOUBLE), 'spans' FROM spans WHERE operation = 'chat'""")
CHAT = "FROM spans WHERE operation = 'chat'"
COST_SQL = LEDGERS_SQL + TOKENS_SQL + BUCKETS_SQL + "," + bridge.REQUESTS_SQL + f""",
burn AS (SELECT CASE WHEN max(t_ms) > min(t_ms) THEN (sum(input + output) - arg_min(input + output, t_ms))::DOUBLE / ((max(t_ms) - min(t_ms)) / 3600000.0::DOUBLE) ELSE 0.0 END AS b FROM bk GROUP BY feed),
one AS (SELECT (input + output)::DOUBLE AS total_tokens, input::DOUBLE AS input, output::DOUBLE AS output, total::DOUBLE AS counted_tokens, manual_tokens::DOUBLE AS manual_tokens,
  delta_tokens::DOUBLE AS delta_tokens, delta_percent, (abs(delta_percent) <= 2)::INT::DOUBLE AS agreeing, 0.0::DOUBLE AS pending,
  (SELECT sum(cached)::DOUBLE {CHAT}) AS cached, (SELECT sum(reasoning)::DOUBLE {CHAT}) AS reasoning, (SELECT sum(cache_write)::DOUBLE {CHAT}) AS cache_write,
  (SELECT sum(cached) FILTER (cached <= input)::DOUBLE / sum(input) FILTER (cached <= input)::DOUBLE {CHAT}) AS cache_read_ratio,
  (SELECT count(*) FILTER (cached <= input)::DOUBLE / count(*) {CHAT}) AS cache_read_coverage, (SELECT round(sum(b), 6) FROM burn) AS burn_per_hour,
  (SELECT sum(credits) FROM cost)::DOUBLE AS transcript_credits FROM dr)
SELECT 'cost' AS section, measure, value, NULL AS text FROM (UNPIVOT one ON COLUMNS(*) INTO NAME measure VALUE value)
UNION ALL SELECT 'cost', 'source', NULL, 'otel'
{"".join(f" UNION ALL SELECT 'cost', 'coverage_{c}', count({c})::DOUBLE / count(*), NULL {CHAT}" for c in tally.TOKEN_FIELDS)}
UNION ALL SELECT 'cost', 'share_' || model, total::DOUBLE / (SELECT sum(total) FROM tk)::DOUBLE, NULL FROM tk"""

_MEASURES = [
    ("traces", "calls", "(SELECT count(*) FROM calls)"), ("traces", "credit_calls", "(SELECT count(nano) FROM calls)"),
    ("traces", "credits", "(SELECT CAST(sum(nano) AS DOUBLE) / 1e9 FROM calls)"), ("traces", "sessionless_calls", "(SELECT count(*) FROM calls WHERE session_id IS NULL)"),
    ("traces", "tool_status_calls", "(SELECT count(failed) FROM spans WHERE operation = 'execute_tool')"),
    ("traces", "tool_failures", "(SELECT count(*) FROM spans WHERE operation = 'execute_tool' AND failed)"),
    ("traces", "user_calls", "(SELECT count(user_by) FROM calls)"), ("traces", "users", "(SELECT count(DISTINCT user_by) FROM calls)"),
    *[("reconciliation", c, f"(SELECT {c} FROM dr)") for c in ("input", "output", "delta_tokens", "delta_percent")],
    ("reconciliation", "pending", "0"), ("reconciliation", "agreeing", "(SELECT (abs(delta_percent) <= 2)::INT FROM dr)"),
    ("invocations", "model_calls", "(SELECT count(*) FROM spans WHERE sdk AND operation = 'chat')"),
    ("invocations", "invocations", "(SELECT count(*) FROM roots WHERE root = 'root')"), ("invocations", "unclassified", "(SELECT count(*) FROM roots WHERE root = 'unknown')"),
    ("invocations", "reported_invocations", "(SELECT count(sdk_nano) FROM roots JOIN spans USING (span_id) WHERE root = 'root')"),
    ("invocations", "credits", "(SELECT coalesce(CAST(sum(sdk_nano) AS DOUBLE) / 1e9, 0.0) FROM roots JOIN spans USING (span_id) WHERE root = 'root')"),
]
DIAGNOSTICS_SQL = (
    "WITH RECURSIVE " + bridge.ATTRIBUTED_SQL.strip() + usage.ROOTS_SQL + bridge.POINTS_SQL[len(bridge.EVENTS_SQL):] + LEDGER_SQL + ingest.KIND_SQL
    + " SELECT 'records' AS section, kind AS measure, count(*)::DOUBLE AS value, NULL AS text FROM ln GROUP BY 2"
    + "".join(f" UNION ALL SELECT '{s}', '{m}', {e}::DOUBLE, NULL" for s, m, e in _MEASURES)
    + " UNION ALL SELECT 'reconciliation', 'source', NULL, 'otel'")

_PERIOD = ["since_ms", "sessions", "credits", "credit_sessions", "trace_credit_sessions", "input", "output", "traced_sessions"]
_QUALITY_TEXT = ["tool_source", "missing"]
_QUALITY = [*FURTHER, "edits_accepted", "edits_rejected", "lines_added", "lines_removed", "cloud_sessions", "feedback_positive", "feedback_negative", "survival_four_gram",
            "survival_no_revert", "accept_rate", "feedback_rate", "tool_calls", "tool_failures", "tool_success_rate", "available"]


def _long(section: str, source: str, measures: list[str], texts: list[str]) -> str:
    """The one row of `source` as (section, measure, value, text)."""
    return " UNION ALL ".join(
        [f"SELECT '{section}' AS section, '{c}' AS measure, CAST({c} AS DOUBLE) AS value, NULL AS text FROM {source}" for c in measures]
        + [f"SELECT '{section}', '{c}', NULL, {c} FROM {source}" for c in texts])


def _snapshot_sql() -> str:
    sections_ = f"""
SELECT section, measure, value, text FROM ({COST_SQL}) UNION ALL SELECT 'speed', measure, value, source FROM ({SPEED_SQL})
UNION ALL SELECT 'credits', breakdown || coalesce(': ' || label, ''), credits, NULL FROM ({ORACLES['trace_credits']})
UNION ALL {_long('quality', 'qu', _QUALITY, _QUALITY_TEXT)} UNION ALL {_long('period', 'pe', _PERIOD, [])}"""
    return f"WITH qu AS MATERIALIZED ({QUALITY_SQL}), pe AS MATERIALIZED ({ORACLES['period_rollup']}) SELECT {NOW_MS} AS generated_ms, section, measure, round(value, 6) AS value, text FROM ({sections_})"


ORACLES = {
    "latency_percentiles": with_spans(LATENCY_SQL + " SELECT name, q, value, n FROM pct"),
    "slowest_tools": with_spans("""
SELECT coalesce(tool, 'unknown') AS tool, count(*) AS calls, quantile_cont((end_ms - start_ms)::DOUBLE, 0.5) AS median_ms
FROM spans WHERE operation = 'execute_tool' GROUP BY 1 ORDER BY median_ms DESC, tool LIMIT 5"""),
    "turns_per_invocation": with_spans(" SELECT sum(turns)::DOUBLE / count(turns) AS value, 'spans' AS source FROM spans WHERE operation = 'invoke_agent'"),
    "output_throughput": with_spans(" SELECT sum(output)::DOUBLE / (sum(end_ms - start_ms)::DOUBLE / 60000.0::DOUBLE) AS tokens_per_minute FROM spans WHERE operation = 'chat'"),
    "tool_status": with_spans(" SELECT count(failed) AS status_calls, count(*) FILTER (failed) AS failed FROM spans WHERE operation = 'execute_tool'"),
    "tool_breakdown": with_spans("""
SELECT coalesce(tool, 'unknown') AS tool, count(*) AS calls, count(failed) AS status_calls, count(*) FILTER (failed) AS failed
FROM spans WHERE operation = 'execute_tool' GROUP BY 1"""),
    "quality_event_project": "WITH " + bridge.SIGNALS_SQL.strip() + " SELECT metric, series_key, round(sum(value), 6) AS total, count(*) AS events FROM sig GROUP BY 1, 2",
    "event_fallback": ALL_SERIES_SQL + " SELECT metric, series_key, round(total, 6) AS total, count FROM allser WHERE source = 'events'",
    "all_series": ALL_SERIES_SQL + """
SELECT source, metric, count(*) AS series, round(sum(total), 6) AS total FROM allser GROUP BY 1, 2""",
    "quality_section": QUALITY_SQL,
    "trace_credits": bridge.with_calls(f""",
base AS (SELECT 'total' AS breakdown, count(*) AS calls, count(nano) AS credit_calls, sum(nano) AS n FROM calls
  UNION ALL SELECT 'sessionless', count(*), count(nano), sum(nano) FROM calls WHERE session_id IS NULL
  UNION ALL SELECT 'with user', count(*), count(nano), sum(nano) FROM calls WHERE user_by IS NOT NULL),
tt AS ({" UNION ALL ".join(f"SELECT '{n}' AS breakdown, '{u}' AS unknown, {k} AS key, count(*) AS calls, count(nano) AS credit_calls, coalesce(sum(nano), 0) AS n FROM calls GROUP BY {k}" for n, (k, u) in sections.CREDIT_KEYS.items())}),
rr AS (SELECT *, row_number() OVER (PARTITION BY breakdown ORDER BY n DESC, calls DESC, key NULLS LAST) AS place, count(*) OVER (PARTITION BY breakdown) AS total FROM tt)
SELECT breakdown, NULL AS label, calls, credit_calls, coalesce(CAST(n AS DOUBLE) / 1e9, 0.0) AS credits FROM base
UNION ALL SELECT breakdown, coalesce(key, unknown), calls, credit_calls, CAST(n AS DOUBLE) / 1e9 FROM rr WHERE total <= 6 OR place <= 5
UNION ALL SELECT breakdown, (max(total) - 5) || ' more', CAST(sum(calls) AS BIGINT), CAST(sum(credit_calls) AS BIGINT), CAST(sum(n) AS DOUBLE) / 1e9
  FROM rr WHERE total > 6 AND place > 5 GROUP BY breakdown"""),
    "session_cost": "WITH " + bridge.REQUESTS_SQL.strip() + " SELECT session_id, credits, model FROM cost",
    "session_compare": with_spans(COMPARE_SQL + " SELECT * FROM cmp"),
    "session_select": with_spans(COMPARE_SQL + f"""
SELECT p.session_id, name, coalesce(updated_ms, 0) AS updated_ms, transcript_credits, trace_credits, trace_input, trace_output, work, traced
FROM (SELECT '{PINNED}' AS session_id) p LEFT JOIN cmp ON cmp.session_id = p.session_id"""),
    "period_rollup": with_spans(COMPARE_SQL + """
SELECT 1704067200000 AS since_ms, count(*) AS sessions, round(sum(coalesce(transcript_credits, trace_credits)), 6) AS credits,
  count(coalesce(transcript_credits, trace_credits)) AS credit_sessions, count(*) FILTER (transcript_credits IS NULL AND trace_credits IS NOT NULL) AS trace_credit_sessions,
  CAST(sum(trace_input) AS BIGINT) AS input, CAST(sum(trace_output) AS BIGINT) AS output, count(*) FILTER (traced) AS traced_sessions
FROM cmp WHERE updated_ms >= 1704067200000"""),
    "manual_reports": LEDGERS_SQL + " SELECT ledger, input, output, requests FROM led WHERE ledger = 'manual'",
    "meter_totals": LEDGERS_SQL + " SELECT * FROM tot",
    "drift": LEDGERS_SQL + " SELECT delta_tokens, delta_percent, FALSE AS pending, abs(delta_percent) <= 2 AS agreeing FROM dr",
    "metric_baseline": "WITH " + bridge.POINTS_SQL.strip() + f""",
now_ AS (SELECT feed, CAST(coalesce(sum(total) FILTER (tag = 'input'), 0) AS BIGINT) AS i, CAST(coalesce(sum(total) FILTER (tag = 'output'), 0) AS BIGINT) AS o
  FROM series WHERE metric = 'gen_ai.client.token.usage' GROUP BY 1),
old_ AS (SELECT feed, CAST(coalesce(sum(grown) FILTER (tag = 'input'), 0) AS BIGINT) AS i, CAST(coalesce(sum(grown) FILTER (tag = 'output'), 0) AS BIGINT) AS o
  FROM inc JOIN ev ON ev.eid = inc.seq WHERE metric = 'gen_ai.client.token.usage' AND ev.ms < {HALF} GROUP BY 1)
SELECT feed, greatest(0, n.i - o_.i) AS charged_input, greatest(0, n.o - o_.o) AS charged_output, greatest(n.i, o_.i) AS input, greatest(n.o, o_.o) AS output
FROM now_ n LEFT JOIN old_ o_ USING (feed)""",
    "span_metering": with_spans(f""",
cp AS (SELECT span_id, start_ms, operation, input, output FROM spans UNION ALL SELECT span_id, start_ms, operation, 7, output FROM spans WHERE ord % 4 = 0)
SELECT span_id, coalesce(max(input), 0) AS input, coalesce(max(output), 0) AS output FROM cp
WHERE operation = 'chat' AND start_ms >= {CUTOFF} AND (input IS NOT NULL OR output IS NOT NULL) GROUP BY 1"""),
    "ledger_transfer": with_spans("," + TRANSFER_SQL + """
SELECT ledger, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(requests) AS BIGINT) AS requests FROM e GROUP BY 1"""),
    "gauge_basis": LEDGERS_SQL + "," + usage.LATEST_SQL + f""",
ctx AS (SELECT input AS used, prompt_limit AS lim, at_ms FROM latest WHERE prompt_limit > 0 AND input IS NOT NULL ORDER BY at_ms DESC, ord LIMIT 1)
SELECT CASE WHEN {NOW_MS} - at_ms BETWEEN 0 AND 1800000 THEN 'context' ELSE 'account' END AS basis,
  greatest(0.0, least(1.0, CASE WHEN {NOW_MS} - at_ms BETWEEN 0 AND 1800000 THEN 1 - used / lim ELSE 0.625 END))::DOUBLE AS health FROM ctx""",
    "model_pace": with_spans("," + usage.LATEST_SQL + """,
bm AS (SELECT model, count(nano) AS cc, CAST(coalesce(sum(nano), 0) AS DOUBLE) / 1e9 AS cr FROM spans WHERE operation = 'chat' GROUP BY 1),
j AS (SELECT l.*, coalesce(b.cc, 0) AS cc, CASE WHEN b.cc > 0 THEN b.cr / b.cc ELSE 0.0 END AS pc,
  CASE WHEN host IN ('localhost', '127.0.0.1') THEN 'loopback' WHEN host = 'gpu-box.lan' THEN 'configured' END AS loc
  FROM latest l LEFT JOIN bm b USING (model) WHERE session_id <> '' AND l.model IS NOT NULL),
wt AS (SELECT *, CASE WHEN loc IS NOT NULL OR pc <= 0.05 THEN 0.0 WHEN pc >= 25 THEN 1.0 ELSE ln(pc / 0.05) / ln(500) END AS wgt FROM j WHERE loc IS NOT NULL OR cc >= 3)
SELECT session_id, model, cc AS sample_calls, round(pc, 9) AS credits_per_call, round(wgt::DOUBLE, 9) AS weight,
  CASE WHEN loc IS NOT NULL THEN 'aurora' WHEN wgt < 1.0/3 THEN 'snowy' WHEN wgt < 2.0/3 THEN 'mild' ELSE 'thawing' END AS band, loc AS local,
  CASE WHEN loc IS NOT NULL THEN host END AS host, CAST(CASE effort WHEN 'high' THEN 0.8 WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.5 END AS DOUBLE) AS effort_level,
  CASE WHEN prompt_limit > 0 THEN round(greatest(0.0, least(1.0, ln(prompt_limit / 32000) / ln(31.25)))::DOUBLE, 9) END AS context_level FROM wt"""),
    "transcript_growth": "WITH " + bridge.REQUESTS_SQL.strip() + f""",
ch AS (SELECT session_id, credits, {", ".join(bridge.CHAT_COLUMNS)} FROM cost),
sn AS (SELECT session_id, credits / 2 AS p FROM ch WHERE updated_ms < {HALF})
SELECT session_id, CASE WHEN credits IS NOT NULL THEN greatest(p, credits) ELSE coalesce(p, 0.0) END AS credits,
  CASE WHEN sn.session_id IS NOT NULL AND p IS NOT NULL AND credits IS NOT NULL THEN greatest(0.0, credits - p) ELSE 0.0 END AS growth FROM ch LEFT JOIN sn USING (session_id)""",
    "staleness": with_spans("," + usage.LATEST_SQL + f"""
SELECT session_id, at_ms, {NOW_MS - DAY} - at_ms BETWEEN 0 AND 1800000 AS context, {NOW_MS - DAY} - at_ms BETWEEN 0 AND 900000 AS account, {NOW_MS - DAY} - at_ms BETWEEN 0 AND 1800000 AS pace FROM latest"""),
    "prefer_exact": PREFER_SQL + " SELECT * FROM pref",
    "speed_section": SPEED_SQL,
    "cost_section": COST_SQL,
    "telemetry_diagnostics": DIAGNOSTICS_SQL,
}
ORACLES["snapshot_sink"] = _snapshot_sql()
