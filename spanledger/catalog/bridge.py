"""Telemetry-shaped views derived from the given tables, for Spark and for SQL.

`events` rows become spans, metric points and log events by fixed rules on
`event_id`, `user_id`, `value`, the instant and `k` (the number in `props`).
The SQL text states the same rules for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW_MS = 1_706_572_800_000  # 2024-01-30T00:00:00Z, the fixed "now" of every registered query


SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the stated schema saves the inference job."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def event_columns(rows: DataFrame, *further: str) -> DataFrame:
    return rows.selectExpr(
        *further,
        "event_id AS eid", "user_id AS uid", "event_type AS et", "value AS val",
        "CAST(get_json_object(props, '$.k') AS INT) AS k", f"timestampdiff(MICROSECOND, {EPOCH}, ts) div 1000 AS ms",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


EVENTS_SQL = """
ev AS (SELECT event_id AS eid, user_id AS uid, event_type AS et, value AS val,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ms FROM events)"""


SPAN_RULES = """
SELECT concat('s', eid) AS span_id, eid AS ord,
  CASE WHEN is_chat THEN 'chat' WHEN is_agent THEN 'invoke_agent' ELSE 'execute_tool' END AS operation,
  coalesce(nat, conv) AS session_id, nat AS native_session_id, conv AS conversation_id,
  CASE WHEN k % 17 <> 0 THEN concat('t', eid div 8) END AS trace_id,
  CASE WHEN eid % 64 = 0 THEN concat('s', eid + 1) WHEN k = 97 THEN concat('gone', eid)
       WHEN eid % 8 <> 0 THEN concat('s', eid - 1) END AS parent_span_id,
  k % 13 <> 0 AS parent_known, CASE WHEN k % 19 <> 0 THEN concat('m', k % 6) END AS model,
  ms AS start_ms, ms + 50 + floor(val) AS end_ms,
  CASE WHEN k % 9 <> 0 THEN floor(val * 100) END AS input, CASE WHEN k % 14 <> 0 THEN floor(val * 10) END AS output,
  CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 23 = 0 THEN floor(val * 100) + 1 ELSE floor(val * 100) div 2 END END AS cached,
  CASE WHEN k % 6 = 0 THEN floor(val) END AS cache_write, CASE WHEN k % 3 = 0 THEN floor(val * 2) END AS reasoning,
  CASE WHEN k % 7 <> 0 THEN floor(val * 1e7) END AS nano, k % 8 = 0 AS sdk,
  CASE WHEN k % 16 = 0 THEN floor(val * 1e6) END AS sdk_nano,
  CASE WHEN is_chat AND k % 3 <> 0 THEN val * 3 END AS ttft_ms, CASE WHEN is_chat AND k % 5 = 1 THEN val * 7 END AS first_chunk_ms,
  CASE WHEN is_agent AND k % 4 <> 1 THEN CAST(k % 10 AS BIGINT) END AS turns,
  CASE WHEN is_tool AND k % 10 <> 0 THEN concat('tool', k % 9) END AS tool,
  CASE WHEN k % 8 <> 3 THEN CAST(100000 + k * 10 AS DOUBLE) END AS prompt_limit,
  k % 10 = 0 AS auxiliary, CASE WHEN k % 12 <> 0 THEN concat('agent', k % 8) END AS agent,
  CASE WHEN is_chat AND k % 15 = 4 THEN concat('c', uid div 2) END AS parent_session_id,
  CASE WHEN is_chat THEN CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' END END AS effort,
  CASE WHEN et = 'purchase' AND k % 7 <> 0 THEN concat('o/r', k % 5) END AS repository,
  CASE WHEN et = 'purchase' AND k % 6 <> 0 THEN concat('b', k % 4) END AS branch,
  usr AS user_name, CASE WHEN usr IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 'span' ELSE 'resource' END END AS user_source,
  CASE WHEN et = 'signup' AND k % 3 = 0 THEN concat('act', uid % 7) END AS actor_id,
  CASE k % 3 WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS failed,
  CASE WHEN is_chat THEN CASE k % 6 WHEN 0 THEN 'localhost' WHEN 1 THEN 'api.example.com' WHEN 2 THEN '127.0.0.1'
       WHEN 3 THEN 'gpu-box.lan' END END AS host
FROM (SELECT *, et IN ('click','view') AS is_chat, et IN ('purchase','signup') AS is_agent, et = 'error' AS is_tool,
        CASE WHEN k % 11 <> 0 THEN concat('c', uid) END AS nat, CASE WHEN k % 5 <> 0 THEN concat('v', uid % 20) END AS conv,
        CASE WHEN (et = 'signup' AND k % 9 <> 0) OR (et IN ('click','view') AND k = 50) THEN concat('u', uid % 12) END AS usr
      FROM {events})
"""


def spans_of(spark: SparkSession, rows: DataFrame, *further: str) -> DataFrame:
    """Canonical spans of event rows, a table or a stream, which may carry further columns."""
    rules = SPAN_RULES.replace("SELECT ", "SELECT " + "".join(f"{c}, " for c in further), 1)
    return spark.sql(rules, events=event_columns(rows, *further))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical usage spans, one per event."""
    return spark.sql(SPAN_RULES, events=events(spark, sf_dir))


SPANS_SQL = EVENTS_SQL + """,
s0 AS (SELECT *, et IN ('click','view') AS is_chat, et IN ('purchase','signup') AS is_agent, et = 'error' AS is_tool,
  CASE WHEN k % 11 <> 0 THEN 'c' || uid END AS nat, CASE WHEN k % 5 <> 0 THEN 'v' || (uid % 20) END AS conv,
  CASE WHEN (et = 'signup' AND k % 9 <> 0) OR (et IN ('click','view') AND k = 50) THEN 'u' || (uid % 12) END AS usr FROM ev),
spans AS (SELECT 's' || eid AS span_id, eid AS ord,
  CASE WHEN is_chat THEN 'chat' WHEN is_agent THEN 'invoke_agent' ELSE 'execute_tool' END AS operation,
  coalesce(nat, conv) AS session_id, nat AS native_session_id, conv AS conversation_id,
  CASE WHEN k % 17 <> 0 THEN 't' || (eid // 8) END AS trace_id,
  CASE WHEN eid % 64 = 0 THEN 's' || (eid + 1) WHEN k = 97 THEN 'gone' || eid WHEN eid % 8 <> 0 THEN 's' || (eid - 1) END AS parent_span_id,
  k % 13 <> 0 AS parent_known, CASE WHEN k % 19 <> 0 THEN 'm' || (k % 6) END AS model,
  ms AS start_ms, ms + 50 + CAST(floor(val) AS BIGINT) AS end_ms,
  CASE WHEN k % 9 <> 0 THEN CAST(floor(val * 100) AS BIGINT) END AS input,
  CASE WHEN k % 14 <> 0 THEN CAST(floor(val * 10) AS BIGINT) END AS output,
  CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 23 = 0 THEN CAST(floor(val * 100) AS BIGINT) + 1 ELSE CAST(floor(val * 100) AS BIGINT) // 2 END END AS cached,
  CASE WHEN k % 6 = 0 THEN CAST(floor(val) AS BIGINT) END AS cache_write,
  CASE WHEN k % 3 = 0 THEN CAST(floor(val * 2) AS BIGINT) END AS reasoning,
  CASE WHEN k % 7 <> 0 THEN CAST(floor(val * 1e7) AS BIGINT) END AS nano, k % 8 = 0 AS sdk,
  CASE WHEN k % 16 = 0 THEN CAST(floor(val * 1e6) AS BIGINT) END AS sdk_nano,
  CASE WHEN is_chat AND k % 3 <> 0 THEN val * 3 END AS ttft_ms, CASE WHEN is_chat AND k % 5 = 1 THEN val * 7 END AS first_chunk_ms,
  CASE WHEN is_agent AND k % 4 <> 1 THEN CAST(k % 10 AS BIGINT) END AS turns,
  CASE WHEN is_tool AND k % 10 <> 0 THEN 'tool' || (k % 9) END AS tool,
  CASE WHEN k % 8 <> 3 THEN CAST(100000 + k * 10 AS DOUBLE) END AS prompt_limit,
  k % 10 = 0 AS auxiliary, CASE WHEN k % 12 <> 0 THEN 'agent' || (k % 8) END AS agent,
  CASE WHEN is_chat AND k % 15 = 4 THEN 'c' || (uid // 2) END AS parent_session_id,
  CASE WHEN is_chat THEN CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' END END AS effort,
  CASE WHEN et = 'purchase' AND k % 7 <> 0 THEN 'o/r' || (k % 5) END AS repository,
  CASE WHEN et = 'purchase' AND k % 6 <> 0 THEN 'b' || (k % 4) END AS branch,
  usr AS user_name, CASE WHEN usr IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 'span' ELSE 'resource' END END AS user_source,
  CASE WHEN et = 'signup' AND k % 3 = 0 THEN 'act' || (uid % 7) END AS actor_id,
  CASE k % 3 WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS failed,
  CASE WHEN is_chat THEN CASE k % 6 WHEN 0 THEN 'localhost' WHEN 1 THEN 'api.example.com' WHEN 2 THEN '127.0.0.1' WHEN 3 THEN 'gpu-box.lan' END END AS host
  FROM s0)"""


def with_spans(body: str) -> str:
    return "WITH " + SPANS_SQL.strip() + body


def with_events(body: str) -> str:
    return "WITH " + EVENTS_SQL.strip() + body


# Latest agent entry per call for one context, by direct inequality join per key.
def asof_sql(name: str, present: str, payload: str) -> str:
    """CTEs `<name>` (span_id, payload struct p) resolving the four keys in priority order."""
    branch = """
  SELECT c.span_id, {pri} AS pri, a.start_ms AS a_ms, a.ord AS a_ord, {payload} AS p
  FROM spans c JOIN spans a ON a.operation = 'invoke_agent' AND ({present}) AND {on} AND a.start_ms <= c.start_ms
  WHERE c.operation = 'chat'{guard}"""
    guard = (
        " AND (c.native_session_id IS NULL OR a.native_session_id IS NULL OR a.native_session_id = c.native_session_id"
        " OR coalesce(a.native_session_id = c.parent_session_id, FALSE))"
    )
    keys = [
        (1, "a.session_id = c.session_id", ""), (2, "a.conversation_id = c.conversation_id", guard),
        (3, "a.session_id = c.parent_session_id", ""), (4, "a.trace_id = c.trace_id", guard),
    ]
    union = " UNION ALL ".join(
        branch.format(pri=p, payload=payload, present=present, on=on, guard=g) for p, on, g in keys
    )
    return f""",
{name}_all AS ({union}),
{name} AS (SELECT span_id, p FROM {name}_all
  QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY pri, a_ms DESC, a_ord DESC) = 1)"""


ATTRIBUTED_SQL = (
    SPANS_SQL
    + asof_sql("wk", "a.repository IS NOT NULL OR a.branch IS NOT NULL", "{'repository': a.repository, 'branch': a.branch}")
    + asof_sql(
        "ac", "a.user_name IS NOT NULL OR a.actor_id IS NOT NULL",
        "{'user_name': a.user_name, 'actor_id': a.actor_id, 'user_source': a.user_source}",
    )
    + """,
calls AS (SELECT c.*, wk.p.repository AS work_repository, wk.p.branch AS work_branch,
  coalesce(c.user_name, ac.p.user_name) AS user_by,
  CASE WHEN c.user_name IS NOT NULL THEN c.user_source ELSE ac.p.user_source END AS user_by_source,
  coalesce(c.actor_id, ac.p.actor_id) AS actor_by
  FROM spans c LEFT JOIN wk USING (span_id) LEFT JOIN ac USING (span_id) WHERE c.operation = 'chat')"""
)


def with_calls(body: str) -> str:
    return "WITH " + ATTRIBUTED_SQL.strip() + body


POINT_RULES = """
SELECT concat('f', uid % 4) AS feed, eid AS rec, eid AS seq, CASE WHEN k % 11 = 0 THEN '' ELSE concat('c', uid) END AS session,
  CASE et WHEN 'purchase' THEN 'copilot_chat.edit.acceptance.count' WHEN 'signup' THEN 'copilot_chat.lines_of_code.count'
          WHEN 'error' THEN 'copilot_chat.tool.call.count' ELSE 'gen_ai.client.token.usage' END AS metric,
  CASE WHEN et = 'purchase' THEN map('copilot_chat.edit.outcome', CASE WHEN k % 3 <> 0 THEN 'accepted' ELSE 'rejected' END)
       WHEN et = 'signup' THEN map('type', CASE WHEN k % 2 = 0 THEN 'added' ELSE 'removed' END)
       WHEN et = 'error' THEN map('success', CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END)
       ELSE map_filter(map('gen_ai.token.type', CASE WHEN k = 33 THEN 'cached' WHEN et = 'click' THEN 'input' ELSE 'output' END,
                           'gen_ai.response.model', CASE WHEN k % 7 <> 0 THEN concat('m', k % 3) END,
                           'gen_ai.request.model', concat('q', k % 2)), (key, v) -> v IS NOT NULL) END AS attrs,
  CASE WHEN uid % 2 = 0 THEN ms div 864000000 * 864000000 ELSE 0 END AS start_ms,
  CASE WHEN k = 40 THEN 0 WHEN k % 10 = 3 THEN ms - 18000000 ELSE ms END AS at_ms,
  CASE WHEN k = 77 THEN -1D WHEN k = 78 THEN double('Infinity') ELSE double(floor(val)) END AS value
FROM {events}
"""
BOUNDARIES = [0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]
HISTOGRAM_RULES = f"""
SELECT concat('f', uid % 4) AS feed, eid AS rec, eid AS seq, concat('c', uid % 60) AS session,
  CASE et WHEN 'purchase' THEN 'copilot_chat.agent.invocation.duration' WHEN 'signup' THEN 'copilot_chat.time_to_first_token'
          WHEN 'error' THEN 'copilot_chat.tool.call.duration' ELSE 'gen_ai.client.operation.duration' END AS metric,
  CASE WHEN et IN ('click', 'view') THEN map('gen_ai.operation.name', CASE WHEN k % 5 = 0 THEN 'invoke_agent' ELSE 'chat' END)
       ELSE map('service', 'chat') END AS attrs,
  CASE WHEN uid % 2 = 0 THEN ms div 864000000 * 864000000 ELSE 0 END AS start_ms,
  CASE WHEN k = 40 THEN 0 WHEN k % 10 = 3 THEN ms - 18000000 ELSE ms END AS at_ms,
  CASE WHEN k = 77 THEN -1D ELSE double(eid div 500 * 100 + floor(val)) END AS h_sum, double(eid div 500 + k % 3 + 1) AS h_count,
  transform(array({", ".join(map(str, BOUNDARIES))}), b -> double(b)) AS boundaries,
  transform(sequence(0, 15), i -> CASE WHEN i = k % 16 THEN eid div 500 + k % 3 + 1 ELSE i END) AS counts
FROM {{events}}
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter points, one export per event."""
    return spark.sql(POINT_RULES, events=events(spark, sf_dir))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HISTOGRAM_RULES, events=events(spark, sf_dir))


POINTS_SQL = EVENTS_SQL + """,
pts AS (SELECT 'f' || (uid % 4) AS feed, eid AS seq, CASE WHEN k % 11 = 0 THEN '' ELSE 'c' || uid END AS session,
  CASE et WHEN 'purchase' THEN 'copilot_chat.edit.acceptance.count' WHEN 'signup' THEN 'copilot_chat.lines_of_code.count'
          WHEN 'error' THEN 'copilot_chat.tool.call.count' ELSE 'gen_ai.client.token.usage' END AS metric,
  CASE et WHEN 'purchase' THEN CASE WHEN k % 3 <> 0 THEN 'accepted' ELSE 'rejected' END
          WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'added' ELSE 'removed' END
          WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END
          ELSE CASE WHEN k = 33 THEN 'cached' WHEN et = 'click' THEN 'input' ELSE 'output' END END AS tag,
  CASE WHEN et IN ('click', 'view') AND k % 7 <> 0 THEN 'm' || (k % 3) END AS resp,
  CASE WHEN et IN ('click', 'view') THEN 'q' || (k % 2) END AS req,
  CASE WHEN uid % 2 = 0 THEN ms // 864000000 * 864000000 ELSE 0 END AS start_ms,
  CASE WHEN k = 40 THEN 0 WHEN k % 10 = 3 THEN ms - 18000000 ELSE ms END AS at_ms,
  CASE WHEN k = 77 THEN -1.0 WHEN k = 78 THEN 'Infinity'::DOUBLE ELSE floor(val) END AS value FROM ev),
marked AS (SELECT *, value >= 0 AND value < 'Infinity'::DOUBLE AS ok, coalesce(at_ms > 0 AND at_ms < greatest(
    max(CASE WHEN value >= 0 AND value < 'Infinity'::DOUBLE THEN at_ms END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    CASE WHEN row_number() OVER w > 1 THEN first_value(at_ms) OVER w END), FALSE) AS late
  FROM pts WINDOW w AS (PARTITION BY feed, session, start_ms, metric, tag, resp, req ORDER BY seq)),
stepped AS (SELECT *, lag(value) OVER w AS prev FROM marked WHERE ok AND NOT late
  WINDOW w AS (PARTITION BY feed, session, start_ms, metric, tag, resp, req ORDER BY seq)),
inc AS (SELECT *, CASE WHEN start_ms > 0 THEN greatest(0, value - coalesce(max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    WHEN prev IS NULL OR value < prev THEN value ELSE value - prev END AS grown FROM stepped
  WINDOW w AS (PARTITION BY feed, session, start_ms, metric, tag, resp, req ORDER BY seq)),
series AS (SELECT feed, session, start_ms, metric, tag, resp, req, sum(grown) AS total, max(at_ms) AS updated_ms, min(seq) AS first_seq
  FROM inc GROUP BY ALL)"""


def with_points(body: str) -> str:
    return "WITH " + POINTS_SQL.strip() + body


# One recursive step per point of each series: accept or ignore it, as the rules read.
HISTOGRAMS_SQL = EVENTS_SQL + """,
hp AS (SELECT 'f' || (uid % 4) AS feed, eid AS seq, 'c' || (uid % 60) AS session,
  CASE et WHEN 'purchase' THEN 'copilot_chat.agent.invocation.duration' WHEN 'signup' THEN 'copilot_chat.time_to_first_token'
          WHEN 'error' THEN 'copilot_chat.tool.call.duration' ELSE 'gen_ai.client.operation.duration' END AS metric,
  CASE WHEN et IN ('click', 'view') THEN CASE WHEN k % 5 = 0 THEN 'invoke_agent' ELSE 'chat' END ELSE 'none' END AS op,
  CASE WHEN uid % 2 = 0 THEN ms // 864000000 * 864000000 ELSE 0 END AS start_ms,
  CASE WHEN k = 40 THEN 0 WHEN k % 10 = 3 THEN ms - 18000000 ELSE ms END AS at_ms,
  CASE WHEN k = 77 THEN -1.0 ELSE eid // 500 * 100 + floor(val) END AS s, CAST(eid // 500 + k % 3 + 1 AS DOUBLE) AS c, k % 16 AS slot FROM ev),
hn AS (SELECT *, row_number() OVER (PARTITION BY feed, session, metric, op, start_ms ORDER BY seq) AS rn FROM hp),
st AS (
  SELECT feed, session, metric, op, start_ms, rn, seq, slot, at_ms AS mark, s >= 0 AS acc, NOT s >= 0 AS bad,
         CASE WHEN s >= 0 THEN s ELSE 0 END AS last_s, CASE WHEN s >= 0 THEN c ELSE 0 END AS last_c, 0 AS run FROM hn WHERE rn = 1
  UNION ALL
  SELECT n.feed, n.session, n.metric, n.op, n.start_ms, n.rn, n.seq, n.slot,
    CASE WHEN x.acc THEN greatest(t.mark, n.at_ms) ELSE t.mark END, x.acc, NOT x.late AND n.s < 0,
    CASE WHEN x.acc THEN n.s ELSE t.last_s END,
    CASE WHEN x.acc THEN CASE WHEN n.start_ms = 0 AND n.s < t.last_s THEN n.c ELSE greatest(n.c, t.last_c) END ELSE t.last_c END,
    CASE WHEN x.acc AND n.start_ms = 0 AND n.s < t.last_s THEN t.run + 1 ELSE t.run END
  FROM st t JOIN hn n ON n.feed = t.feed AND n.session = t.session AND n.metric = t.metric AND n.op = t.op AND n.start_ms = t.start_ms AND n.rn = t.rn + 1,
  LATERAL (SELECT n.at_ms > 0 AND n.at_ms < t.mark AS late) y,
  LATERAL (SELECT NOT y.late AND n.s >= 0 AND (n.start_ms = 0 OR (n.s >= t.last_s AND n.c >= t.last_c)) AS acc, y.late AS late) x),
runs AS (SELECT feed, session, metric, op, start_ms, run, max(last_s) AS total, max(last_c) AS count, arg_max(slot, seq) AS slot,
           arg_max(c_, seq) AS c_, min(seq) AS first_seq
         FROM (SELECT st.*, hn.c AS c_ FROM st JOIN hn USING (feed, session, metric, op, start_ms, rn) WHERE acc) GROUP BY ALL),
hs AS (SELECT feed, session, metric, op, start_ms, sum(total) AS total, sum(count) AS count, min(first_seq) AS first_seq FROM runs GROUP BY ALL)"""


def with_histograms(body: str) -> str:
    return "WITH RECURSIVE " + HISTOGRAMS_SQL.strip() + body


def with_both(body: str) -> str:
    return "WITH RECURSIVE " + POINTS_SQL.strip() + HISTOGRAMS_SQL.removeprefix(EVENTS_SQL) + body


# ---- log events and chat transcripts ---------------------------------------------------------

LOG_RULES = """
SELECT concat('f', uid % 4) AS feed, eid AS seq, ms AS time_ms, name, attributes FROM (SELECT *,
  CASE WHEN et = 'click' THEN 'copilot_chat.edit.feedback' WHEN et = 'view' AND k % 2 = 0 THEN 'copilot_chat.edit.hunk.action'
       WHEN et = 'view' THEN 'copilot_chat.inline.done' WHEN et = 'purchase' THEN 'copilot_chat.edit.survival'
       WHEN et = 'signup' THEN 'copilot_chat.user.feedback' WHEN k % 2 = 0 THEN 'copilot_chat.tool.call'
       ELSE 'copilot_chat.cloud.session.invoke' END AS name,
  CASE WHEN et = 'click' THEN concat('{{"outcome":"', CASE k % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'ignored' END, '"}}')
       WHEN et = 'view' AND k % 2 = 0 THEN concat('{{"outcome":"', CASE WHEN k % 4 = 0 THEN 'accepted' ELSE 'rejected' END, '","lines_added":',
            CASE WHEN k % 9 = 0 THEN -1 ELSE k END, ',"lines_removed":', CASE WHEN k % 8 = 0 THEN '"5"' WHEN k % 7 = 0 THEN '1.5' ELSE string(k % 5) END, '}}')
       WHEN et = 'view' THEN concat('{{"accepted":', CASE k % 5 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' WHEN 2 THEN 'false' WHEN 3 THEN '"false"' ELSE '"maybe"' END, '}}')
       WHEN et = 'purchase' THEN concat('{{"survival_rate_four_gram":', (k * 2) / 100D, ',"survival_rate_no_revert":', k / 100D,
            ',"did_branch_change":', CASE k % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' ELSE 'false' END, '}}')
       WHEN et = 'signup' THEN concat('{{"rating":"', CASE k % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'none' END, '"}}')
       WHEN k % 2 = 0 THEN concat('{{"success":', CASE k % 6 WHEN 0 THEN 'true' WHEN 2 THEN '"false"' ELSE 'null' END, '}}')
       ELSE '{{}}' END AS attributes
  FROM {events})
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events with attributes as JSON text."""
    return spark.sql(LOG_RULES, events=events(spark, sf_dir))


SIGNALS_SQL = EVENTS_SQL + """,
sig AS (
  SELECT eid, 'copilot_chat.edit.acceptance.count' AS metric, 1.0::DOUBLE AS value,
    'copilot_chat.edit.outcome=' || CASE WHEN et = 'click' THEN CASE k % 3 WHEN 0 THEN 'accepted' ELSE 'rejected' END
      WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 'accepted' ELSE 'rejected' END
      ELSE CASE WHEN k % 5 IN (0, 1) THEN 'accepted' ELSE 'rejected' END END AS series_key
  FROM ev WHERE (et = 'click' AND k % 3 < 2) OR (et = 'view' AND k % 2 = 0) OR (et = 'view' AND k % 2 = 1 AND k % 5 < 4)
  UNION ALL SELECT eid, 'copilot_chat.lines_of_code.count', k, 'type=added' FROM ev WHERE et = 'view' AND k % 4 = 0 AND k % 9 <> 0
  UNION ALL SELECT eid, 'copilot_chat.lines_of_code.count', k % 5, 'type=removed' FROM ev WHERE et = 'view' AND k % 4 = 0 AND k % 8 <> 0 AND k % 7 <> 0
  UNION ALL SELECT eid, 'copilot_chat.edit.survival.four_gram', (k * 2) / 100.0::DOUBLE, '' FROM ev WHERE et = 'purchase' AND k % 4 > 1 AND k <= 50
  UNION ALL SELECT eid, 'copilot_chat.edit.survival.no_revert', k / 100.0::DOUBLE, '' FROM ev WHERE et = 'purchase' AND k % 4 > 1
  UNION ALL SELECT eid, 'copilot_chat.user.feedback.count', 1, 'rating=' || CASE k % 3 WHEN 0 THEN 'positive' ELSE 'negative' END FROM ev WHERE et = 'signup' AND k % 3 < 2
  UNION ALL SELECT eid, 'copilot_chat.tool.call.count', 1, 'success=' || CASE k % 6 WHEN 0 THEN 'true' ELSE 'false' END FROM ev WHERE et = 'error' AND k % 2 = 0 AND k % 6 < 4
  UNION ALL SELECT eid, 'copilot_chat.cloud.session.count', 1, '' FROM ev WHERE et = 'error' AND k % 2 = 1)"""

REQUEST_RULES = """
SELECT concat('c', conv_id) AS session_id, turn AS idx,
  CASE WHEN role = 'assistant' THEN concat('m', length(text) % 6) END AS model,
  CASE WHEN role = 'assistant' AND length(text) % 7 <> 0 THEN double(length(text) % 40) END AS credits,
  CASE WHEN role = 'system' THEN double(length(text) % 300) END AS session_credits
FROM {conversations}
"""
REQUESTS_SQL = """
req AS (SELECT 'c' || conv_id AS session_id, turn AS idx, CASE WHEN role = 'assistant' THEN 'm' || (length(text) % 6) END AS model,
  CASE WHEN role = 'assistant' AND length(text) % 7 <> 0 THEN CAST(length(text) % 40 AS DOUBLE) END AS credits,
  CASE WHEN role = 'system' THEN CAST(length(text) % 300 AS DOUBLE) END AS session_credits FROM conversations),
cost AS (SELECT session_id, greatest(sum(credits), max(session_credits)) AS credits, arg_max(model, idx) FILTER (model IS NOT NULL) AS model
  FROM req GROUP BY 1)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat request usage, one row per conversation turn."""
    return spark.sql(REQUEST_RULES, conversations=table(spark, sf_dir, "conversations"))


# Title and activity of a transcript session, by the number in its id.
CHAT_NUMBER = "CAST(substring(session_id, 2) AS BIGINT)"
CHAT_COLUMNS = [
    f"CASE WHEN {CHAT_NUMBER} % 4 <> 0 THEN 'Chat ' || {CHAT_NUMBER} END AS title", f"{NOW_MS} - {CHAT_NUMBER} * 43200000 AS updated_ms",
]
