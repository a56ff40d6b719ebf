"""Queries over canonical spans: tallies, coverage, sessions, context, ancestry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ancestry, context, merge, sessions, tally
from . import bridge
from .bridge import with_calls, with_spans

CHAT = "WHERE operation = 'chat'"
NANO_SUM = "CAST(sum(nano) AS DOUBLE) / 1e9"


def _copies(spark, d):
    """Every fourth span exported again, later in input order, with other values."""
    spans = bridge.spans(spark, d)
    again = spans.where(F.col("ord") % 4 == 0).withColumn("ord", F.col("ord") + 1_000_000_000).withColumn("input", F.lit(7).cast("bigint"))
    return spans.unionByName(again)


def file_copy(spark, d):
    """Spans the file feed holds: older schema, so some columns are unknown."""
    spans = bridge.spans(spark, d).where(F.col("ord") % 2 == 0)
    return spans.select(*[
        F.lit(None).cast(t).alias(c) if c in ("prompt_limit", "actor_id") else F.col(c) for c, t in spans.dtypes
    ]).withColumn("input", F.col("input") + 1).withColumn("parent_known", F.col("ord") % 3 == 0)


def local_copy(spark, d):
    """Spans the local store holds."""
    spans = bridge.spans(spark, d).where((F.col("ord") % 3 != 0) & (F.col("ord") % 10 < 8))
    hidden = F.col("ord") % 5 == 0
    return spans.withColumn("native_session_id", F.when(~hidden, F.col("native_session_id"))).withColumn(
        "session_id", F.coalesce("native_session_id", "conversation_id")
    ).withColumn("user_name", F.when(~hidden, F.col("user_name"))).withColumn("user_source", F.when(~hidden, F.col("user_source")))


def host_copy(spark, d):
    """Spans the agent-host store holds."""
    return bridge.spans(spark, d).where(F.col("ord") % 5 == 0)


COPIES_SQL = """,
f AS (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS prompt_limit, CAST(NULL AS VARCHAR) AS actor_id, input + 1 AS input, ord % 3 = 0 AS parent_known)
      FROM spans WHERE ord % 2 = 0),
l AS (SELECT * REPLACE (CASE WHEN ord % 5 <> 0 THEN native_session_id END AS native_session_id,
        coalesce(CASE WHEN ord % 5 <> 0 THEN native_session_id END, conversation_id) AS session_id,
        CASE WHEN ord % 5 <> 0 THEN user_name END AS user_name, CASE WHEN ord % 5 <> 0 THEN user_source END AS user_source)
      FROM spans WHERE ord % 3 <> 0 AND ord % 10 < 8),
h AS (SELECT * FROM spans WHERE ord % 5 = 0)"""


def merge_sql(name: str, f: str, s: str) -> str:
    known = ", ".join(f"coalesce(s.{c}, f.{c}) AS {c}" for c in merge.KNOWN_FIRST)
    flags = ", ".join(f"coalesce(s.{c}, FALSE) OR coalesce(f.{c}, FALSE) AS {c}" for c in merge.FLAGS)
    return f""",
{name} AS (SELECT coalesce(f.span_id, s.span_id) AS span_id, coalesce(f.ord, s.ord) AS ord,
  coalesce(s.native_session_id, f.native_session_id) AS native_session_id,
  coalesce(s.native_session_id, f.native_session_id, s.session_id, f.session_id) AS session_id,
  CASE WHEN f.span_id IS NULL OR coalesce(s.parent_known, FALSE) THEN s.parent_span_id ELSE f.parent_span_id END AS parent_span_id,
  CASE WHEN s.user_name IS NOT NULL THEN s.user_source ELSE f.user_source END AS user_source, {known}, {flags}
  FROM {f} f FULL OUTER JOIN {s} s ON f.span_id = s.span_id)"""


def _tally(key: str):
    return lambda spark, d: tally.credits_by(bridge.spans(spark, d), key)


def _attributed_tally(key: str):
    return lambda spark, d: tally.tally(context.attributed_calls(bridge.spans(spark, d)), F.col(key)).drop("nano")


def tally_sql(key: str, source: str = "spans") -> str:
    return f"""
SELECT {key} AS key, count(*) AS calls, count(nano) AS credit_calls, CAST(coalesce(sum(nano), 0) AS DOUBLE) / 1e9 AS credits
FROM {source} {CHAT} GROUP BY 1"""


def topk_sql(key: str, unknown: str, source: str = "spans") -> str:
    return f""",
t AS (SELECT {key} AS key, count(*) AS calls, count(nano) AS credit_calls, coalesce(sum(nano), 0) AS n FROM {source} {CHAT} GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, calls DESC, key NULLS LAST) AS place, count(*) OVER () AS total FROM t)
SELECT coalesce(key, '{unknown}') AS label, calls, credit_calls, CAST(n AS DOUBLE) / 1e9 AS credits FROM r WHERE total <= 6 OR place <= 5
UNION ALL
SELECT (max(total) - 5) || ' more', CAST(sum(calls) AS BIGINT), CAST(sum(credit_calls) AS BIGINT), CAST(sum(n) AS DOUBLE) / 1e9
FROM r WHERE total > 6 AND place > 5 HAVING count(*) > 0"""


SESSION_SQL = f"""
sess AS (SELECT session_id, min(start_ms) AS started_ms, max(end_ms) AS ended_ms, max(end_ms) - min(start_ms) AS duration_ms,
  arg_max(model, (end_ms, start_ms, ord)) FILTER (model IS NOT NULL) AS model,
  arg_max(agent, ord) FILTER (operation = 'invoke_agent' AND agent IS NOT NULL) AS agent_name,
  count(*) FILTER (operation = 'chat') AS llm_calls, count(*) FILTER (operation = 'execute_tool') AS tool_calls,
  CAST(coalesce(sum(input) FILTER (operation = 'chat'), 0) AS BIGINT) AS input,
  CAST(coalesce(sum(output) FILTER (operation = 'chat'), 0) AS BIGINT) AS output,
  CAST(coalesce(sum(cached) FILTER (operation = 'chat'), 0) AS BIGINT) AS cached,
  CAST(sum(nano) FILTER (operation = 'chat') AS DOUBLE) / 1e9 AS credits,
  count(nano) FILTER (operation = 'chat') AS credit_calls,
  count(*) FILTER (operation = 'chat' AND input IS NOT NULL AND output IS NOT NULL) AS token_calls,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (operation = 'chat'), 0) AS BIGINT) AS active_ms
  FROM spans WHERE session_id IS NOT NULL GROUP BY session_id)"""

USERS_SQL = """
firsts AS (SELECT session_id, user_name, min((start_ms, ord)) AS f FROM spans
  WHERE operation = 'invoke_agent' AND user_name IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2),
users AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY f) AS position, user_name FROM firsts),
labels_ AS (SELECT session_id, count(*) AS users,
  string_agg(user_name, ', ' ORDER BY position) FILTER (position <= 3) || CASE WHEN count(*) > 3 THEN ', +' || (count(*) - 3) || ' more' ELSE '' END AS user_label
  FROM users GROUP BY session_id),
work AS (SELECT session_id, arg_max(w, (start_ms, ord)) AS w FROM (
  SELECT session_id, start_ms, ord, {'repository': repository, 'branch': branch} AS w FROM spans WHERE operation = 'invoke_agent'
  AND (repository IS NOT NULL OR branch IS NOT NULL) AND session_id IS NOT NULL) GROUP BY session_id),
swork AS (SELECT coalesce(work.session_id, l.session_id) AS session_id, w.repository AS repository, w.branch AS branch, users, user_label,
  CASE WHEN w.repository IS NULL THEN w.branch WHEN w.branch IS NULL THEN w.repository ELSE w.repository || '@' || w.branch END AS work
  FROM work FULL OUTER JOIN labels_ l ON work.session_id = l.session_id)"""

LATEST_SQL = """
latest AS (SELECT coalesce(session_id, '') AS session_id, model, effort, prompt_limit, host, input, start_ms AS at_ms, ord
  FROM spans WHERE operation = 'chat' AND NOT auxiliary
  QUALIFY row_number() OVER (PARTITION BY coalesce(session_id, '') ORDER BY start_ms DESC, ord) = 1)"""

ROOTS_SQL = """,
walk AS (
  SELECT span_id, trace_id AS own, parent_span_id AS at, 0 AS depth, FALSE AS nested, NOT parent_known AS bad,
         [span_id] AS path FROM spans WHERE sdk AND operation = 'invoke_agent'
  UNION ALL
  SELECT w.span_id, w.own, p.parent_span_id, w.depth + 1, w.nested OR coalesce(p.operation = 'invoke_agent', FALSE),
         p.span_id IS NULL OR coalesce(p.trace_id <> w.own, FALSE) OR NOT p.parent_known OR list_contains(w.path, p.span_id),
         list_append(w.path, p.span_id)
  FROM walk w LEFT JOIN spans p ON p.span_id = w.at WHERE NOT w.bad AND w.at IS NOT NULL),
roots AS (SELECT span_id, CASE WHEN arg_max(bad, depth) THEN 'unknown' WHEN arg_max(nested, depth) THEN 'nested' ELSE 'root' END AS root
  FROM walk GROUP BY span_id)"""


def with_roots(body: str) -> str:
    return "WITH RECURSIVE " + bridge.SPANS_SQL.strip() + ROOTS_SQL + body


def _compact(df, keep):
    return df.select(*keep)


MERGED = ["span_id", "ord", "session_id", "native_session_id", "parent_span_id", "parent_known", "model", "input", "output",
          "prompt_limit", "user_name", "user_source", "actor_id", "failed", "auxiliary"]


def _span_union(spark, d):
    cutoff = bridge.NOW_MS - 7 * 86_400_000
    return merge.span_union(file_copy(spark, d), local_copy(spark, d), host_copy(spark, d), cutoff).select(*MERGED)


QUERIES = {
    "span_dedup": lambda spark, d: merge.span_dedup(_copies(spark, d)).select("span_id", "ord", "input", "output"),
    "credits_by_model": _tally("model"),
    "credits_by_caller": _tally("agent"),
    "credits_by_effort": _tally("effort"),
    "credits_by_repository": _attributed_tally("work_repository"),
    "credits_by_user": _attributed_tally("user_by"),
    "credits_by_actor": _attributed_tally("actor_by"),
    "configured_user_calls": lambda spark, d: tally.configured_user_calls(context.attributed_calls(bridge.spans(spark, d))),
    "context_asof": lambda spark, d: context.attributed_calls(bridge.spans(spark, d)).select(
        "span_id", "work_repository", "work_branch"),
    "actor_provenance": lambda spark, d: context.attributed_calls(bridge.spans(spark, d)).select(
        "span_id", "user_by", "user_by_source", "actor_by"),
    "topk_with_remainder": lambda spark, d: tally.topk_with_remainder(
        tally.tally(tally.chat(bridge.spans(spark, d)), F.col("agent")), "unnamed caller"),
    "chat_totals": lambda spark, d: tally.chat_totals(bridge.spans(spark, d)),
    "sessionless_credits": lambda spark, d: tally.sessionless_credits(bridge.spans(spark, d)),
    "token_coverage": lambda spark, d: tally.token_coverage(tally.chat(bridge.spans(spark, d))),
    "cache_read_ratio": lambda spark, d: tally.cache_read_ratio(tally.chat(bridge.spans(spark, d))),
    "session_rollup": lambda spark, d: sessions.session_rollup(bridge.spans(spark, d)),
    "distinct_users": lambda spark, d: sessions.distinct_users(bridge.spans(spark, d)),
    "session_work": lambda spark, d: sessions.session_work(bridge.spans(spark, d)),
    "session_list": lambda spark, d: sessions.session_rollup(bridge.spans(spark, d)).select("session_id", "ended_ms", "llm_calls")
        .orderBy(F.desc("ended_ms"), "session_id"),
    "latest_call": lambda spark, d: sessions.latest_call(bridge.spans(spark, d)).drop("ord", "input"),
    "latest_call_overall": lambda spark, d: sessions.newest(
        sessions.latest_call(bridge.spans(spark, d)).where(F.col("session_id") != "")).drop("ord", "input"),
    "prompt_context": lambda spark, d: sessions.prompt_context(sessions.latest_call(bridge.spans(spark, d))).drop("ord"),
    "ancestor_walk": lambda spark, d: ancestry.classify_roots(bridge.spans(spark, d)),
    "sdk_root_credits": lambda spark, d: ancestry.sdk_root_credits(bridge.spans(spark, d)),
    "span_merge": lambda spark, d: merge.span_merge(file_copy(spark, d), local_copy(spark, d)).select(*MERGED),
    "harness_only": lambda spark, d: merge.harness_only(host_copy(spark, d), file_copy(spark, d), local_copy(spark, d)),
    "span_union": _span_union,
    "retention_filter": lambda spark, d: merge.retention(bridge.spans(spark, d), bridge.NOW_MS).groupBy("operation").agg(
        F.count(F.lit(1)).alias("spans"), F.min("start_ms").alias("first_ms")),
}

MERGED_COLS = ", ".join(MERGED)

ORACLES = {
    "span_dedup": with_spans("SELECT span_id, ord, input, output FROM spans"),
    "credits_by_model": with_spans(tally_sql("model")),
    "credits_by_caller": with_spans(tally_sql("agent")),
    "credits_by_effort": with_spans(tally_sql("effort")),
    "credits_by_repository": with_calls(tally_sql("work_repository", "calls")),
    "credits_by_user": with_calls(tally_sql("user_by", "calls")),
    "credits_by_actor": with_calls(tally_sql("actor_by", "calls")),
    "configured_user_calls": with_calls(
        "SELECT count(*) FILTER (user_by IS NOT NULL AND user_by_source = 'resource') AS configured_user_calls,"
        " count(user_by) AS user_calls FROM calls"),
    "context_asof": with_calls("SELECT span_id, work_repository, work_branch FROM calls"),
    "actor_provenance": with_calls("SELECT span_id, user_by, user_by_source, actor_by FROM calls"),
    "topk_with_remainder": with_spans(topk_sql("agent", "unnamed caller")),
    "chat_totals": with_spans(
        "SELECT " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("input", "output", "cached", "reasoning", "cache_write"))
        + f", count(*) AS calls, count(nano) AS credit_calls, coalesce({NANO_SUM}, 0.0) AS credits FROM spans {CHAT}"),
    "sessionless_credits": with_spans(
        f"SELECT count(*) AS calls, count(nano) AS credit_calls, coalesce({NANO_SUM}, 0.0) AS credits FROM spans {CHAT} AND session_id IS NULL"),
    "token_coverage": with_spans(" UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST(sum({c}) AS BIGINT) AS tokens, count({c}) AS reported_calls, count({c})::DOUBLE / count(*) AS share FROM spans {CHAT}"
        for c in tally.TOKEN_FIELDS)),
    "cache_read_ratio": with_spans(
        "SELECT sum(cached) FILTER (cached <= input)::DOUBLE / sum(input) FILTER (cached <= input)::DOUBLE AS ratio,"
        f" count(*) FILTER (cached <= input) AS reported_calls, count(*) FILTER (cached <= input)::DOUBLE / count(*) AS share FROM spans {CHAT}"),
    "session_rollup": with_spans("," + SESSION_SQL + " SELECT * FROM sess"),
    "distinct_users": with_spans("," + USERS_SQL + " SELECT * FROM users"),
    "session_work": with_spans("," + USERS_SQL + " SELECT * FROM swork"),
    "session_list": with_spans("," + SESSION_SQL + " SELECT session_id, ended_ms, llm_calls FROM sess ORDER BY ended_ms DESC, session_id"),
    "latest_call": with_spans("," + LATEST_SQL + " SELECT session_id, model, effort, prompt_limit, host, at_ms FROM latest"),
    "latest_call_overall": with_spans("," + LATEST_SQL + " SELECT session_id, model, effort, prompt_limit, host, at_ms FROM latest"
        " WHERE session_id <> '' ORDER BY at_ms DESC, ord LIMIT 1"),
    "prompt_context": with_spans("," + LATEST_SQL + ' SELECT session_id, input AS used, prompt_limit AS "limit", model, at_ms FROM latest'
        " WHERE prompt_limit > 0 AND input IS NOT NULL"),
    "ancestor_walk": with_roots(" SELECT span_id, root FROM roots"),
    "sdk_root_credits": with_roots("""
SELECT count(*) FILTER (operation = 'chat') AS model_calls, count(*) FILTER (root = 'root') AS invocations,
  count(sdk_nano) FILTER (root = 'root') AS reported_invocations,
  coalesce(CAST(sum(sdk_nano) FILTER (root = 'root') AS DOUBLE) / 1e9, 0.0) AS credits, count(*) FILTER (root = 'unknown') AS unclassified
FROM spans LEFT JOIN roots USING (span_id) WHERE sdk"""),
    "span_merge": with_spans(COPIES_SQL + merge_sql("m", "f", "l") + f" SELECT {MERGED_COLS} FROM m"),
    "harness_only": with_spans(COPIES_SQL + " SELECT span_id FROM h EXCEPT (SELECT span_id FROM f UNION SELECT span_id FROM l)"),
    "span_union": with_spans(
        COPIES_SQL.replace("FROM spans WHERE", f"FROM spans WHERE start_ms >= {bridge.NOW_MS - 7 * 86_400_000} AND")
        + merge_sql("m1", "f", "l") + merge_sql("m2", "m1", "h") + f" SELECT {MERGED_COLS} FROM m2"),
    "retention_filter": with_spans(
        f"SELECT operation, count(*) AS spans, min(start_ms) AS first_ms FROM spans WHERE start_ms >= {bridge.NOW_MS - 7 * 86_400_000} GROUP BY 1"),
}
