"""Queries of parsing and ingestion: the JSON feed, trace stores, quota, transcripts, scalar functions.

Feed lines are built from `events`, so each query parses real JSON back and the
SQL states what the parse must yield.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json as j, names, pace, parsing, values
from ..operators import counters, merge, transcripts
from ..session import shared_dir
from ..sources import feed, quota, stores
from ..sources import transcripts as transcript_source
from ..streaming import feed as stream_feed
from . import bridge
from .bridge import with_events, with_spans

HR = "array(ms div 1000, ms % 1000 * 1000000)"
SPAN_LINE = """to_json(named_struct('spanId', concat('s', eid), 'traceId', CASE WHEN k % 17 <> 0 THEN concat('t', eid div 8) END,
  'parentSpanId', CASE WHEN eid % 8 <> 0 THEN concat('s', eid - 1) END, 'startTime', array(ms div 1000, ms % 1000 * 1000000),
  'endTime', array((ms + 50 + floor(val)) div 1000, (ms + 50 + floor(val)) % 1000 * 1000000), 'ended', k % 20 <> 7, 'status', named_struct('code', k % 3),
  'resource', named_struct('_rawAttributes', CASE WHEN k % 4 = 2 THEN array(array('session.id', concat('c', uid)), array('user.name', concat('r', uid % 9)))
     ELSE array(array('session.id', concat('c', uid))) END),
  'attributes', named_struct('gen_ai.operation.name', 'chat', 'copilot_chat.chat_session_id', CASE WHEN k % 11 <> 0 THEN concat('c', uid) END,
    'gen_ai.conversation.id', CASE WHEN k % 5 <> 0 THEN concat('v', uid % 20) END, 'gen_ai.request.model', concat('req', k % 4),
    'gen_ai.response.model', CASE WHEN k % 19 <> 0 THEN concat('m', k % 6) END, 'gen_ai.usage.input_tokens', floor(val * 100),
    'gen_ai.usage.output_tokens', CASE WHEN k % 14 <> 0 THEN val * 10 END, 'gen_ai.usage.cache_creation.input_tokens', CASE WHEN k % 6 = 0 THEN k END,
    'gen_ai.usage.cache_write.input_tokens', CASE WHEN k % 2 = 0 THEN k + 1000 END, 'copilot_chat.copilot_usage_nano_aiu', CASE WHEN k % 7 <> 0 THEN floor(val * 1e7) END,
    'server.address', CASE k % 6 WHEN 0 THEN 'LOCALHOST:11434' WHEN 1 THEN 'https://key:pw@API.example.com:8443/v1?x=1' WHEN 2 THEN '[::1]:8080' WHEN 3 THEN 'bad host!' END,
    'copilot_chat.request.options', concat('@<"stream":true,"reasoning":@<"effort":"', CASE k % 5 WHEN 1 THEN 'HIGH' WHEN 2 THEN 'low' ELSE 'not a word' END, '"@>@>'),
    'gen_ai.request.reasoning.level', CASE WHEN k % 5 = 3 THEN 'Medium' END, 'gen_ai.input.messages', 'never keep this',
    'user.name', CASE WHEN k = 50 THEN concat(' u', uid % 12, ' ') END, 'copilot_chat.debug_log_label', CASE WHEN k % 9 = 0 THEN 'title' END)))"""
METRIC_LINE = """to_json(named_struct('resource', named_struct('_rawAttributes', array(array('session.id', concat('c', uid)))),
  'scopeMetrics', array(named_struct('metrics', array(
    named_struct('descriptor', named_struct('name', CASE WHEN et = 'purchase' THEN 'copilot_chat.edit.acceptance.count' ELSE 'gen_ai.client.token.usage' END),
      'dataPoints', array(named_struct('attributes', named_struct('gen_ai.token.type', 'input', 'n', k % 4, 'gen_ai.system_instructions', 'never keep this'),
        'startTime', array(ms div 1000 - 60, 0), 'endTime', array(ms div 1000, ms % 1000 * 1000000),
        'value', CASE WHEN k % 9 = 0 THEN -1 ELSE bigint(floor(val)) END))),
    named_struct('descriptor', named_struct('name', CASE WHEN k % 6 = 0 THEN '' ELSE 'copilot_chat.agent.turn.count' END),
      'dataPoints', array(named_struct('attributes', named_struct('gen_ai.token.type', CAST(NULL AS STRING), 'n', CAST(NULL AS INT), 'gen_ai.system_instructions', CAST(NULL AS STRING)),
        'startTime', array(0, 0), 'endTime', array(ms div 1000, 0), 'value', k))))))))"""
LINES = f"""
SELECT concat('f', uid % 4) AS feed, eid AS seq, CASE WHEN k % 10 = 0 THEN ' [] ' WHEN k = 1 THEN 'not json' WHEN k = 11 THEN '["broken":' WHEN k = 21 THEN '["foo":1]' WHEN k = 31 THEN '   '
  WHEN et IN ('click', 'view') THEN {SPAN_LINE} WHEN et IN ('purchase', 'signup') THEN {METRIC_LINE}
  ELSE concat('["attributes":["event.name":"copilot_chat.tool.call","success":', CASE WHEN k % 2 = 0 THEN 'true' ELSE '"false"' END, '],"_hrTime":<', ms div 1000, ',', ms % 1000 * 1000000, '>,"_body":"other"]') END AS line
FROM @events
"""


def lines(spark, d):
    """The feed text. Square brackets stand for braces in the rule above, and < > for square brackets."""
    text = LINES.replace("@events", "{events}").replace("@<", "{{").replace("@>", "}}")
    # a split of the table holds far more rows than one of the lines would, and parsing them is the work
    return spark.sql(text, events=bridge.events(spark, d).repartition("eid")).withColumn("line", F.when(
        F.col("line").rlike(r'^\s*\['), F.translate("line", "[]<>", "{}[]")).otherwise(F.col("line")))


def _records(spark, d):
    return feed.feed_scan(lines(spark, d))


def _landed(spark, d):
    """The feed as text segments on shared storage, landed by the stream and read back from its typed tables."""
    root = f"{shared_dir(spark).rstrip('/')}/feed-{uuid.uuid4()}"
    lines(spark, d).select("feed", F.col("line").alias("value")).write.partitionBy("feed").text(f"{root}/in")
    stream_feed.land(stream_feed.feed_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/state").awaitTermination()
    name = F.regexp_replace("feed", "^feed=", "").alias("feed")
    # a feed may be spread over several batches
    kinds = spark.read.parquet(f"{root}/out/stats").groupBy(name).agg(*[F.sum(c).alias(c) for c in ("metrics", "log", "span", "unknown", "malformed", "ignored")])
    points = spark.read.parquet(f"{root}/out/points").groupBy(name).agg(F.count(F.lit(1)).alias("points"))
    return kinds.join(points, "feed", "left").withColumn("points", F.coalesce("points", F.lit(0)).cast("bigint"))


KIND_SQL = """,
ln AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'span' WHEN k = 1 THEN 'ignored' WHEN k = 11 THEN 'malformed' WHEN k = 21 THEN 'unknown' WHEN k = 31 THEN 'ignored'
  WHEN et IN ('click', 'view') THEN 'span' WHEN et IN ('purchase', 'signup') THEN 'metrics' ELSE 'log' END AS kind, 'f' || (uid % 4) AS feed, k % 10 <> 0 AS full_ FROM ev),
pt AS (SELECT feed, eid AS rec, 'c' || uid AS session, CASE WHEN et = 'purchase' THEN 'copilot_chat.edit.acceptance.count' ELSE 'gen_ai.client.token.usage' END AS metric,
    'gen_ai.token.type=input' AS attrs_a, k % 4 AS attrs_n, (ms // 1000 - 60) * 1000.0::DOUBLE AS start_ms, ms::DOUBLE AS at_ms, CASE WHEN k % 9 = 0 THEN -1 ELSE floor(val) END AS value FROM ln WHERE kind = 'metrics'
  UNION ALL SELECT feed, eid, 'c' || uid, 'copilot_chat.agent.turn.count', NULL, NULL, 0, ms // 1000 * 1000, k FROM ln WHERE kind = 'metrics' AND k % 6 <> 0)"""


# ---- trace store as tables --------------------------------------------------------------------

STORE_SPANS = """
SELECT span_id, trace_id, parent_span_id, start_ms AS start_time_ms, end_ms AS end_time_ms, CASE failed WHEN true THEN '2' WHEN false THEN ' 1 ' ELSE '0' END AS status_code,
  operation AS operation_name, agent AS agent_name, conversation_id, model AS response_model, input AS input_tokens, output AS output_tokens, cached AS cached_tokens,
  tool AS tool_name, native_session_id AS chat_session_id, ttft_ms FROM {spans}
"""
STORE_ATTRS = """
SELECT span_id, kv.key, kv.value FROM (SELECT span_id, explode(map_entries(map_filter(map(
  'copilot_chat.copilot_usage_nano_aiu', string(nano), 'gen_ai.usage.cache_write.input_tokens', string(cache_write), 'gen_ai.usage.reasoning.output_tokens', string(reasoning),
  'copilot_chat.request.max_prompt_tokens', CASE WHEN prompt_limit IS NULL THEN '  ' ELSE string(bigint(prompt_limit)) END, 'copilot_chat.turn_count', string(turns),
  'copilot_chat.parent_chat_session_id', parent_session_id, 'github.copilot.git.repository', CASE WHEN repository IS NOT NULL THEN concat('https://x:y@github.com/', repository, '.git') END,
  'copilot_chat.repo.head_branch_name', branch, 'user.name', user_name, 'enduser.pseudo.id', actor_id, 'server.address', host, 'github.copilot.nano_aiu', CASE WHEN sdk THEN string(coalesce(sdk_nano, -1)) END,
  'copilot_chat.request.options', CASE WHEN effort IS NOT NULL THEN concat('{{"reasoning_effort":"', effort, '"}}') END, 'gen_ai.input.messages', 'never keep this'
  ), (k, v) -> v IS NOT NULL))) AS kv FROM {spans})
"""


def _store(spark, d):
    spans = bridge.spans(spark, d)
    return spark.sql(STORE_SPANS, spans=spans), spark.sql(STORE_ATTRS, spans=spans)


STORE_COLS = [
    "span_id", "operation", "session_id", "native_session_id", "conversation_id", "trace_id", "parent_span_id", "parent_known", "model", "input", "output", "cached",
    "cache_write", "reasoning", "nano", "sdk", "sdk_nano", "ttft_ms", "turns", "tool", "prompt_limit", "agent", "parent_session_id", "effort", "repository", "branch",
    "user_name", "actor_id", "failed", "host"]


def _runtime(spark, d):
    spans, attrs = _store(spark, d)
    return merge.runtime_only(spans, attrs).select("span_id", "trace_id")


# ---- quota and history index ------------------------------------------------------------------

QUOTA = """
SELECT c_name AS login, 1704067200000 AS fetched_ms, concat('{{"copilot_plan":"business","quota_reset_date":"', CASE c_custkey % 5 WHEN 0 THEN '2024-02-01' WHEN 1 THEN '2024-02-01T00:00:00Z' WHEN 2 THEN 'soon' ELSE '2024-03-01' END,
  '","token_based_billing":', CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END, ',"quota_snapshots":{{"premium_interactions":{{"entitlement":', CASE c_custkey % 4 WHEN 0 THEN '"1000"' WHEN 1 THEN '300' WHEN 2 THEN '0' ELSE '"x"' END,
  ',"percent_remaining":', CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE string(c_custkey % 130 - 10) END, ',"unlimited":', CASE WHEN c_custkey % 11 = 0 THEN 'true' ELSE 'false' END,
  CASE WHEN c_custkey % 6 = 0 THEN concat(',"quota_remaining":', c_custkey % 400) ELSE '' END, '}},"chat":{{"entitlement":50,"percent_remaining":40,"unlimited":false}}}}}}') AS body
FROM {customer}
"""
INDEX = """
SELECT concat('w', conv_id div 10) AS source, to_json(named_struct('version', CASE WHEN conv_id div 10 % 4 = 3 THEN 2 ELSE 1 END, 'entries', map_from_entries(collect_list(struct(concat('c', conv_id) AS key, named_struct(
  'sessionId', CASE WHEN conv_id % 3 = 0 THEN concat('own', conv_id) END, 'title', CASE WHEN conv_id % 4 = 0 THEN '  ' ELSE concat(' Chat \\n  ', conv_id, ' ') END,
  'lastMessageDate', CASE WHEN conv_id % 5 = 0 THEN -1 ELSE 1700000000000 + conv_id END) AS value))))) AS value
FROM (SELECT DISTINCT conv_id FROM {conversations}) GROUP BY conv_id div 10
"""
# One log line per turn; the number of turns per chat is small but operations interact.
OPS = """
SELECT concat('c', conv_id) AS file_id, turn AS seq, CASE
  WHEN turn = 0 THEN concat('{{"kind":0,"v":{{"sessionId":"c', conv_id, '","customTitle":"Chat ', conv_id, '","requests":[{{"modelId":"m', n % 6, '","copilotCredits":', n % 40, '}},{{"copilotCredits":"5"}}]}}}}')
  WHEN (conv_id + turn) % 6 = 0 THEN concat('{{"kind":2,"k":["requests"],"v":[{{"modelId":"m', n % 6, '","copilotCredits":', n % 40, '}}]}}')
  WHEN (conv_id + turn) % 6 = 1 THEN concat('{{"kind":2,"k":["requests"],"i":', n % 5, ',"v":[{{"copilotCredits":', n % 30, '}},{{"sessionCopilotCredits":', n % 300, '}}]}}')
  WHEN (conv_id + turn) % 6 = 2 THEN concat('{{"kind":1,"k":["requests",', n % 4, ',"copilotCredits"],"v":', n % 50, '}}')
  WHEN (conv_id + turn) % 6 = 3 THEN concat('{{"kind":3,"k":["requests",', n % 3, ']}}')
  WHEN (conv_id + turn) % 6 = 4 THEN concat('{{"kind":1,"k":["customTitle"],"v":"  Renamed ', n, '  "}}') ELSE 'broken line' END AS line
FROM (SELECT *, length(text) AS n FROM {conversations})
"""


def _replayed(spark, d):
    ops, _ = transcript_source.parse_ops(spark.sql(OPS, conversations=bridge.table(spark, d, "conversations")))
    return transcripts.replay(ops.where("op <> 'bad'"))


# ---- scalar functions over whole tables ---------------------------------------------------------

def _variants(frame, *expressions):
    """Every row under every variant expression: (id, variant, raw)."""
    cells = ", ".join(f"struct({i} AS variant, {e} AS raw)" for i, e in enumerate(expressions))
    return frame.selectExpr("id", f"explode(array({cells})) AS c").selectExpr("id", "c.variant", "c.raw")


def _pages(spark, d):
    return bridge.table(spark, d, "pages").selectExpr("page_id AS id", "url")


REMOTES = ["url", "concat('git@github.com:o/r', id, '.git')", "concat('https://user:tok@github.com/O/R', id, '/')", "concat('/home/alice/', id)", "concat('C:\\\\x', id)",
           "concat('ssh://git@gitlab.com/g/p', id, '.git')", "concat('user:secret@host/o/r', id)", "concat('https://user:pw@[bad/o/', id)", "concat('  o/n', id, '.GIT ')", "'  '"]
HOSTS = ["url", "concat('API', id, '.Example.com:8443')", "'[::1]:11434'", "'bad host!'", "concat('h', id, '.example.')", "concat('2001:db8::', hex(id))"]
LINKS = ["url", "concat('https://u:p@h.example/x', id, '?token=1')", "concat('not a url ', id)", "''", "CAST(NULL AS STRING)", "concat('https://H.example:443')", "concat('http://h.example:8080/p', id, '#f')"]
LOCALS = ["concat('127.0.0.', id % 300)", "concat('::ffff:127.0.0.', id % 300)", "concat('0:0:0:0:0:0:0:', id % 3)", "concat('A', id, '.LOCALHOST.')", "'gpu-box.lan'", "concat('a', id, '.gpu-box.lan')",
          "concat('::ffff:7f00:', hex(id))", "concat('[::', id % 3, ']')", "concat('0::', id % 3, ':1')", "concat('128.0.0.', id % 200)"]
BRANCHES = ["concat('alex/AB', id, '-add')", "concat('alex/ab#', id, '_fix')", "concat('team/alex/AB', id)", "concat('alex/', id, '-add')", "concat(id, '-fix')", "concat('alex/#', id, '.patch')",
            "'alex/add-recipe'", "concat('alex/0', id, '-zero')", "concat('alex/ABC', id, '-x')", "concat('alex/', id, 'abc')", "'main'", "concat('bad branch/', id, '-x')", "''"]

PG = "(SELECT page_id AS id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, url LIKE '%?%' AS query, split_part(url, ':', 1) AS scheme FROM pages)"


def variants_sql(table: str, *expressions: str) -> str:
    return " UNION ALL ".join(f"SELECT id, {i} AS variant, {e} FROM {table}" for i, e in enumerate(expressions))


def _scalar(source, expressions, **columns):
    return lambda spark, d: _variants(source(spark, d), *expressions).select("id", "variant", *[c(F.col("raw")).alias(n) for n, c in columns.items()])


def _customers(spark, d):
    return bridge.table(spark, d, "customer").selectExpr("c_custkey + 1 AS id", "c_name")


QUERIES = {
    "feed_scan": lambda spark, d: _records(spark, d).select("feed", "seq", "kind"),
    "classify_records": lambda spark, d: _records(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("records")),
    "feed_stream": _landed,
    "feed_record_stats": lambda spark, d: feed.feed_stats(_records(spark, d)),
    "metric_points": lambda spark, d: feed.metric_points(_records(spark, d)).select(
        "feed", "rec", "session", "metric", F.nullif(counters.series_key(F.col("attrs")), F.lit("")).alias("series_key"), "start_ms", "at_ms", "value"),
    "log_event_project": lambda spark, d: feed.log_events(_records(spark, d)).select(
        "feed", "seq", "name", F.col("time_ms").cast("bigint").alias("time_ms"), j.flag(F.col("attributes"), "success").alias("success")),
    "file_span_scan": lambda spark, d: feed.file_spans(_records(spark, d)).select(
        "span_id", "session_id", "trace_id", "parent_span_id", "parent_known", F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"),
        "model", "input", "output", "cache_write", "nano", "host", "effort", "user_name", "user_source", "failed", "auxiliary"),
    "span_store_scan": lambda spark, d: stores.span_store_scan(*_store(spark, d), 0).select(*STORE_COLS),
    "span_project": lambda spark, d: feed.file_spans(_records(spark, d)).groupBy("model", "host", "effort").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("cache_write").alias("cache_write"), F.sum("output").alias("output")),
    "attr_pivot": lambda spark, d: stores.attr_pivot(_store(spark, d)[1]).select(
        "span_id", F.size("attrs").alias("kept"), F.col("attrs")["user.name"].alias("user_name"), F.col("attrs")["copilot_chat.turn_count"].alias("turns")),
    "effort_lookup": lambda spark, d: stores.span_store_scan(*_store(spark, d), 0).where("operation = 'chat'").select("span_id", "effort"),
    "runtime_only": _runtime,
    "valid_measures": lambda spark, d: bridge.events(spark, d).selectExpr("eid", "CASE WHEN k % 9 = 0 THEN -val WHEN k % 9 = 1 THEN double('NaN') WHEN k % 9 = 2 THEN double('Infinity') WHEN k % 9 = 3 THEN floor(val) * 1e15 WHEN k % 9 = 4 THEN double(floor(val)) ELSE val END AS raw")
        .select("eid", values.nonnegative(F.col("raw")).alias("measure"), values.token_count(F.col("raw")).alias("tokens")),
    "span_status": lambda spark, d: bridge.events(spark, d).selectExpr("eid", "CASE k % 7 WHEN 0 THEN '1' WHEN 1 THEN ' 2 ' WHEN 2 THEN '0' WHEN 3 THEN 'ERROR' WHEN 4 THEN '' WHEN 5 THEN '2.0' END AS raw").select(
        "eid", values.span_failed(F.col("raw")).alias("failed")),
    "hr_to_ms": lambda spark, d: bridge.events(spark, d).selectExpr("eid", f"CASE WHEN k % 10 = 0 THEN array(1L) WHEN k % 10 = 1 THEN NULL ELSE {HR} END AS hr").select(
        "eid", F.coalesce(values.hr_to_ms(F.col("hr")), F.lit(0.0)).alias("ms")),
    "quota_parse": lambda spark, d: quota.quota_parse(spark.sql(QUOTA, customer=bridge.table(spark, d, "customer"))).drop("has_quota", "fetched_ms", "credits_used"),
    "history_index_scan": lambda spark, d: transcript_source.history_index_scan(spark.sql(INDEX, conversations=bridge.table(spark, d, "conversations"))),
    "index_transcript_merge": lambda spark, d: transcripts.index_transcript_merge(
        transcript_source.history_index_scan(spark.sql(INDEX, conversations=bridge.table(spark, d, "conversations"))).withColumn("ord", F.lit(0)),
        transcripts.session_cost(bridge.requests(spark, d)).selectExpr("session_id", "'from file' AS title", "5L AS updated_ms", "credits", "model", "0 AS ord")),
    "transcript_replay": _replayed,
    "transcript_session_cost": lambda spark, d: transcripts.session_cost(_replayed(spark, d)),
    "redact_content": lambda spark, d: bridge.table(spark, d, "documents").select(
        "doc_id", F.parse_json(F.to_json(F.struct(F.col("text").alias("gen_ai.input.messages"), F.col("text").alias("note"), F.col("lang")))).alias("a")).select(
        "doc_id", F.array_join(F.array_sort(F.map_keys(j.redacted_attributes(F.col("a")))), ",").alias("kept"), j.redacted_attributes(F.col("a"))["note"].alias("note")),
    "clean_title": lambda spark, d: bridge.table(spark, d, "documents").select("doc_id", names.clean_title(F.col("text")).alias("title")),
    "normalise_repository": _scalar(_pages, REMOTES, repository=names.repository_name),
    "endpoint_host": _scalar(_pages, HOSTS, host=names.endpoint_host),
    "redact_url": _scalar(_pages, LINKS, shown=names.redact_url),
    "local_endpoint": _scalar(_pages, LOCALS, local=lambda raw: pace.local_endpoint(raw, ("GPU-box.lan",))),
    "identity_name": _scalar(_customers, ["concat('  ', c_name, '\\t')", "concat(c_name, '\\n', id)", "repeat(c_name, id % 10)", "' '"], name=names.identity_name),
    "parse_branch_item": _scalar(_customers, BRANCHES, provider=lambda raw: parsing.branch_item(raw)["provider"], item=lambda raw: parsing.branch_item(raw)["id"]),
    "session_labels": _scalar(_customers, ["c_name", "concat('c', id)"], label=lambda raw: names.session_label(F.when(F.col("id") % 4 == 0, F.lit("Named")), raw),
                              work=lambda raw: names.work_label(F.when(F.col("id") % 3 > 0, raw), F.when(F.col("id") % 2 > 0, F.lit("main")))),
    "pace_scales": lambda spark, d: bridge.table(spark, d, "orders").select(
        "o_orderkey", F.round(pace.credit_weight(F.col("o_totalprice") / 10000), 9).alias("weight"), pace.pace_band(pace.credit_weight(F.col("o_totalprice") / 10000)).alias("band"),
        F.round(pace.context_level(F.col("o_totalprice") * 3), 9).alias("context_level"), pace.effort_level(F.lower(F.substring_index("o_orderpriority", "-", -1))).alias("effort_level")),
}

# One recursive step per log line, on a list of request slots.
REPLAY_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, (conv_id + turn) % 6 AS op, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, []::STRUCT(m VARCHAR, c DOUBLE, s DOUBLE)[] AS l FROM t
  UNION ALL
  SELECT t.conv_id, t.rn, CASE
    WHEN turn = 0 THEN [{'m': 'm' || (n % 6), 'c': (n % 40)::DOUBLE, 's': NULL::DOUBLE}, {'m': NULL, 'c': NULL, 's': NULL}]
    WHEN op = 0 THEN list_append(l, {'m': 'm' || (n % 6), 'c': (n % 40)::DOUBLE, 's': NULL::DOUBLE})
    WHEN op = 1 AND n % 5 <= len(l) THEN l[1:n % 5] || [{'m': NULL::VARCHAR, 'c': (n % 30)::DOUBLE, 's': NULL::DOUBLE}, {'m': NULL, 'c': NULL, 's': (n % 300)::DOUBLE}]
    WHEN op = 2 AND n % 4 <= len(l) THEN l[1:n % 4] || [{'m': l[n % 4 + 1].m, 'c': (n % 50)::DOUBLE, 's': l[n % 4 + 1].s}] || l[n % 4 + 2:]
    WHEN op = 3 AND n % 3 <= len(l) THEN l[1:n % 3] || [{'m': NULL::VARCHAR, 'c': NULL::DOUBLE, 's': NULL::DOUBLE}] || l[n % 3 + 2:]
    ELSE l END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.rn = r.rn + 1),
fin AS (SELECT conv_id, l FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1),
slots AS (SELECT conv_id, idx, l[idx] AS x FROM fin, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS idx))"""

ORACLES = {
    "feed_scan": with_events(KIND_SQL + " SELECT feed, eid AS seq, kind FROM ln"),
    "classify_records": with_events(KIND_SQL + " SELECT kind, count(*) AS records FROM ln GROUP BY 1"),
    "feed_stream": with_events(KIND_SQL + """
      SELECT ln.feed, count(*) FILTER (kind = 'metrics') AS metrics, count(*) FILTER (kind = 'log') AS log, count(*) FILTER (kind = 'span') AS span, count(*) FILTER (kind = 'unknown') AS unknown,
        count(*) FILTER (kind = 'malformed') AS malformed, count(*) FILTER (kind = 'ignored') AS ignored, coalesce(max(n), 0) AS points
      FROM ln LEFT JOIN (SELECT feed, count(*) AS n FROM pt GROUP BY feed) p ON p.feed = ln.feed GROUP BY ln.feed"""),
    "feed_record_stats": with_events(KIND_SQL + """
SELECT feed, count(*) FILTER (kind = 'metrics') AS metrics, count(*) FILTER (kind = 'log') AS log, count(*) FILTER (kind = 'span') AS span, count(*) FILTER (kind = 'unknown') AS unknown,
  count(*) FILTER (kind = 'malformed') AS malformed, count(*) FILTER (kind = 'ignored') AS ignored, max(ms) FILTER (kind IN ('metrics', 'log')) AS last_record_ms,
  max(ms) FILTER (kind = 'metrics' AND et = 'signup') AS last_token_usage_ms FROM ln GROUP BY 1"""),
    "metric_points": with_events(KIND_SQL + " SELECT feed, rec, session, metric, attrs_a || chr(1) || 'n=' || attrs_n AS series_key, start_ms, at_ms, value::DOUBLE AS value FROM pt"),
    "log_event_project": with_events(KIND_SQL + " SELECT feed, eid AS seq, 'copilot_chat.tool.call' AS name, ms AS time_ms, k % 2 = 0 AS success FROM ln WHERE kind = 'log'"),
    "file_span_scan": with_spans(KIND_SQL + """
SELECT span_id, session_id, trace_id, CASE WHEN eid % 8 <> 0 THEN 's' || (eid - 1) END AS parent_span_id, TRUE AS parent_known, start_ms, end_ms,
  coalesce(model, 'req' || (k % 4)) AS model, CAST(floor(val * 100) AS BIGINT) AS input, CASE WHEN k % 14 <> 0 AND val * 10 = floor(val * 10) THEN CAST(val * 10 AS BIGINT) END AS output,
  CASE WHEN k % 6 = 0 THEN k WHEN k % 2 = 0 THEN k + 1000 END::BIGINT AS cache_write, nano, CASE k % 6 WHEN 0 THEN 'localhost' WHEN 1 THEN 'api.example.com' WHEN 2 THEN '::1' END AS host,
  CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' END AS effort, CASE WHEN k = 50 THEN 'u' || (uid % 12) WHEN k % 4 = 2 THEN 'r' || (uid % 9) END AS user_name,
  CASE WHEN k = 50 THEN 'span' WHEN k % 4 = 2 THEN 'resource' END AS user_source, failed, k % 9 = 0 AS auxiliary
FROM spans JOIN ln ON ln.eid = spans.ord WHERE kind = 'span' AND full_ AND k % 20 <> 7"""),
    "span_store_scan": with_spans(" SELECT " + ", ".join(
        {"parent_known": "TRUE AS parent_known", "sdk_nano": "CASE WHEN sdk THEN sdk_nano END AS sdk_nano"}.get(c, c) for c in STORE_COLS) + " FROM spans"),
    "span_project": with_spans(KIND_SQL + """
SELECT coalesce(model, 'req' || (k % 4)) AS model, CASE k % 6 WHEN 0 THEN 'localhost' WHEN 1 THEN 'api.example.com' WHEN 2 THEN '::1' END AS host,
  CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' END AS effort, count(*) AS spans,
  CAST(sum(CASE WHEN k % 6 = 0 THEN k WHEN k % 2 = 0 THEN k + 1000 END) AS BIGINT) AS cache_write, CAST(sum(CASE WHEN k % 14 <> 0 AND val * 10 = floor(val * 10) THEN val * 10 END) AS BIGINT) AS output
FROM spans JOIN ln ON ln.eid = spans.ord WHERE kind = 'span' AND full_ AND k % 20 <> 7 GROUP BY 1, 2, 3"""),
    "attr_pivot": with_spans("""
SELECT span_id, CAST(1 + (nano IS NOT NULL)::INT + (cache_write IS NOT NULL)::INT + (reasoning IS NOT NULL)::INT + (turns IS NOT NULL)::INT + (parent_session_id IS NOT NULL)::INT + (repository IS NOT NULL)::INT
  + (branch IS NOT NULL)::INT + (user_name IS NOT NULL)::INT + (actor_id IS NOT NULL)::INT + (host IS NOT NULL)::INT + sdk::INT + (effort IS NOT NULL)::INT AS INTEGER) AS kept, user_name, CAST(turns AS VARCHAR) AS turns FROM spans"""),
    "effort_lookup": with_spans(" SELECT span_id, effort FROM spans WHERE operation = 'chat'"),
    "runtime_only": with_spans(" SELECT span_id, trace_id FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE repository IS NOT NULL OR sdk)"),
    "valid_measures": with_events("""
, r AS (SELECT eid, CASE WHEN k % 9 = 0 THEN -val WHEN k % 9 IN (1, 2) THEN NULL WHEN k % 9 = 3 THEN floor(val) * 1e15 WHEN k % 9 = 4 THEN floor(val) ELSE val END AS x FROM ev)
SELECT eid, CASE WHEN x >= 0 THEN x END AS measure, CASE WHEN x >= 0 AND x = floor(x) AND x <= 9007199254740991 THEN CAST(x AS BIGINT) END AS tokens FROM r"""),
    "span_status": with_events(" SELECT eid, CASE WHEN k % 7 = 0 THEN FALSE WHEN k % 7 IN (1, 5) THEN TRUE END AS failed FROM ev"),
    "hr_to_ms": with_events(" SELECT eid, CASE WHEN k % 10 < 2 THEN 0.0 ELSE ms END::DOUBLE AS ms FROM ev"),
    "quota_parse": """
WITH q AS (SELECT *, c_custkey AS c, CASE c_custkey % 4 WHEN 0 THEN 1000.0 WHEN 1 THEN 300.0 WHEN 2 THEN 0.0 END AS ent, c_custkey % 11 = 0 AS unl FROM customer),
p AS (SELECT *, unl OR coalesce(ent <> 0, TRUE) AS paid FROM q),
s AS (SELECT *, paid AND unl AS unlimited, CASE WHEN paid THEN CASE WHEN NOT unl THEN ent END ELSE 50.0 END AS allowance,
  CASE WHEN paid THEN CASE WHEN c % 7 <> 0 THEN greatest(0.0, least(100.0, c % 130 - 10)) END ELSE 40.0 END AS pct, CASE WHEN paid AND c % 6 = 0 THEN c % 400 END AS remaining FROM p),
e AS (SELECT *, CASE WHEN NOT unlimited AND pct IS NULL THEN 'remaining allowance not reported' WHEN c % 5 = 2 THEN 'invalid reset date' END AS reason,
  CASE WHEN allowance > 0 AND pct IS NOT NULL THEN greatest(0.0, coalesce(allowance - remaining, allowance * (100 - pct) / 100)) END AS used FROM s)
SELECT c_name AS login, CASE WHEN reason IS NULL THEN 'ready' ELSE 'error' END AS status, reason, CASE WHEN reason IS NULL THEN 'business' END AS plan,
  CASE WHEN reason IS NULL THEN CASE WHEN c % 3 = 0 THEN 'credits' WHEN paid THEN 'premium requests' ELSE 'chat requests' END END AS unit, CASE WHEN reason IS NULL THEN unlimited END AS unlimited,
  CASE WHEN reason IS NULL THEN allowance END::DOUBLE AS allowance, CASE WHEN reason IS NULL THEN used END::DOUBLE AS used, CASE WHEN reason IS NULL THEN used IS NOT NULL AND remaining IS NULL END AS approximate,
  CASE WHEN reason IS NULL THEN pct END::DOUBLE AS percent_remaining, CASE WHEN reason IS NULL THEN CASE WHEN c % 5 < 2 THEN 1706745600000 ELSE 1709251200000 END END AS reset_ms FROM e""",
    "history_index_scan": """
SELECT 'w' || (conv_id // 10) AS source, CASE WHEN conv_id % 3 = 0 THEN 'own' ELSE 'c' END || conv_id AS session_id, CASE WHEN conv_id % 4 <> 0 THEN 'Chat ' || conv_id END AS title, 1700000000000 + conv_id AS updated_ms
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id // 10 % 4 <> 3 AND conv_id % 5 <> 0""",
    "index_transcript_merge": "WITH " + bridge.REQUESTS_SQL.strip() + """,
ix AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'own' ELSE 'c' END || conv_id AS session_id, CASE WHEN conv_id % 4 <> 0 THEN 'Chat ' || conv_id END AS title, 1700000000000 + conv_id AS updated_ms
  FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id // 10 % 4 <> 3 AND conv_id % 5 <> 0)
SELECT coalesce(ix.session_id, cost.session_id) AS session_id, coalesce(ix.title, CASE WHEN cost.session_id IS NOT NULL THEN 'from file' END) AS title, coalesce(ix.updated_ms, 5) AS updated_ms, credits, model
FROM ix FULL OUTER JOIN cost ON ix.session_id = cost.session_id""",
    "redact_content": "SELECT doc_id, CASE WHEN length(text) <= 512 THEN 'lang,note' ELSE 'lang' END AS kept, CASE WHEN length(text) <= 512 THEN text END AS note FROM documents",
    "clean_title": r"SELECT doc_id, CASE WHEN length(text) <= 512 THEN nullif(trim(regexp_replace(text, '[\s\x0B\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')), '') END AS title FROM documents",
    "normalise_repository": "SELECT id, variant, repository FROM (" + variants_sql(
        PG, "regexp_replace(host || '/' || regexp_replace(path, '^/+', ''), '/+$', '') AS repository", "'o/r' || id", "'O/R' || id", "NULL", "NULL", "'gitlab.com/g/p' || id", "NULL", "NULL", "'o/n' || id", "NULL") + ")",
    "endpoint_host": "SELECT * FROM (" + variants_sql(PG, "lower(host) AS host", "'api' || id || '.example.com'", "'::1'", "NULL", "'h' || id || '.example'", "'2001:db8::' || lower(to_hex(id))") + ")",
    "redact_url": "SELECT * FROM (" + variants_sql(
        PG, "scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query THEN '?<redacted>' ELSE '' END AS shown", "'https://<redacted>@h.example/x' || id || '?<redacted>'",
        "'(unparseable, withheld)'", "'(none)'", "'(none)'", "'https://h.example/'", "'http://h.example:8080/p' || id") + ")",
    "local_endpoint": "SELECT * FROM (" + variants_sql(
        "(SELECT page_id AS id FROM pages)", "CASE WHEN id % 300 <= 255 THEN 'loopback' END AS local", "CASE WHEN id % 300 <= 255 THEN 'loopback' END", "CASE WHEN id % 3 = 1 THEN 'loopback' END", "'loopback'", "'configured'", "NULL",
        "CASE WHEN length(to_hex(id)) <= 4 THEN 'loopback' END", "CASE WHEN id % 3 = 1 THEN 'loopback' END", "CASE WHEN id % 3 = 0 THEN 'loopback' END", "NULL") + ")",
    "identity_name": "SELECT * FROM (" + variants_sql(
        "(SELECT c_custkey + 1 AS id, c_name FROM customer)", "c_name AS name", "NULL", "CASE WHEN length(c_name) * (id % 10) BETWEEN 1 AND 128 THEN repeat(c_name, CAST(id % 10 AS INTEGER)) END", "NULL") + ")",
    "parse_branch_item": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT c_custkey + 1 AS id, {i} AS variant, {p} AS provider, CASE WHEN {p} IS NOT NULL THEN c_custkey + 1 END AS item FROM customer"
        for i, p in enumerate(["'azure-boards'"] * 3 + ["'github'"] * 3 + ["NULL"] * 7)) + ")",
    "session_labels": "SELECT id, variant, CASE WHEN id % 4 = 0 THEN 'Named' WHEN length(raw) > 12 THEN raw[:8] || '…' ELSE raw END AS label, CASE WHEN id % 3 > 0 AND id % 2 > 0 THEN raw || '@main' WHEN id % 3 > 0 THEN raw WHEN id % 2 > 0 THEN 'main' END AS work FROM ("
        + variants_sql("(SELECT c_custkey + 1 AS id, c_name FROM customer)", "c_name AS raw", "'c' || id") + ")",
    "pace_scales": """
SELECT o_orderkey, round(w, 9) AS weight, CASE WHEN w < 1.0/3 THEN 'snowy' WHEN w < 2.0/3 THEN 'mild' ELSE 'thawing' END AS band,
  round(greatest(0.0, least(1.0, ln(o_totalprice * 3 / 32000) / ln(31.25)))::DOUBLE, 9) AS context_level,
  CAST(CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'low' THEN 0.2 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 END AS DOUBLE) AS effort_level
FROM (SELECT *, CASE WHEN o_totalprice / 10000 >= 25 THEN 1.0 WHEN o_totalprice / 10000 > 0.05 THEN ln(o_totalprice / 10000 / 0.05) / ln(500) ELSE 0.0 END::DOUBLE AS w FROM orders)""",
    "transcript_replay": REPLAY_SQL + " SELECT 'c' || conv_id AS session_id, idx - 1 AS idx, x.m AS model, x.c AS credits, x.s AS session_credits FROM slots",
    "transcript_session_cost": REPLAY_SQL + """
SELECT 'c' || conv_id AS session_id, greatest(sum(x.c), max(x.s)) AS credits, arg_max(x.m, idx) FILTER (x.m IS NOT NULL) AS model FROM slots GROUP BY 1""",
}
