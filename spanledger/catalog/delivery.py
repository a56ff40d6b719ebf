"""Queries of attribution coverage, delivery cycles, people and billing.

The CLI session store is derived from `orders` (usage events, references) and
`customer` (sessions); trace calls, pull requests, assignments and billing from `events`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import parsing
from ..operators import actors, billing, context, coverage, cycles, tally
from ..sources import stores
from ..session import cut
from ..sources.billing import billing_parse
from ..sources.once import computed_once
from . import bridge
from .bridge import with_calls, with_events, with_spans

STORE_CUTOFF = 0  # the whole store
WINDOW_CUTOFF = 959_860_800_000  # 2000-06-01T12:00:00Z
CLOCK = "concat_ws(':', lpad(string(o_orderkey % 24), 2, '0'), lpad(string(o_orderkey % 60), 2, '0'), lpad(string(o_orderkey % 59), 2, '0'))"
STORE_EVENTS = f"""
SELECT o_orderkey AS id, concat('s', o_custkey) AS session_id, concat('m', o_orderkey % 6) AS model,
  CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice) END AS input_tokens, o_orderkey % 100 AS output_tokens,
  CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice / CASE WHEN o_orderkey % 23 = 0 THEN 0.5D ELSE 2D END) END AS cache_read_tokens,
  CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '-5' ELSE string(bigint(floor(o_totalprice * 1000))) END AS total_nano_aiu,
  CASE WHEN o_orderkey % 7 = 0 THEN 'sub-agent' ELSE 'user' END AS initiator,
  CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS reasoning_effort,
  CASE o_orderkey % 6 WHEN 0 THEN concat(d, 'T', c, '.000Z') WHEN 1 THEN concat(d, ' ', c) WHEN 2 THEN concat(d, 'T', c, '+02:00')
    WHEN 3 THEN d WHEN 4 THEN 'garbage' ELSE concat(d, 'T', c, '-05:00') END AS created_at
FROM (SELECT *, string(date(o_orderdate)) AS d, {CLOCK} AS c FROM {{orders}})
"""
STORE_SESSIONS = """
SELECT concat('s', c_custkey) AS id, CASE c_nationkey % 6 WHEN 0 THEN concat('https://github.com/o/r', c_nationkey, '.git')
    WHEN 1 THEN concat('git@github.com:o/r', c_nationkey, '.git') WHEN 2 THEN concat('https://user:tok@dev.azure.com/org/p/_git/r', c_nationkey)
    WHEN 3 THEN concat('/home/x/r', c_nationkey) WHEN 5 THEN concat('o/r', c_nationkey) END AS repository,
  CASE c_custkey % 5 WHEN 0 THEN concat('dev/', c_nationkey + 1, '-feature') WHEN 1 THEN concat('alex/AB', c_nationkey + 1, '-x')
    WHEN 2 THEN 'main' WHEN 4 THEN 'spike' END AS branch
FROM {customer}
"""
STORE_REFS = """
SELECT concat('s', o_custkey) AS session_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'pr' WHEN '2-HIGH' THEN 'issue' WHEN '3-MEDIUM' THEN 'commit' WHEN '4-NOT SPECIFIED' THEN 'pr' ELSE 'note' END AS ref_type,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'short' ELSE lpad(hex(o_orderkey), 8, 'A') END
    WHEN o_orderkey % 4 = 0 THEN concat('#', o_orderkey % 50) WHEN o_orderkey % 4 = 1 THEN concat('O/R5#', o_orderkey % 50)
    WHEN o_orderkey % 4 = 2 THEN concat('https://github.com/o/r6/pull/', o_orderkey % 50) ELSE 'fix the login bug' END AS ref_value,
  timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) div 1000 AS at_ms
FROM {orders}
"""


def _store(spark, d):
    orders = bridge.table(spark, d, "orders")
    return {
        "assistant_usage_events": spark.sql(STORE_EVENTS, orders=orders),
        "sessions": spark.sql(STORE_SESSIONS, customer=bridge.table(spark, d, "customer")),
        "session_refs": spark.sql(STORE_REFS, orders=orders),
    }


def _dated(spark, d):
    events = spark.sql(STORE_EVENTS, orders=bridge.table(spark, d, "orders")).select("id", "created_at")
    return computed_once(events, at_ms=parsing.timestamp_ms(F.col("created_at")), date_only=parsing.date_only(F.col("created_at")))


def _usage(spark, d):
    return stores.usage_context(_store(spark, d), STORE_CUTOFF)


STORE_SQL = f"""
o0 AS (SELECT *, o_orderkey AS ok, epoch_us(o_orderdate) // 1000 AS dms,
  (o_orderkey % 24) * 3600000 + (o_orderkey % 60) * 60000 + (o_orderkey % 59) * 1000 AS clk FROM orders),
o1 AS (SELECT *, CASE ok % 6 WHEN 0 THEN dms + clk WHEN 1 THEN dms + clk WHEN 2 THEN dms + clk - 7200000 WHEN 5 THEN dms + clk + 18000000 END AS at_ms FROM o0),
cs AS (SELECT 's' || c_custkey AS id, CASE c_nationkey % 6 WHEN 0 THEN 'o/r' || c_nationkey WHEN 1 THEN 'o/r' || c_nationkey
   WHEN 2 THEN 'dev.azure.com/org/p/_git/r' || c_nationkey WHEN 5 THEN 'o/r' || c_nationkey END AS repository,
  CASE c_custkey % 5 WHEN 0 THEN 'dev/' || (c_nationkey + 1) || '-feature' WHEN 1 THEN 'alex/AB' || (c_nationkey + 1) || '-x' WHEN 2 THEN 'main' WHEN 4 THEN 'spike' END AS branch,
  CASE c_custkey % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'azure-boards' END AS provider, CASE WHEN c_custkey % 5 < 2 THEN c_nationkey + 1 END AS item_id FROM customer),
rf AS (SELECT 's' || o_custkey AS session_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'pr' WHEN '2-HIGH' THEN 'issue' WHEN '3-MEDIUM' THEN 'commit' WHEN '4-NOT SPECIFIED' THEN 'pr' ELSE 'note' END AS ref_type,
  o_orderkey AS ok, epoch_us(o_orderdate) // 1000 AS at_ms FROM orders),
fl AS (SELECT session_id, bool_or(ref_type <> 'note') AS has_work_ref, bool_or(ref_type = 'pr') AS has_pr FROM rf GROUP BY 1),
us AS (SELECT 's' || o_custkey AS session_id, 'm' || (ok % 6) AS model, CASE WHEN ok % 9 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS input,
  CASE WHEN ok % 4 <> 0 THEN CAST(floor(o_totalprice / CASE WHEN ok % 23 = 0 THEN 0.5 ELSE 2 END) AS BIGINT) END AS cached,
  CASE WHEN ok % 11 > 2 THEN CAST(floor(o_totalprice * 1000) AS BIGINT) END AS nano, CASE WHEN ok % 7 = 0 THEN 'sub-agent' ELSE 'user' END AS initiator,
  CASE ok % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS reasoning_effort, at_ms,
  strftime(CASE WHEN ok % 6 = 3 THEN o_orderdate ELSE make_timestamp(at_ms * 1000) END, '%Y-%m-%d') AS day,
  cs.repository, cs.branch, coalesce(fl.has_work_ref, FALSE) AS has_work_ref, coalesce(fl.has_pr, FALSE) AS has_pr
  FROM o1 LEFT JOIN cs ON cs.id = 's' || o_custkey LEFT JOIN fl ON fl.session_id = 's' || o_custkey
  WHERE at_ms >= {STORE_CUTOFF} OR (ok % 6 = 3 AND dms > {STORE_CUTOFF // 86_400_000 * 86_400_000}))"""


def with_store(body: str) -> str:
    return "WITH " + STORE_SQL.strip() + body


def _traces(spark, d):
    return coverage.trace_calls(context.attributed_calls(bridge.spans(spark, d)))


TRACES_SQL = """,
tc AS (SELECT coalesce(native_session_id, parent_session_id) AS session_key,
  coalesce(native_session_id, parent_session_id, conversation_id, trace_id) IS NOT NULL AS linked, nano, input, cached, work_repository AS repository, work_branch AS branch,
  FALSE AS has_work_ref, FALSE AS has_pr, user_by AS "user", native_session_id IS NULL AND parent_session_id IS NOT NULL AS sub_agent, effort,
  CASE WHEN native_session_id IS NOT NULL THEN 'chat session' WHEN parent_session_id IS NOT NULL THEN 'parent session' ELSE 'none' END AS link,
  start_ms AS at_ms, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS day FROM calls)"""
STORE_CALLS_SQL = """,
sc AS (SELECT session_id AS session_key, TRUE AS linked, nano, input, cached, repository, branch, has_work_ref, has_pr, NULL AS "user", initiator = 'sub-agent' AS sub_agent,
  reasoning_effort AS effort, at_ms, day FROM us)"""


def funnel_sql(source: str, refs: bool) -> str:
    conds = ["TRUE", "linked", "repository IS NOT NULL", "branch IS NOT NULL", "has_work_ref", "has_pr"]
    rows = []
    for i, stage in enumerate(coverage.STAGES):
        where = " AND ".join(conds[: i + 1])
        emitted = refs or i < 4
        rows.append(f"SELECT '{stage}' AS stage, {emitted} AS emitted, count(DISTINCT session_key) AS sessions, count(*) AS calls,"
                    f" coalesce(CAST(sum(nano) AS DOUBLE) / 1e9, 0.0) AS credits FROM {source} WHERE {where}")
    return " " + " UNION ALL ".join(rows)


def metrics_sql(source: str, refs: bool, actor: bool) -> str:
    def share(cond: str, ok: bool = True) -> str:
        return f"CAST(coalesce(sum(nano) FILTER ({cond}), 0) AS DOUBLE) / CAST(sum(nano) AS DOUBLE)" if ok else "CAST(NULL AS DOUBLE)"
    return f""" SELECT count(*) AS calls, count(nano) AS credited_calls, CAST(sum(nano) AS DOUBLE) / 1e9 AS credits, count(nano)::DOUBLE / count(*) AS credit_coverage,
  {share('repository IS NOT NULL')} AS credits_to_repo_share, {share('repository IS NOT NULL AND branch IS NOT NULL AND has_work_ref AND has_pr AND linked', refs)} AS credits_to_pr_share,
  {share('"user" IS NOT NULL', actor)} AS credits_to_actor_share, {share('sub_agent')} AS sub_agent_share,
  sum(cached) FILTER (cached <= input)::DOUBLE / sum(input) FILTER (cached <= input)::DOUBLE AS cache_read_ratio, count(*) FILTER (cached <= input) AS cache_pairs FROM {source}"""


def breakdown_sql(source: str, kinds: dict[str, str]) -> str:
    return " " + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, coalesce({c}, '(none)') AS key, count(*) AS calls, coalesce(CAST(sum(nano) AS DOUBLE) / 1e9, 0.0) AS credits FROM {source} GROUP BY 2"
        for k, c in kinds.items())


TRACE_KINDS = {"repository": "repository", "user": "user", "effort": "effort", "link": "link"}

# ---- delivery cycles --------------------------------------------------------------------------


def _cycle_calls(spark, d):
    columns = ["repository", "branch", "user", "session", "model", "nano", "at_ms", "day"]
    traced = context.attributed_calls(bridge.spans(spark, d)).selectExpr(
        "work_repository AS repository", "work_branch AS branch", "user_by AS user", "session_id AS session", "model", "nano", "start_ms AS at_ms",
        "string(date_from_unix_date(int(start_ms div 86400000))) AS day")
    stored = _usage(spark, d).selectExpr(
        "repository", "branch", "CAST(NULL AS STRING) AS user", "session_id AS session", "model", "nano", "at_ms", "day")
    return coverage.union_sources({"traces": traced.select(*columns), "sessionStore": stored.select(*columns)})


CYCLE_SQL = "," + STORE_SQL + """,
cc AS (SELECT 'traces' AS source, work_repository AS repository, work_branch AS branch, user_by AS usr, model, nano, start_ms AS at_ms,
    strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS day FROM calls
  UNION ALL SELECT 'sessionStore', repository, branch, NULL, model, nano, at_ms, day FROM us),
ck AS (SELECT *, repository || '#' || coalesce(branch, '') AS cycle_key FROM cc),
src AS (SELECT cycle_key, repository, branch, source, count(*) AS calls, count(nano) AS credit_calls, CAST(sum(nano) AS DOUBLE) / 1e9 AS credits,
  min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM ck WHERE repository IS NOT NULL GROUP BY 1, 2, 3, 4),
cy AS (SELECT cycle_key, repository, branch, min(first_ms) AS first_ms, max(last_ms) AS last_ms, CAST(sum(calls) AS BIGINT) AS calls,
  CASE WHEN branch LIKE 'dev/%-feature' THEN 'github' WHEN branch LIKE 'alex/AB%-x' THEN 'azure-boards' END AS provider,
  CAST(CASE WHEN branch LIKE 'dev/%-feature' OR branch LIKE 'alex/AB%-x' THEN regexp_extract(branch, '([0-9]+)-', 1) END AS BIGINT) AS item_id
  FROM src GROUP BY 1, 2, 3)"""


def with_cycles(body: str) -> str:
    return with_calls(CYCLE_SQL + body)


def _refs(spark, d):
    """References with the normalised repository and branch of their session."""
    tables = _store(spark, d)
    sessions = tables["sessions"].select(
        F.col("id").alias("session_id"), stores.repository_name(F.col("repository")).alias("repository"), "branch")
    return tables["session_refs"].join(sessions, "session_id").select("repository", "branch", "ref_type", "ref_value", "at_ms")


REFS_SQL = """,
rr AS (SELECT cs.repository, cs.branch, ref_type, at_ms, rf.ok, cs.repository || '#' || coalesce(cs.branch, '') AS cycle_key,
  CASE WHEN ref_type = 'commit' THEN CASE WHEN ok % 4 <> 0 THEN lower(lpad(to_hex(ok), 8, 'A')) END
    WHEN ref_type IN ('pr', 'issue') AND ok % 50 > 0 AND (ok % 4 = 0 OR (ok % 4 = 1 AND cs.repository = 'o/r5') OR (ok % 4 = 2 AND cs.repository = 'o/r6')) THEN CAST(ok % 50 AS VARCHAR) END AS named
  FROM rf JOIN cs ON cs.id = rf.session_id),
rec AS (SELECT cycle_key, ref_type AS kind, named, min(at_ms) AS first_ms FROM rr WHERE named IS NOT NULL AND cycle_key IS NOT NULL GROUP BY 1, 2, 3)"""

PULLS = """
SELECT concat('O/R', k % 5) AS repository, eid AS number, concat('b', k % 4) AS head, ms AS created_ms, CASE WHEN k % 3 = 0 THEN ms + 3600000 * (1 + k) END AS merged_ms,
  CASE WHEN k % 3 < 2 THEN ms + 3600000 * (1 + k) END AS closed_ms, concat('U', uid % 12) AS author, CASE WHEN k % 10 = 0 THEN 'Bot' ELSE 'User' END AS author_kind,
  CAST(k % 4 AS BIGINT) AS reviews, CAST(k % 6 AS BIGINT) AS commits FROM {events} WHERE et = 'purchase'
"""
PULLS_SQL = """,
pr AS (SELECT 'o/r' || (k % 5) AS repository, eid AS number, 'b' || (k % 4) AS head, ms AS created_ms, CASE WHEN k % 3 = 0 THEN ms + 3600000 * (1 + k) END AS merged_ms,
  CASE WHEN k % 3 < 2 THEN ms + 3600000 * (1 + k) END AS closed_ms, 'u' || (uid % 12) AS author, k % 10 = 0 AS is_bot, k % 4 AS reviews, k % 6 AS commits FROM ev WHERE et = 'purchase'),
prm AS (SELECT cy.cycle_key, count(number) AS candidates, arg_max({'number': number, 'created_ms': created_ms, 'merged_ms': merged_ms, 'closed_ms': closed_ms, 'author': author,
    'is_bot': is_bot, 'reviews': reviews, 'commits': commits}, (created_ms, number)) FILTER (number IS NOT NULL AND (closed_ms IS NULL OR closed_ms >= cy.first_ms)) AS m
  FROM cy LEFT JOIN pr ON pr.repository = cy.repository AND pr.head = cy.branch GROUP BY 1)"""
ITEMS = """
SELECT DISTINCT CASE WHEN c_custkey % 5 = 0 THEN 'github' ELSE 'azure-boards' END AS provider, CASE WHEN c_custkey % 5 = 0 THEN concat('o/r', c_nationkey) END AS repository,
  CAST(c_nationkey + 1 AS BIGINT) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Bug' ELSE 'User Story' END AS type, CASE WHEN c_nationkey % 2 = 0 THEN 'Completed' ELSE 'InProgress' END AS category,
  CAST(NULL AS BIGINT) AS closed_ms FROM {customer} WHERE c_custkey % 5 < 2
"""
ITEMS_SQL = """,
it AS (SELECT DISTINCT provider, CASE WHEN c_custkey % 5 = 0 THEN 'o/r' || c_nationkey END AS repository, item_id AS id, c_nationkey % 2 = 0 AS done,
  CASE WHEN c_custkey % 5 = 0 THEN 'Bug' ELSE 'User Story' END AS type FROM cs JOIN customer ON cs.id = 's' || c_custkey WHERE item_id IS NOT NULL),
im AS (SELECT cycle_key, max(it.id) AS item_id, max(it.type) AS type, bool_or(done) AS item_closed FROM cy LEFT JOIN it ON it.provider = cy.provider AND it.id = cy.item_id
  AND (cy.provider = 'azure-boards' OR it.repository = cy.repository) WHERE cy.item_id IS NOT NULL GROUP BY 1)"""
STEPS_SQL = """,
hd AS (SELECT cycle_key, bool_or(kind = 'issue') AS hi, bool_or(kind = 'commit') AS hc, bool_or(kind = 'pr') AS hp FROM rec GROUP BY 1),
st AS (SELECT cy.cycle_key, u.place, u.step, u.ev FROM cy LEFT JOIN hd USING (cycle_key) LEFT JOIN prm USING (cycle_key) LEFT JOIN im USING (cycle_key),
  LATERAL (VALUES (1, 'workItem', CASE WHEN im.item_id IS NOT NULL THEN 'verified' WHEN hi THEN 'recorded' WHEN cy.item_id IS NOT NULL THEN 'convention' END),
    (2, 'branch', CASE WHEN cy.branch IS NOT NULL THEN 'observed' END), (3, 'aiWork', 'observed'),
    (4, 'commits', CASE WHEN m.number IS NOT NULL AND m.commits > 0 THEN 'verified' WHEN hc THEN 'recorded' END),
    (5, 'pullRequest', CASE WHEN m.number IS NOT NULL THEN 'verified' END), (6, 'review', CASE WHEN m.number IS NOT NULL AND m.reviews > 0 THEN 'verified' END),
    (7, 'close', CASE WHEN m.merged_ms IS NOT NULL AND coalesce(item_closed, TRUE) THEN 'verified' END)) u(place, step, ev)),
sp AS (SELECT cycle_key, CAST(max(CASE WHEN ev IS NOT NULL THEN place END) OVER (PARTITION BY cycle_key) AS INTEGER) AS reached, step, place,
  CASE WHEN ev IS NOT NULL THEN 'yes' WHEN step = 'commits' THEN 'unknown' ELSE 'no' END AS state, ev AS evidence FROM st)"""
DELIVERY_SQL = REFS_SQL + PULLS_SQL + ITEMS_SQL + STEPS_SQL


def _pulls(spark, d):
    return spark.sql(PULLS, events=bridge.events(spark, d))


def _items(spark, d):
    return spark.sql(ITEMS, customer=bridge.table(spark, d, "customer"))


def _cycles(spark, d, calls=None):
    """Cycles feed several joins of one query, so they are written once."""
    return cut(cycles.delivery_cycles(calls or _cycle_calls(spark, d)))


def _steps(spark, d, found=None):
    found = found or _cycles(spark, d)
    return cycles.cycle_steps(found, cycles.recorded_refs(_refs(spark, d)), cycles.pr_match(found, _pulls(spark, d)), cycles.work_item_match(found, _items(spark, d)))


def _kpis(spark, d):
    found = _cycles(spark, d)
    matches = cut(cycles.pr_match(found, _pulls(spark, d)))
    return _round(cycles.delivery_kpis(found, matches, _steps(spark, d, found)), "median_open_to_merge_hours", "median_lead_hours")


def _candidates(spark, d, found):
    """Owner candidates: the author of each cycle's matched pull request."""
    match = cycles.pr_match(found, _pulls(spark, d)).where(F.col("number").isNotNull())
    return match.select("cycle_key", actors.github_actor(F.col("author")).alias("actor"), F.lit("author").alias("role"), (F.col("author_kind") == "Bot").alias("is_bot"))


def _attributed(spark, d, calls=None):
    """Attribution of calls is the costly part and both sides need it, so the calls are written once."""
    calls = calls or cut(_cycle_calls(spark, d))
    owners = actors.cycle_owners(_candidates(spark, d, _cycles(spark, d, calls)))
    return actors.attributed_usage(cycles.keyed_calls(calls), owners)


def _work(spark, d):
    calls = cut(_cycle_calls(spark, d))
    return actors.work_balance(_attributed(spark, d, calls), cycles.shown_cycles(_cycles(spark, d, calls), 10))


BALANCE_SQL = REFS_SQL + PULLS_SQL + """,
ow AS (SELECT cycle_key, 'github:' || m.author AS owner FROM prm WHERE m.number IS NOT NULL AND NOT m.is_bot),
au AS (SELECT source, ck.cycle_key, owner, coalesce('github:' || usr, owner) AS actor, CASE WHEN usr IS NOT NULL THEN 'measured' WHEN owner IS NOT NULL THEN 'inferred' ELSE 'unattributed' END AS method, nano
  FROM ck LEFT JOIN ow ON ow.cycle_key = ck.cycle_key)"""
SUMS = "count(*) AS calls, count(nano) AS credit_calls, CAST(sum(nano) AS DOUBLE) / 1e9 AS credits"

ASSIGNMENTS = "SELECT uid % 40 AS item, eid AS seq, CASE WHEN k % 3 < 2 THEN 'Assigned' ELSE 'Unassigned' END AS kind, concat('U', k % 12) AS assignee, ms AS at_ms FROM {events}"


def _assignment(spark, d):
    ev = bridge.events(spark, d)
    activity = ev.selectExpr("uid % 40 AS item").distinct().selectExpr("item", f"{bridge.NOW_MS} - 86400000L * (item + 1) AS first_ms", "item % 7 <> 0 AS complete")
    return actors.assignment_asof(spark.sql(ASSIGNMENTS, events=ev), activity)


# Boards identities: one per assignee and organisation, linked to a login for two in three.
BOARDS_KEY = "concat('boards:org', k % 2, '/', lpad(string(k % 12), 36, '0'))"


def _linked(spark, d):
    ev = bridge.events(spark, d)
    people = ev.selectExpr("eid", f"CASE WHEN k % 5 = 0 THEN concat('github:u', k % 12) ELSE {BOARDS_KEY} END AS actor")
    links = ev.where("k % 3 > 0").selectExpr(f"{BOARDS_KEY} AS boards_key", "concat('U', k % 12) AS github_login").distinct()
    return actors.identity_link(people, links).groupBy("actor").agg(F.count(F.lit(1)).alias("rows"))


# ---- billing ----------------------------------------------------------------------------------

LINE = """
SELECT report_id, 'organization' AS level, 'acme' AS account, usr AS user, day, to_json(named_struct(
    'timePeriod', named_struct('year', int(substring(day, 1, 4)), 'month', int(substring(day, 6, 2)), 'day', int(substring(day, 9, 2))),
    'organization', 'acme', 'user', usr, 'product', 'Copilot', 'usageItems', collect_list(named_struct(
      'product', 'Copilot', 'sku', 'credits', 'model', upper(model), 'unitType', CASE WHEN int(substring(day, 9, 2)) % 5 = 0 THEN 'premium requests' ELSE 'AI credits' END,
      'pricePerUnit', 0.01D, 'grossQuantity', q, 'grossAmount', q / 100, 'discountQuantity', 0D, 'discountAmount', 0D, 'netQuantity', q, 'netAmount', q * 0.0037D)))) AS body
FROM (SELECT concat(usr, '@', day) AS report_id, usr, day, model, double(sum(floor(val))) / CASE WHEN model IN ('m1', 'm4') THEN 4000 ELSE 50 END AS q FROM (
  SELECT concat('U', uid % 12) AS usr, string(date_from_unix_date(int(ms div 86400000))) AS day, concat('m', k % 6) AS model, val FROM {events}) GROUP BY ALL)
GROUP BY report_id, usr, day
"""


def _lines(spark, d):
    """Billing reports per user and day (at most six models each), one in five in an unsupported unit."""
    return billing_parse(spark.sql(LINE, events=bridge.events(spark, d)))


def _billed(spark, d):
    """Lines (at most six a report) and usage of traces at billing grain. Both serve several joins of one query, so they are written once.

    The source is chosen first: reports compare one, so nothing is computed for the other.
    """
    usage = actors.usage_by_day(cycles.keyed_calls(_cycle_calls(spark, d))).where(F.col("source") == "traces")
    return cut(_lines(spark, d)), cut(usage), "traces"


BILLING_SQL = """,
bq AS (SELECT report_id, actor, day, model, q AS gross, q * 0.0037 AS net FROM (
  SELECT 'U' || (uid % 12) || '@' || strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS report_id, 'github:u' || (uid % 12) AS actor, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS day,
    'm' || (k % 6) AS model, CAST(sum(floor(val)) AS DOUBLE) / CASE WHEN 'm' || (k % 6) IN ('m1', 'm4') THEN 4000 ELSE 50 END AS q FROM ev GROUP BY 1, 2, 3, k % 6)),
okl AS (SELECT * FROM bq WHERE CAST(substring(day, 9, 2) AS INTEGER) % 5 <> 0),
ud AS (SELECT 'github:' || usr AS actor, day, model, cycle_key, CAST(sum(nano) AS DOUBLE) / 1e9 AS credits, count(*) AS calls FROM ck WHERE source = 'traces' GROUP BY 1, 2, 3, 4),
ob AS (SELECT actor, day, model, sum(credits) AS observed, sum(calls) AS calls FROM ud WHERE actor IS NOT NULL GROUP BY 1, 2, 3),
mm AS (SELECT o.*, observed, calls FROM okl o LEFT JOIN ob USING (actor, day, model)),
al AS (SELECT mm.report_id, mm.actor, mm.day, u.cycle_key, sum(u.credits) AS gross_quantity, sum(net * u.credits / gross) AS net_amount FROM mm JOIN ud u
  ON u.actor = mm.actor AND u.day = mm.day AND u.model = mm.model WHERE observed <= gross AND gross > 0 AND u.cycle_key IS NOT NULL AND u.credits > 0 GROUP BY 1, 2, 3, 4)"""
MONEY = ("gross", "observed", "difference", "unmatched_billing", "outside_model_scope", "unknown_identity")


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _story(spark, d):
    """Steps dated by place, one cycle in three with a late review, and each cycle's billing share."""
    steps = _steps(spark, d).withColumn("at_ms", F.col("place") * 1000 - F.when(F.col("step") == "review", F.length("cycle_key") % 3 * 1500).otherwise(0))
    shares = billing.billing_allocate(*_billed(spark, d))
    facts = shares.groupBy("cycle_key").agg(F.max("day").alias("day"), F.sum("gross_quantity").alias("gross_quantity"), F.sum("net_amount").alias("net_amount")).selectExpr(
        "cycle_key", "day", f"{bridge.NOW_MS} AS retrieved_ms", "gross_quantity", "gross_quantity * 2 AS billed_quantity", "net_amount", "net_amount * 2 AS charge")
    return cycles.cycle_story_check(steps, facts)


# Concepts: every (event type, number) pair seen, each on five surfaces.
def _concepts(spark, d):
    ev = bridge.events(spark, d)
    cells = ev.selectExpr("concat(et, k % 20) AS concept", "concat('surface', uid % 5) AS surface",
                          "CASE WHEN (k + uid) % 17 = 0 THEN 'missing' WHEN k % 20 < 5 THEN 'native' WHEN k % 2 = 0 THEN 'partial' ELSE 'derived' END AS availability")
    return coverage.concept_intersection(cells, cells.select("surface"))


def _older_store(spark, d):
    """A store of an older version: no creation times, no credits column, no references table."""
    tables = _store(spark, d)
    events = tables["assistant_usage_events"].drop("created_at", "total_nano_aiu", "cache_read_tokens")
    usage = stores.usage_context({"assistant_usage_events": events, "sessions": tables["sessions"]}, STORE_CUTOFF)
    return coverage.coverage_metrics(coverage.store_calls(usage), False, False)


def _store_states(spark, d):
    """The same store whole, of an older version, without the column that names sessions, and absent."""
    whole = _store(spark, d)
    events = whole["assistant_usage_events"]
    stores_ = {
        "whole": whole, "older": {"assistant_usage_events": events.drop("created_at", "total_nano_aiu"), "sessions": whole["sessions"]},
        "unnamed": whole | {"assistant_usage_events": events.drop("session_id")}, "absent": {},
    }
    reports = [stores.session_store_report(spark, t, STORE_CUTOFF).select(F.lit(n).alias("store"), "*") for n, t in stores_.items()]
    return reduce(DataFrame.unionByName, reports).withColumn("notes", F.concat_ws("; ", "notes"))


QUERIES = {
    "session_store_scan": _older_store,
    "session_store_status": _store_states,
    "session_store_window": lambda spark, d: _dated(spark, d).where(
        parsing.in_rolling_window(F.col("at_ms"), F.col("date_only"), WINDOW_CUTOFF)).select("id", "created_at"),
    "parse_timestamp": lambda spark, d: _dated(spark, d).select(
        "id", F.col("at_ms").alias("ms"), "date_only", parsing.usage_day(F.col("at_ms"), F.col("date_only")).alias("day")),
    "reported_credits": lambda spark, d: spark.sql(STORE_EVENTS, orders=bridge.table(spark, d, "orders")).select(
        "id", stores.reported_nano(F.col("total_nano_aiu")).alias("nano")),
    "usage_context_join": lambda spark, d: _usage(spark, d).groupBy("repository", "branch", "has_work_ref", "has_pr").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("nano").alias("nano"), F.sum("input").alias("input")),
    "coverage_funnel": lambda spark, d: coverage.coverage_funnel(coverage.store_calls(_usage(spark, d)), True),
    "coverage_funnel_traces": lambda spark, d: coverage.coverage_funnel(_traces(spark, d), False),
    "coverage_metrics": lambda spark, d: coverage.coverage_metrics(coverage.store_calls(_usage(spark, d)), True, False),
    "coverage_metrics_traces": lambda spark, d: coverage.coverage_metrics(_traces(spark, d), False, True),
    "coverage_breakdowns": lambda spark, d: coverage.coverage_breakdowns(_traces(spark, d), TRACE_KINDS),
    "daily_usage": lambda spark, d: coverage.daily_usage(coverage.store_calls(_usage(spark, d))),
    "source_freshness": lambda spark, d: coverage.source_freshness(coverage.store_calls(_usage(spark, d))),
    "concept_intersection": _concepts,
    "delivery_cycles": _cycles,
    "cycle_sources": lambda spark, d: cycles.cycle_sources(_cycle_calls(spark, d)).select("cycle_key", "source", "calls", "credit_calls", "credits"),
    "shown_cycles": lambda spark, d: cycles.shown_cycles(_cycles(spark, d)).select("cycle_key", "last_ms"),
    "truncated_cycles": lambda spark, d: cycles.truncated_cycles(_cycles(spark, d)),
    "unlinked_calls": lambda spark, d: cycles.unlinked_calls(_cycle_calls(spark, d)),
    "parse_refs": lambda spark, d: cycles.recorded_refs(_refs(spark, d)),
    "dropped_refs": lambda spark, d: cycles.dropped_refs(_refs(spark, d)),
    "pr_match": lambda spark, d: cycles.pr_match(_cycles(spark, d), _pulls(spark, d)).select("cycle_key", "candidates", "number", "merged_ms"),
    "work_item_match": lambda spark, d: cycles.work_item_match(_cycles(spark, d), _items(spark, d)),
    "cycle_steps": _steps,
    "step_stations": lambda spark, d: cycles.step_stations(_steps(spark, d)),
    "convention_adherence": lambda spark, d: cycles.convention_adherence(_cycles(spark, d)),
    "adherence_credits": lambda spark, d: _round(cycles.adherence_credits(cycles.cycle_sources(_cycle_calls(spark, d))), "credits"),
    "delivery_kpis": _kpis,
    "credits_per_merged_pr": lambda spark, d: _round(cycles.credits_per_merged_pr(
        cycles.cycle_sources(_cycle_calls(spark, d)), cycles.pr_match(_cycles(spark, d), _pulls(spark, d))), "credits", "credits_per_pr"),
    "assignment_asof": _assignment,
    "identity_link": _linked,
    "developer_balance": lambda spark, d: actors.developer_balance(_attributed(spark, d)),
    "actor_usage": lambda spark, d: actors.actor_usage(_attributed(spark, d)),
    "owned_work": lambda spark, d: actors.owned_work(_attributed(spark, d)),
    "work_balance": _work,
    "billing_parse": lambda spark, d: _lines(spark, d).groupBy("status").agg(
        F.count_distinct("report_id").alias("reports"), F.count("model").alias("lines"), F.round(F.sum("gross_quantity").cast("double"), 6).alias("gross")),
    "billing_match": lambda spark, d: _round(billing.model_match(*_billed(spark, d)), "gross", "net", "observed"),
    "billing_reconcile": lambda spark, d: _round(billing.billing_reconcile(*_billed(spark, d)), *MONEY),
    "billing_allocate": lambda spark, d: _round(billing.billing_allocate(*_billed(spark, d)), "gross_quantity", "net_amount", digits=9).drop("method"),
    "unallocated_net": lambda spark, d: _round(billing.unallocated_net(*_billed(spark, d)), "net", "allocated", "unallocated", digits=9),
    "cycle_story_check": _story,
}

ORACLES = {
    "session_store_scan": """
SELECT count(*) AS calls, 0 AS credited_calls, CAST(NULL AS DOUBLE) AS credits, 0.0::DOUBLE AS credit_coverage, CAST(NULL AS DOUBLE) AS credits_to_repo_share,
  CAST(NULL AS DOUBLE) AS credits_to_pr_share, CAST(NULL AS DOUBLE) AS credits_to_actor_share, CAST(NULL AS DOUBLE) AS sub_agent_share, CAST(NULL AS DOUBLE) AS cache_read_ratio, 0 AS cache_pairs FROM orders""",
    "session_store_status": with_store("""
SELECT 'whole' AS store, 'ok' AS status, 'No user identity is stored per session' AS notes, count(*) AS calls, count(at_ms) AS dated_calls, count(nano) AS credited_calls,
  count(*) FILTER (has_work_ref) AS linked_calls FROM us
UNION ALL SELECT 'older', 'ok', 'No user identity is stored per session; created_at is missing, so the window cannot be applied; session_refs is missing or lacks session_id / ref_type',
  count(*), 0, 0, NULL FROM orders
UNION ALL SELECT 'unnamed', 'schema', 'assistant_usage_events is missing or lacks session_id', NULL, NULL, NULL, NULL
UNION ALL SELECT 'absent', 'missing', 'the session store was not found', NULL, NULL, NULL, NULL"""),
    "session_store_window": with_store(f"""
SELECT ok AS id, CASE ok % 6 WHEN 0 THEN d || 'T' || c || '.000Z' WHEN 1 THEN d || ' ' || c WHEN 2 THEN d || 'T' || c || '+02:00' WHEN 3 THEN d WHEN 4 THEN 'garbage' ELSE d || 'T' || c || '-05:00' END AS created_at
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(make_timestamp(clk * 1000), '%H:%M:%S') AS c FROM o1)
WHERE at_ms >= {WINDOW_CUTOFF} OR (ok % 6 = 3 AND dms > {WINDOW_CUTOFF // 86_400_000 * 86_400_000})"""),
    "parse_timestamp": with_store("""
SELECT ok AS id, at_ms AS ms, CASE WHEN ok % 6 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_only,
  strftime(CASE WHEN ok % 6 = 3 THEN o_orderdate ELSE make_timestamp(at_ms * 1000) END, '%Y-%m-%d') AS day FROM o1"""),
    "reported_credits": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 > 2 THEN CAST(floor(o_totalprice * 1000) AS BIGINT) END AS nano FROM orders",
    "usage_context_join": with_store(" SELECT repository, branch, has_work_ref, has_pr, count(*) AS calls, CAST(sum(nano) AS BIGINT) AS nano, CAST(sum(input) AS BIGINT) AS input FROM us GROUP BY 1, 2, 3, 4"),
    "coverage_funnel": with_store(STORE_CALLS_SQL + funnel_sql("sc", True)),
    "coverage_funnel_traces": with_calls(TRACES_SQL + funnel_sql("tc", False)),
    "coverage_metrics": with_store(STORE_CALLS_SQL + metrics_sql("sc", True, False)),
    "coverage_metrics_traces": with_calls(TRACES_SQL + metrics_sql("tc", False, True)),
    "coverage_breakdowns": with_calls(TRACES_SQL + breakdown_sql("tc", {k: f'"{c}"' for k, c in TRACE_KINDS.items()})),
    "daily_usage": with_store(f"{STORE_CALLS_SQL} SELECT day, count(*) AS calls, count(nano) AS credited_calls, CAST(sum(nano) AS DOUBLE) / 1e9 AS credits FROM sc GROUP BY 1"),
    "source_freshness": with_store(""" SELECT strftime(make_timestamp(min(at_ms) * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(min(at_ms) % 1000 AS VARCHAR), 3, '0') || 'Z' AS first,
  strftime(make_timestamp(max(at_ms) * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(max(at_ms) % 1000 AS VARCHAR), 3, '0') || 'Z' AS last FROM us"""),
    "concept_intersection": with_events("""
, cells AS (SELECT et || (k % 20) AS concept, uid % 5 AS surface, CASE WHEN (k + uid) % 17 = 0 THEN 'missing' WHEN k % 20 < 5 THEN 'native' WHEN k % 2 = 0 THEN 'partial' ELSE 'derived' END AS a FROM ev)
SELECT concept, CASE WHEN bool_and(a = 'native') THEN 'native' ELSE 'partial' END AS level FROM cells WHERE a <> 'missing' GROUP BY 1 HAVING count(DISTINCT surface) = 5"""),
    "delivery_cycles": with_cycles(" SELECT *, CASE provider WHEN 'github' THEN '#' || item_id WHEN 'azure-boards' THEN 'AB#' || item_id END AS reference FROM cy"),
    "cycle_sources": with_cycles(" SELECT cycle_key, source, calls, credit_calls, credits FROM src"),
    "shown_cycles": with_cycles(" SELECT cycle_key, last_ms FROM cy ORDER BY last_ms DESC, cycle_key LIMIT 200"),
    "truncated_cycles": with_cycles(" SELECT count(*) AS cycles, greatest(0, count(*) - 200) AS truncated FROM cy"),
    "unlinked_calls": with_cycles(" SELECT source, count(*) AS calls, CAST(sum(nano) AS DOUBLE) / 1e9 AS credits FROM ck WHERE repository IS NULL GROUP BY 1"),
    "parse_refs": with_store(REFS_SQL + " SELECT * FROM rec"),
    "dropped_refs": with_store(REFS_SQL + " SELECT count(*) FILTER (named IS NULL) AS dropped_refs FROM rr"),
    "pr_match": with_cycles(PULLS_SQL + " SELECT cycle_key, candidates, m.number AS number, m.merged_ms AS merged_ms FROM prm"),
    "work_item_match": with_cycles(ITEMS_SQL + " SELECT * FROM im"),
    "cycle_steps": with_cycles(DELIVERY_SQL + " SELECT * FROM sp"),
    "step_stations": with_cycles(DELIVERY_SQL + """
SELECT step, count(*) FILTER (state = 'yes') AS any, count(*) FILTER (place < coalesce(gap, 8)) AS strict, count(*) FILTER (state = 'unknown') AS unknown
FROM (SELECT *, min(CASE WHEN state <> 'yes' THEN place END) OVER (PARTITION BY cycle_key) AS gap FROM sp) GROUP BY 1"""),
    "convention_adherence": with_cycles("""
SELECT count(*) AS cycles, count(*) FILTER (provider = 'azure-boards') AS azure_boards, count(*) FILTER (provider = 'github') AS github,
  count(*) FILTER (branch IS NOT NULL AND provider IS NULL) AS non_conforming, count(*) FILTER (branch IS NULL) AS no_branch FROM cy"""),
    "adherence_credits": with_cycles("""
SELECT CASE WHEN cy.provider IS NOT NULL THEN 'conforming' ELSE 'nonConforming' END AS side, source, round(sum(credits), 6) AS credits, count(*) AS cycles
FROM src JOIN cy USING (cycle_key) GROUP BY 1, 2"""),
    "delivery_kpis": with_cycles(DELIVERY_SQL + """
SELECT count(*) FILTER (m.merged_ms IS NOT NULL) AS merged, (SELECT count(*) FROM sp WHERE step = 'close' AND state = 'yes') AS closed,
  round(quantile_cont(((m.merged_ms - m.created_ms) / 3600000.0)::DOUBLE, 0.5), 6) AS median_open_to_merge_hours,
  round(quantile_cont(((m.merged_ms - cy.first_ms) / 3600000.0)::DOUBLE, 0.5), 6) AS median_lead_hours FROM prm JOIN cy USING (cycle_key)"""),
    "credits_per_merged_pr": with_cycles(PULLS_SQL + """
SELECT source, count(*) AS merged, round(sum(credits), 6) AS credits, round(sum(credits) / count(*), 6) AS credits_per_pr
FROM src JOIN prm USING (cycle_key) WHERE m.merged_ms IS NOT NULL GROUP BY 1"""),
    "assignment_asof": with_events(f"""
, h AS (SELECT uid % 40 AS item, eid AS seq, k % 3 < 2 AS assigned, 'github:u' || (k % 12) AS assignee, ms FROM ev)
SELECT item, assignee FROM h WHERE item % 7 <> 0 AND ms <= {bridge.NOW_MS} - 86400000 * (item + 1) GROUP BY 1, 2 HAVING arg_max(assigned, (ms, seq))"""),
    "identity_link": with_events("""
, p AS (SELECT eid, k, 'org' || (k % 2) || '/' || (k % 12) AS bk FROM ev), l AS (SELECT DISTINCT bk, 'github:u' || (k % 12) AS actor FROM p WHERE k % 3 > 0)
SELECT CASE WHEN k % 5 = 0 THEN 'github:u' || (k % 12) WHEN l.actor IS NOT NULL THEN l.actor ELSE 'boards:org' || (k % 2) || '/' || lpad(CAST(k % 12 AS VARCHAR), 36, '0') END AS actor, count(*) AS rows
FROM p LEFT JOIN l USING (bk) GROUP BY 1"""),
    "developer_balance": with_cycles(BALANCE_SQL + f" SELECT source, method, {SUMS} FROM au GROUP BY 1, 2"),
    "actor_usage": with_cycles(BALANCE_SQL + f" SELECT source, actor, method, {SUMS} FROM au WHERE actor IS NOT NULL GROUP BY 1, 2, 3"),
    "owned_work": with_cycles(BALANCE_SQL + f" SELECT source, owner, {SUMS} FROM au WHERE owner IS NOT NULL GROUP BY 1, 2"),
    "work_balance": with_cycles(BALANCE_SQL + f""",
top AS (SELECT cycle_key, TRUE AS listed FROM cy ORDER BY last_ms DESC, cycle_key LIMIT 10)
SELECT source, CASE WHEN listed THEN au.cycle_key END AS cycle_key, {SUMS} FROM au LEFT JOIN top USING (cycle_key) GROUP BY 1, 2"""),
    "billing_parse": with_cycles(BILLING_SQL + """
SELECT CASE WHEN CAST(substring(day, 9, 2) AS INTEGER) % 5 = 0 THEN 'error' ELSE 'ok' END AS status, count(DISTINCT report_id) AS reports,
  count(*) FILTER (CAST(substring(day, 9, 2) AS INTEGER) % 5 <> 0) AS lines, round(sum(gross) FILTER (CAST(substring(day, 9, 2) AS INTEGER) % 5 <> 0), 6) AS gross FROM bq GROUP BY 1"""),
    "billing_match": with_cycles(BILLING_SQL + " SELECT report_id, actor, day, model, round(gross, 6) AS gross, round(net, 6) AS net, round(observed, 6) AS observed, CAST(calls AS BIGINT) AS calls FROM mm"),
    "billing_reconcile": with_cycles(BILLING_SQL + """
, cmpd AS (SELECT report_id, actor, day, sum(gross) AS gross, sum(observed) AS observed, sum(greatest(0, gross - coalesce(observed, 0))) AS um, bool_or(coalesce(observed > gross, FALSE)) AS ex FROM mm GROUP BY 1, 2, 3),
oms AS (SELECT r.report_id, sum(observed) AS om FROM ob JOIN (SELECT DISTINCT report_id, actor, day FROM okl) r USING (actor, day) WHERE NOT EXISTS (SELECT 1 FROM okl WHERE okl.report_id = r.report_id AND okl.model = ob.model) GROUP BY 1),
unk AS (SELECT day, sum(credits) AS ui FROM ud WHERE actor IS NULL GROUP BY 1)
SELECT c.report_id, c.actor, c.day, round(gross, 6) AS gross, round(observed, 6) AS observed, round(gross - observed, 6) AS difference, round(um, 6) AS unmatched_billing,
  round(coalesce(om, 0.0), 6) AS outside_model_scope, round(coalesce(ui, 0.0), 6) AS unknown_identity, ex AS local_exceeds_billing
FROM cmpd c LEFT JOIN oms USING (report_id) LEFT JOIN unk USING (day)"""),
    "billing_allocate": with_cycles(BILLING_SQL + " SELECT report_id, actor, day, cycle_key, round(gross_quantity, 9) AS gross_quantity, round(net_amount, 9) AS net_amount FROM al"),
    "unallocated_net": with_cycles(BILLING_SQL + """
SELECT t.report_id, t.actor, t.day, round(t.net, 9) AS net, round(coalesce(a, 0.0), 9) AS allocated, round(t.net - coalesce(a, 0.0), 9) AS unallocated
FROM (SELECT report_id, actor, day, sum(net) AS net FROM okl GROUP BY 1, 2, 3) t LEFT JOIN (SELECT report_id, sum(net_amount) AS a FROM al GROUP BY 1) USING (report_id)"""),
    "cycle_story_check": with_cycles(DELIVERY_SQL + BILLING_SQL + """
, sa AS (SELECT *, place * 1000 - CASE WHEN step = 'review' THEN length(cycle_key) % 3 * 1500 ELSE 0 END AS at_ms FROM sp),
od AS (SELECT *, lag(at_ms) OVER (PARTITION BY cycle_key ORDER BY place) AS prev FROM sa)
SELECT DISTINCT cycle_key, CASE WHEN state <> 'yes' THEN 'step not done' WHEN prev > at_ms THEN 'step precedes the one before' END AS rule FROM od WHERE state <> 'yes' OR prev > at_ms"""),
}
