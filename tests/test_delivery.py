import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spanledger.operators import actors, billing, context, coverage, cycles, quality
from spanledger.sources import billing as billing_source
from spanledger.sources import quota, stores

NANO = 1_000_000_000
DAY = 86_400_000
NOW = 1_790_769_600_000  # 2026-09-30T12:00:00Z
CALL = "source STRING, repository STRING, branch STRING, user STRING, session STRING, model STRING, nano BIGINT, at_ms BIGINT, day STRING"


def calls(spark, *given):
    data = [(g.get("source", "traces"), g.get("repository"), g.get("branch"), g.get("user"), g.get("session"), g.get("model"),
             None if g["credits"] is None else int(g["credits"] * NANO), g.get("at", 100), g.get("day", "2026-10-20")) for g in given]
    return spark.createDataFrame(data, CALL)


def _store(spark):
    events = spark.createDataFrame([
        ("with-pr", None, "m1", 1000, 10, 800, str(6 * NANO), "user", "high", "2026-09-29T10:00:00.000Z"),
        ("with-pr", "sub-1", "m2", 500, 5, 0, str(1 * NANO), "sub-agent", "low", "2026-09-29T11:00:00.000Z"),
        ("repo-only", None, "m1", 200, 2, 100, str(2 * NANO), "agent", "high", "2026-09-28T10:00:00.000Z"),
        ("no-repo", None, "m1", 300, 3, 0, None, "agent", None, "2026-09-28T12:00:00.000Z"),
        ("no-repo", None, "m1", 999, 9, 0, str(9 * NANO), "agent", None, "2026-08-01T12:00:00.000Z")],
        "session_id STRING, agent_id STRING, model STRING, input_tokens INT, output_tokens INT, cache_read_tokens INT, total_nano_aiu STRING, initiator STRING, reasoning_effort STRING, created_at STRING")
    sessions = spark.createDataFrame([("with-pr", "https://github.com/o/a.git", "feature"), ("repo-only", "o/b", None), ("no-repo", None, None)], "id STRING, repository STRING, branch STRING")
    refs = spark.createDataFrame([("with-pr", "pr", "42"), ("with-pr", "commit", "abc")], "session_id STRING, ref_type STRING, ref_value STRING")
    return {"assistant_usage_events": events, "sessions": sessions, "session_refs": refs}


def test_credit_weighted_funnel(spark):
    found = coverage.store_calls(stores.usage_context(_store(spark), NOW - 30 * DAY))
    stage = {r.stage: r for r in coverage.coverage_funnel(found, True).collect()}
    assert [stage[s].credits for s in coverage.STAGES] == [9, 9, 9, 7, 7, 7]
    assert (stage["observed"].calls, stage["repository"].sessions, stage["pullRequest"].sessions) == (4, 2, 1)
    m = coverage.coverage_metrics(found, True, False).first()
    assert (m.credited_calls, m.credit_coverage, m.credits_to_repo_share, m.credits_to_actor_share) == (3, 0.75, 1.0, None)
    assert (m.credits_to_pr_share, m.sub_agent_share, m.cache_read_ratio) == pytest.approx((7 / 9, 1 / 9, 900 / 2000))
    keys = coverage.coverage_breakdowns(found, {"repository": "repository"}).orderBy(F.desc("credits"), "key")
    assert [r.key for r in keys.collect()] == ["o/a", "o/b", "(none)"]
    assert [r.day for r in coverage.daily_usage(found).orderBy("day").collect()] == ["2026-09-28", "2026-09-29"]


def test_missing_columns_and_tables(spark):
    events = spark.createDataFrame([("s", "m")], "session_id STRING, model STRING")
    found = coverage.store_calls(stores.usage_context({"assistant_usage_events": events}, NOW))
    m = coverage.coverage_metrics(found, False, False).first()
    assert (m.calls, m.credited_calls, m.credits_to_pr_share, m.credits_to_repo_share) == (1, 0, None, None)
    status, notes = stores.store_status({"assistant_usage_events": events})
    assert status == "ok" and any("created_at is missing" in n for n in notes) and any("session_refs is missing" in n for n in notes)
    assert stores.store_status({"other": events})[0] == "schema" and stores.store_status({})[0] == "missing"
    told = stores.session_store_report(spark, {"assistant_usage_events": events}, None).first()
    assert told.status == "ok" and told.calls == events.count() and told.linked_calls is None
    gone = stores.session_store_report(spark, {}, None).first()
    assert (gone.status, gone.calls) == ("missing", None)


def test_exact_rolling_cutoff(spark):
    data = [(1e9, "2026-09-23T06:00:00.000Z"), (2e9, "2026-09-23 18:00:00"), (4e9, "2026-09-23"), (8e9, "2026-09-24"), (16e9, "garbage"),
            (32e9, "2026-09-22T23:30:00-14:00"), ("abc", "2026-09-25T00:00:00Z"), (-5e9, "2026-09-25T00:00:00Z")]
    events = spark.createDataFrame([("s", "m", str(n), t) for n, t in data], "session_id STRING, model STRING, total_nano_aiu STRING, created_at STRING")
    sessions = spark.createDataFrame([("s", "o/r", "main")], "id STRING, repository STRING, branch STRING")
    refs = spark.createDataFrame([(1, "x")], "id INT, value STRING")
    found = coverage.store_calls(stores.usage_context({"assistant_usage_events": events, "sessions": sessions, "session_refs": refs}, NOW - 7 * DAY))
    m = coverage.coverage_metrics(found, False, False).first()
    assert (m.calls, m.credited_calls, m.credits, m.credits_to_pr_share) == (5, 3, 42.0, None)
    assert [r.day for r in coverage.daily_usage(found).orderBy("day").collect()] == ["2026-09-23", "2026-09-24", "2026-09-25"]
    assert tuple(coverage.source_freshness(found).first()) == ("2026-09-23T13:30:00.000Z", "2026-09-25T00:00:00.000Z")


def test_trace_funnel_and_links(spark, make_spans):
    agent = {"operation": "invoke_agent", "start_ms": 10, "user_source": "span"}
    spans = make_spans(
        {"span_id": "agent", **agent, "trace_id": "t1", "native_session_id": "chat-1", "conversation_id": "conv-1", "repository": "o/r", "branch": "main", "user_name": "octocat"},
        {"span_id": "agent-id", **agent, "trace_id": "t3", "user_name": "hubot"},
        {"span_id": "c1", "trace_id": "t1", "start_ms": 20, "conversation_id": "conv-1", "native_session_id": "chat-1", "nano": 3 * NANO},
        {"span_id": "sub", "trace_id": "t2", "start_ms": 30, "parent_session_id": "chat-1", "nano": NANO},
        {"span_id": "aux", "trace_id": "t3", "start_ms": 40, "nano": 0}, {"span_id": "plain", "trace_id": "t4", "start_ms": 50},
        {"span_id": "t1", "operation": "execute_tool", "tool": "read_file", "failed": False}, {"span_id": "t2", "operation": "execute_tool", "tool": "read_file"},
        {"span_id": "t3", "operation": "execute_tool", "tool": "read_file", "failed": True})
    found = coverage.trace_calls(context.attributed_calls(spans))
    stage = {r.stage: r for r in coverage.coverage_funnel(found, False).collect()}
    assert (stage["session"].calls, stage["observed"].sessions, stage["repository"].credits, stage["pullRequest"].emitted) == (4, 1, 4.0, False)
    m = coverage.coverage_metrics(found, False, True).first()
    assert (m.credit_coverage, m.credits_to_repo_share, m.credits_to_pr_share, m.credits_to_actor_share) == (0.75, 1.0, None, 1.0)
    got = coverage.coverage_breakdowns(found, {"link": "link", "user": "user"})
    assert rows(got.where("kind = 'link'"), "key", "calls") == [("chat session", 1), ("none", 2), ("parent session", 1)]
    assert rows(got.where("kind = 'user'"), "key", "calls", "credits") == [("(none)", 1, 0.0), ("hubot", 1, 0.0), ("octocat", 2, 4.0)]
    assert rows(quality.tool_breakdown(spans), "tool", "calls", "status_calls", "failed") == [("read_file", 3, 2, 1)]


def test_concepts_on_every_surface(spark):
    cells = spark.createDataFrame([
        ("derived", "one", "native"), ("derived", "two", "derived"), ("missing", "one", "native"), ("unverified", "one", "native"), ("unverified", "two", "unverified"),
        ("all", "one", "native"), ("all", "two", "native")], "concept STRING, surface STRING, availability STRING")
    surfaces = spark.createDataFrame([("one",), ("two",)], "surface STRING")
    assert rows(coverage.concept_intersection(cells, surfaces), "concept", "level") == [("all", "native"), ("derived", "partial")]
    assert coverage.concept_intersection(cells, surfaces.limit(0)).count() == 0


@pytest.fixture()
def balance(spark):
    def call(branch, user, credits, source="traces"):
        return dict(source=source, repository="acme/widgets" if branch else None, branch=branch, user=user, credits=credits)
    used = calls(spark, call("dev/1-feature", "alex", 260000), call("dev/1-feature", "blair", 150000), call("dev/2-feature", None, 100000), call(None, "alex", 40000),
                 call("spike", None, 50000), call("dev/1-feature", None, 200000, "sessionStore"), call("dev/1-feature", "casey", None))
    owners = spark.createDataFrame([(f"acme/widgets#dev/{i}-feature", "github:alex", "author", False) for i in (1, 2)], "cycle_key STRING, actor STRING, role STRING, is_bot BOOLEAN")
    return actors.attributed_usage(cycles.keyed_calls(used), actors.cycle_owners(owners))


def test_developer_balance_conserves_credits(balance):
    by = {(r.source, r.method): r.credits for r in actors.developer_balance(balance).collect()}
    assert (by["traces", "measured"], by["traces", "inferred"], by["traces", "unattributed"], by["sessionStore", "inferred"]) == (450000, 100000, 50000, 200000)
    used = {(r.actor, r.method): r.credits for r in actors.actor_usage(balance).where("source = 'traces'").collect()}
    assert (used["github:alex", "measured"], used["github:alex", "inferred"], used["github:blair", "measured"]) == (300000, 100000, 150000)
    assert used["github:casey", "measured"] is None
    owned = {(r.source, r.owner): r.credits for r in actors.owned_work(balance).collect()}
    assert owned["traces", "github:alex"] == 510000


def test_cycles_beyond_the_list_stay_in_the_balance(spark):
    used = calls(spark, *[dict(repository="a/w", branch=f"dev/{i + 1}-x", user="alex", credits=1, at=1000 - i) for i in range(202)])
    found = cycles.delivery_cycles(used)
    assert cycles.truncated_cycles(found).first().truncated == 2
    usage = actors.attributed_usage(cycles.keyed_calls(used), spark.createDataFrame([], "cycle_key STRING, owner STRING"))
    work = {r.cycle_key: r.credits for r in actors.work_balance(usage, cycles.shown_cycles(found)).collect()}
    assert len(work) == 201 and work[None] == 2 and sum(work.values()) == 202


def test_owners_conflict_and_bots_do_not_count(spark):
    schema = "cycle_key STRING, actor STRING, role STRING, is_bot BOOLEAN"
    board = "boards:acme/aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"
    people = spark.createDataFrame([
        ("a", board, "assignee at start", False), ("a", "github:alex", "author", False), ("b", "github:helper", "author", True), ("c", "github:alex", "assigned now", False)], schema)
    got = {r.cycle_key: (r.owner, r.inference) for r in actors.cycle_owners(people).collect()}
    assert got == {"a": (None, "Conflicting owners")}
    links = spark.createDataFrame([(board, "Alex")], "boards_key STRING, github_login STRING")
    assert actors.cycle_owners(actors.identity_link(people, links)).first().owner == "github:alex"
    twice = links.unionByName(links).unionByName(spark.createDataFrame([("alex", "alex")], links.schema))
    assert rows(actors.identity_link_errors(twice), "boards_key", "problem") == [("alex", "malformed"), (board, "not unique")]


def test_assignment_is_never_backdated(spark):
    history = spark.createDataFrame([(1, 0, "Assigned", "Alex", 10), (1, 1, "Unassigned", "alex", 80), (1, 2, "Assigned", "blair", 80)], "item INT, seq INT, kind STRING, assignee STRING, at_ms BIGINT")
    activity = spark.createDataFrame([(1, 50, True)], "item INT, first_ms BIGINT, complete BOOLEAN")
    assert rows(actors.assignment_asof(history, activity), "assignee") == [("github:alex",)]
    assert actors.assignment_asof(history, activity.withColumn("complete", F.lit(False))).count() == 0


def _cycle_fixture(spark):
    def call(source, repo, branch, credits, at, user=None):
        return dict(source=source, repository=repo, branch=branch, credits=credits, at=NOW - at * DAY, user=user)
    used = calls(
        spark, call("sessionStore", "octo/web", "alex/AB123-checkout", 4, 7), call("sessionStore", "octo/web", "alex/AB123-checkout", 2, 6), call("sessionStore", "octo/api", "alex/45-token", 3, 10),
        call("sessionStore", "octo/web", "spike", 1, 3), call("sessionStore", None, None, 1, 2), call("traces", "octo/web", "alex/AB123-checkout", 5, 8, "alex"), call("traces", "octo/web", "alex/AB123-checkout", 1, 6, "blair"))
    web, api = ("octo/web", "alex/AB123-checkout"), ("octo/api", "alex/45-token")
    refs = spark.createDataFrame([(*web, "pr", "128", 1), (*web, "commit", "A1B2C3D", 1), (*web, "issue", "other/repo#9", 1), (*web, "issue", "SECRET TEXT", 1), (*api, "issue", "45", 1)],
                                 "repository STRING, branch STRING, ref_type STRING, ref_value STRING, at_ms BIGINT")
    return used, refs


def test_cycles_without_verification(spark):
    used, refs = _cycle_fixture(spark)
    found = cycles.delivery_cycles(used)
    assert rows(found, "cycle_key", "reference") == [("octo/api#alex/45-token", "#45"), ("octo/web#alex/AB123-checkout", "AB#123"), ("octo/web#spike", None)]
    web = cycles.cycle_sources(used).where("branch = 'alex/AB123-checkout'")
    assert rows(web, "source", "credits") == [("sessionStore", 6.0), ("traces", 6.0)]
    assert rows(cycles.unlinked_calls(used), "source", "calls") == [("sessionStore", 1)]
    held = cycles.recorded_refs(refs)
    assert rows(held, "kind", "named") == [("commit", "a1b2c3d"), ("issue", "45"), ("pr", "128")]
    assert cycles.dropped_refs(refs).first()[0] == 2
    steps = cycles.cycle_steps(found, held)
    state = {(r.cycle_key.split("#")[1], r.step): (r.state, r.evidence) for r in steps.collect()}
    web = "alex/AB123-checkout"
    assert [state[web, s] for s in ("workItem", "commits", "pullRequest", "review", "close")] == [
        ("yes", "convention"), ("yes", "recorded"), ("yes", "recorded"), ("unknown", None), ("unknown", None)]
    assert steps.where(F.col("cycle_key").endswith("checkout")).first().reached == 5
    assert state["spike", "workItem"] == ("no", None) and state["spike", "commits"] == ("unknown", None)
    assert tuple(cycles.convention_adherence(found).first()) == (3, 1, 1, 1, 0)
    sides = rows(cycles.adherence_credits(cycles.cycle_sources(used)), "side", "source", "credits", "cycles")
    assert sides == [("conforming", "sessionStore", 9.0, 2), ("conforming", "traces", 6.0, 1), ("nonConforming", "sessionStore", 1.0, 1)]
    station = {r.step: r for r in cycles.step_stations(steps).collect()}
    assert (station["workItem"].any, station["workItem"].strict, station["review"].unknown) == (2, 2, 3)


def test_cycles_with_verification(spark):
    used, refs = _cycle_fixture(spark)
    found, held = cycles.delivery_cycles(used), cycles.recorded_refs(refs)

    def pr(repo, number, head, created, merged):
        at = lambda d: None if d is None else NOW - d * DAY
        return (repo, number, head, at(created), at(merged), at(merged), "alex", "User", 1 if merged else 0, 2)

    schema = "repository STRING, number BIGINT, head STRING, created_ms BIGINT, merged_ms BIGINT, closed_ms BIGINT, author STRING, author_kind STRING, reviews BIGINT, commits BIGINT"
    prs = spark.createDataFrame([pr("octo/web", 128, "alex/AB123-checkout", 5, 2), pr("octo/web", 3, "alex/AB123-checkout", 400, 399), pr("octo/api", 77, "alex/45-token", 5, None)], schema)
    items = spark.createDataFrame([("azure-boards", None, 123, "User Story", "Completed", None), ("github", "octo/api", 45, "Bug", "Open", None)],
                                  "provider STRING, repository STRING, id BIGINT, type STRING, category STRING, closed_ms BIGINT")
    matches = cycles.pr_match(found, prs)
    by = {r.cycle_key: r for r in matches.collect()}
    assert (by["octo/web#alex/AB123-checkout"].number, by["octo/web#alex/AB123-checkout"].candidates) == (128, 2)
    steps = cycles.cycle_steps(found, held, matches, cycles.work_item_match(found, items))
    state = {(r.cycle_key, r.step): r.state for r in steps.collect()}
    assert [state["octo/web#alex/AB123-checkout", s] for s in cycles.STEPS] == ["yes"] * 7
    assert (state["octo/api#alex/45-token", "review"], state["octo/api#alex/45-token", "close"], state["octo/web#spike", "pullRequest"]) == ("no", "no", "no")
    kpi = cycles.delivery_kpis(found, matches, steps).first()
    assert (kpi.merged, kpi.closed, kpi.median_open_to_merge_hours) == (1, 1, 72.0) and kpi.median_lead_hours > 0
    per = rows(cycles.credits_per_merged_pr(cycles.cycle_sources(used), matches), "source", "merged", "credits")
    assert per == [("sessionStore", 1, 6.0), ("traces", 1, 6.0)]
    elsewhere = prs.where("number = 128").withColumn("head", F.lit("someone/else"))
    mention = cycles.cycle_steps(found, held, cycles.pr_match(found, elsewhere))
    assert mention.where(F.col("cycle_key").endswith("checkout") & (F.col("step") == "pullRequest")).first().state == "no"


def _line(**extra):
    return {"product": "Copilot", "sku": "credits", "model": "model-a", "unitType": "AI credits", "pricePerUnit": 0.01, "grossQuantity": 100, "grossAmount": 1,
            "discountQuantity": 40, "discountAmount": 0.4, "netQuantity": 60, "netAmount": 0.6, **extra}


def _report(spark, items, **extra):
    body = {"timePeriod": {"year": 2026, "month": 10, "day": 20}, "organization": "acme", "user": "alex", "product": "Copilot", "usageItems": items, **extra}
    raw = spark.createDataFrame([("r", "organization", "acme", "alex", "2026-10-20", json.dumps(body))], "report_id STRING, level STRING, account STRING, user STRING, day STRING, body STRING")
    return billing_source.billing_parse(raw)


def test_billing_lines_are_checked(spark):
    good = _report(spark, [_line(private="x")]).first()
    assert (good.status, float(good.gross_quantity), float(good.discount_quantity), float(good.net_amount)) == ("ok", 100.0, 40.0, 0.6)
    bad = [dict(unitType="premium requests"), dict(grossQuantity="100"), dict(netAmount=None), dict(pricePerUnit=-1), dict(model=None), dict(product="Other")]
    for change in bad:
        assert [r.status for r in _report(spark, [_line(**change)]).collect()] == ["error"], change
    for change in (dict(user="blair"), dict(organization="other"), dict(timePeriod={"year": 2026, "month": 10})):
        assert _report(spark, [], **change).first().status == "error"
    assert [(r.status, r.model) for r in _report(spark, []).collect()] == [("ok", None)]
    scopes = spark.createDataFrame([("organization", "acme", "alex", "2026-10-20"), ("organization", "acme/../x", "alex", "2026-10-20"), ("organization", "acme", "alex&admin=true", "2026-10-20"),
                                    ("organization", "acme", "alex", "2026-02-30"), ("organization", "acme", "alex", "2026-10-22"), ("user", "acme", "alex", "2026-10-20"), ("other", "acme", "alex", "2026-10-20")],
                                   "level STRING, account STRING, user STRING, day STRING")
    assert [r.scope_ok for r in billing_source.billing_scope(scopes, "2026-10-22").collect()] == [True] + [False] * 6


def test_reconciliation_and_bounded_shares(spark):
    def used(credits, **extra):
        return {"repository": "acme/widgets", "branch": "alex/1-change", "user": "alex", "model": "model-a", "credits": credits, **extra}
    found = calls(spark, used(40), used(10, repository=None), used(15, user=None), used(99, user="blair"), used(900, day="2026-10-19"), used(25, model="unmatched-alias"),
                  used(300, source="sessionStore", repository=None))
    usage = actors.usage_by_day(cycles.keyed_calls(found))
    lines = _report(spark, [_line()])
    r = billing.billing_reconcile(lines, usage, "traces").first()
    assert (r.observed, r.difference, r.unmatched_billing, r.outside_model_scope, r.unknown_identity, r.local_exceeds_billing) == (50, 50, 50, 25, 15, False)
    share = billing.billing_allocate(lines, usage, "traces").collect()
    assert [(s.gross_quantity, round(s.net_amount, 9), s.method) for s in share] == [(40.0, 0.24, "estimated-share")]
    assert round(billing.unallocated_net(lines, usage, "traces").first().unallocated, 9) == 0.36
    other = billing.billing_reconcile(lines, usage, "sessionStore").first()
    assert (other.observed, other.local_exceeds_billing) == (300, True) and billing.billing_allocate(lines, usage, "sessionStore").count() == 0


def test_model_gaps_do_not_cancel(spark):
    lines = _report(spark, [_line(grossQuantity=10), _line(model="model-b", grossQuantity=10)])
    schema = "source STRING, actor STRING, day STRING, model STRING, cycle_key STRING, calls BIGINT, credit_calls BIGINT, credits DOUBLE"
    usage = spark.createDataFrame([("traces", "github:alex", "2026-10-20", m, "work", 1, 1, c) for m, c in (("model-a", 15.0), ("model-b", 5.0))], schema)
    r = billing.billing_reconcile(lines, usage, "traces").first()
    assert (r.difference, r.unmatched_billing, r.local_exceeds_billing) == (0, 5, True)
    assert billing.billing_allocate(lines, usage, "traces").first().gross_quantity == 5
    unknown = usage.withColumn("credits", F.lit(None).cast("double"))
    assert billing.billing_reconcile(lines, unknown, "traces").first().observed is None
    assert billing.billing_reconcile(lines, usage.withColumn("credits", F.lit(0.0)), "traces").first().observed == 0


def test_story_violations(spark):
    steps = spark.createDataFrame([("a", i + 1, "yes", t) for i, t in enumerate([10, 20, 15])] + [("b", 1, "unknown", 1)], "cycle_key STRING, place INT, state STRING, at_ms BIGINT")
    facts = spark.createDataFrame([("a", "2026-09-29", NOW, 5.7, 8.0, 0.0285, 0.04), ("b", "2026-09-30", NOW, 5.7, 8.0, 0.0285, 0.04), ("c", "2026-09-29", NOW, 5.7, 8.0, 0.06, 0.04)],
                                  "cycle_key STRING, day STRING, retrieved_ms BIGINT, gross_quantity DOUBLE, billed_quantity DOUBLE, net_amount DOUBLE, charge DOUBLE")
    got = rows(cycles.cycle_story_check(steps, facts), "cycle_key", "rule")
    assert got == [("a", "step precedes the one before"), ("b", "day not completed"), ("b", "step not done"), ("c", "estimate is not the calculated share")]


def test_quota_rules(spark):
    def parse(body):
        return quota.quota_parse(spark.createDataFrame([("me", 5, json.dumps(body))], "login STRING, fetched_ms BIGINT, body STRING")).first()

    base = {"unlimited": False, "entitlement": "1000", "percent_remaining": 75}
    got = parse({"copilot_plan": "pro", "quota_reset_date": "2026-10-01", "quota_snapshots": {"premium_interactions": base}})
    assert (got.status, got.used, got.approximate, got.unit, got.allowance, got.reset_ms) == ("ready", 250.0, True, "premium requests", 1000.0, 1790812800000)
    exact = parse({"token_based_billing": True, "quota_snapshots": {"premium_models": {**base, "quota_remaining": "900"}}})
    assert (exact.used, exact.approximate, exact.unit) == (100.0, False, "credits")
    chat = parse({"quota_snapshots": {"premium_interactions": {**base, "entitlement": 0}, "chat": {"unlimited": True, "credits_used": 7}}})
    assert (chat.unit, chat.unlimited, chat.credits_used, chat.used) == ("chat requests", True, 7.0, None)
    for bad in ({}, {"quota_snapshots": {"chat": {"unlimited": "no"}}}, {"quota_snapshots": {"chat": {"unlimited": False}}}, {"quota_reset_date": "soon", "quota_snapshots": {"chat": base}}):
        assert parse(bad).status == "error"


def test_trace_store_scan(spark):
    spans = spark.createDataFrame([("a", "chat", 100.0, 150.0, None), ("b", "chat", 100.0, 150.0, "x"), ("c", None, 100.0, 110.0, "x"), ("old", "chat", 1.0, 2.0, None)],
                                  "span_id STRING, operation_name STRING, start_time_ms DOUBLE, end_time_ms DOUBLE, parent_span_id STRING")
    attrs = spark.createDataFrame([
        ("a", "copilot_chat.copilot_usage_nano_aiu", "0"), ("a", "gen_ai.usage.cache_write.input_tokens", "7"), ("a", "copilot_chat.turn_count", "  "),
        ("a", "copilot_chat.repo.remote_url", "https://github.com/o/legacy.git"), ("a", "github.copilot.git.repository", "o/new"), ("a", "gen_ai.input.messages", "secret"),
        ("a", "copilot_chat.request.options", '{"reasoning":{"effort":"HIGH"}}'), ("a", "user.name", " mona ")], "span_id STRING, key STRING, value STRING")
    got = {r.span_id: r for r in stores.span_store_scan(spans, attrs, 50).collect()}
    a = got["a"]
    assert set(got) == {"a", "b"}
    assert (a.nano, a.cache_write, a.turns, a.repository, a.effort, a.user_name, a.user_source, a.parent_known, a.input) == (0, 7, None, "o/new", "high", "mona", "span", True, None)
    assert rows(stores.span_ancestors(spans, 50), "span_id", "parent_span_id") == [("c", "x")]


def test_billing_computes_one_source_and_its_lines_once(spark, monkeypatch):
    from spanledger.catalog import delivery

    from conftest import SF

    plans, cut = [], delivery.cut
    monkeypatch.setattr(delivery, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    found = delivery.QUERIES["billing_reconcile"](spark, SF)
    assert len(plans) == 2 and not any("o_orderkey" in p for p in plans)
    assert "event_id" not in found._jdf.queryExecution().optimizedPlan().toString()
