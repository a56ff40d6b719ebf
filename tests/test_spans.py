import random

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from spanledger.catalog import bridge
from spanledger.operators import ancestry, context, merge, sessions, tally
from spanledger.operators.quantile import exact_quantiles, ranged_values
from spanledger.operators.scan import Prefix, prefix_scan
from spanledger.plans import speed

NANO = 1_000_000_000


def test_credits_zero_is_not_missing(make_spans):
    spans = make_spans({"span_id": "a", "nano": 0}, {"span_id": "b"}, {"span_id": "c", "nano": None})
    got = tally.chat_totals(spans).first()
    assert (got.calls, got.credit_calls, got.credits) == (3, 1, 0.0)


def test_first_copy_wins(make_spans):
    spans = make_spans({"span_id": "a", "input": 5, "ord": 0}, {"span_id": "a", "input": 9, "ord": 4}, {"span_id": "b", "input": 1})
    assert rows(merge.span_dedup(spans), "span_id", "input") == [("a", 5), ("b", 1)]


@pytest.mark.parametrize("key", ["native_session_id", "conversation_id", "parent_session_id", "trace_id"])
def test_context_follows_time_for_every_key(make_spans, key):
    agent_key = "native_session_id" if key == "parent_session_id" else key
    agents = [{"span_id": "new", "operation": "invoke_agent", "start_ms": 300, agent_key: "x", "repository": "o/new"},
              {"span_id": "old", "operation": "invoke_agent", "start_ms": 100, agent_key: "x", "repository": "o/old"}]
    calls = [{"span_id": f"c{t}", "start_ms": t, key: "x", "nano": n * NANO} for t, n in ((50, 1), (200, 2), (400, 3))]
    got = context.attributed_calls(make_spans(*agents, *calls))
    assert rows(got, "span_id", "work_repository") == [("c200", "o/old"), ("c400", "o/new"), ("c50", None)]


def test_conflicting_chat_cannot_inherit_through_weak_keys(make_spans):
    spans = make_spans(
        {"span_id": "a", "operation": "invoke_agent", "start_ms": 100, "native_session_id": "one", "conversation_id": "s", "trace_id": "t",
         "repository": "o/one", "user_name": "mona", "user_source": "span"},
        {"span_id": "c", "start_ms": 200, "native_session_id": "two", "conversation_id": "s", "trace_id": "t"})
    assert rows(context.attributed_calls(spans), "work_repository", "user_by") == [(None, None)]


def test_first_matching_key_decides_even_without_repository(make_spans):
    spans = make_spans(
        {"span_id": "a", "operation": "invoke_agent", "start_ms": 10, "native_session_id": "s", "branch": "b"},
        {"span_id": "t", "operation": "invoke_agent", "start_ms": 20, "native_session_id": "s2", "trace_id": "t", "repository": "o/r"},
        {"span_id": "c", "start_ms": 30, "native_session_id": "s", "trace_id": "t"})
    assert rows(context.attributed_calls(spans), "work_repository", "work_branch") == [(None, "b")]


def test_pseudonym_is_not_a_user(make_spans):
    spans = make_spans(
        {"span_id": "a", "operation": "invoke_agent", "start_ms": 1, "native_session_id": "s", "actor_id": "p"},
        {"span_id": "c", "start_ms": 2, "native_session_id": "s"})
    assert rows(context.attributed_calls(spans), "user_by", "actor_by") == [(None, "p")]


def _reference_context(spans, field):
    """Step-by-step restatement of the lookup rules."""
    agents = sorted((s for s in spans if s["operation"] == "invoke_agent" and (s["repository"] or s["branch"])), key=lambda s: (s["start_ms"], s["ord"]))
    out = {}
    for call in spans:
        if call["operation"] != "chat":
            continue
        found = None
        for agent_key, call_key, weak in (("session_id", "session_id", False), ("conversation_id", "conversation_id", True),
                                          ("session_id", "parent_session_id", False), ("trace_id", "trace_id", True)):
            if call[call_key] is None:
                continue
            for a in agents:
                if a[agent_key] != call[call_key] or a["start_ms"] > call["start_ms"]:
                    continue
                native = call["native_session_id"]
                if weak and native and a["native_session_id"] and a["native_session_id"] not in (native, call["parent_session_id"]):
                    continue
                found = a
            if found:
                break
        out[call["span_id"]] = found[field] if found else None
    return out


@pytest.mark.parametrize("hot_rows", [5, 10_000_000])
def test_context_matches_restatement_with_and_without_hot_keys(make_spans, hot_rows):
    rnd = random.Random(7)
    maybe = lambda options: rnd.choice([None, *options])
    data = []
    for i in range(400):
        native, conversation = maybe(["s1", "s2"]), maybe(["v1", "v2"])
        data.append({
            "span_id": f"x{i}", "ord": i, "operation": rnd.choice(["chat", "chat", "invoke_agent"]), "native_session_id": native, "conversation_id": conversation,
            "session_id": native or conversation, "trace_id": maybe(["t1", "t2", "t3"]), "parent_session_id": maybe(["s1", "s2"]),
            "start_ms": rnd.randrange(1, 200), "repository": maybe(["r1", "r2"]), "branch": maybe(["b"])})
    got = context.attributed_calls(make_spans(*data), hot_rows)
    for field in ("repository", "branch"):
        assert dict(rows(got, "span_id", f"work_{field}")) == _reference_context(data, field)


@pytest.mark.parametrize("reverse", [False, True])
def test_sliced_scan_equals_plain_window(spark, reverse):
    rnd = random.Random(3)
    df = spark.createDataFrame([("hot" if i % 3 else "k%d" % (i % 5), i, rnd.choice([None, rnd.randrange(100)])) for i in range(500)], "k STRING, i BIGINT, v BIGINT")
    specs = {
        "s": Prefix("sum", F.col("v")), "mx": Prefix("max", F.col("v"), inclusive=False), "mn": Prefix("min", F.col("v")),
        "l": Prefix("last", F.col("v"), inclusive=False)}
    plain, cut = (prefix_scan(df, ["k"], ["i"], specs, h, reverse) for h in (10**9, 20))
    assert rows(plain, *plain.columns) == rows(cut, *plain.columns)


def test_ancestry_cases(make_spans):
    agent = {"operation": "invoke_agent", "sdk": True}
    spans = make_spans(
        {"span_id": "root", **agent, "sdk_nano": 2 * NANO, "trace_id": "t"}, {"span_id": "tool", "operation": "execute_tool", "parent_span_id": "root", "trace_id": "t"},
        {"span_id": "nested", **agent, "parent_span_id": "tool", "trace_id": "t", "sdk_nano": NANO}, {"span_id": "lost", **agent, "parent_span_id": "gone"},
        {"span_id": "unsure", **agent, "parent_known": False}, {"span_id": "c1", **agent, "parent_span_id": "c2"}, {"span_id": "c2", **agent, "parent_span_id": "c1"},
        {"span_id": "self", **agent, "parent_span_id": "self"}, {"span_id": "foreign", **agent, "parent_span_id": "tool", "trace_id": "other"},
        {"span_id": "anchored", **agent, "parent_span_id": "anchor", "trace_id": "t", "sdk_nano": 3 * NANO},
        *[{"span_id": f"d{i}", **agent, "parent_span_id": f"d{i - 1}" if i else None} for i in range(20)])
    ancestors = make_spans({"span_id": "anchor", "operation": "", "trace_id": "t"}).select("span_id", "trace_id", "parent_span_id", "parent_known")
    got = dict(rows(ancestry.classify_roots(spans, ancestors), "span_id", "root"))
    expect = {"root": "root", "nested": "nested", "lost": "unknown", "unsure": "unknown", "c1": "unknown", "c2": "unknown", "self": "unknown",
              "foreign": "unknown", "anchored": "root", "d0": "root", **{f"d{i}": "nested" for i in range(1, 20)}}
    assert got == expect
    total = ancestry.sdk_root_credits(spans, ancestors).first()
    assert (total.invocations, total.reported_invocations, total.credits, total.unclassified) == (3, 2, 5.0, 6)


def test_topk_folds_only_beyond_one_spare_row(spark):
    def tallies(n):
        return spark.createDataFrame([(f"m{i}", 1, 1, (n - i) * NANO) for i in range(n)], "key STRING, calls BIGINT, credit_calls BIGINT, nano BIGINT")
    assert len(tally.topk_with_remainder(tallies(6), "none").collect()) == 6
    eight = rows(tally.topk_with_remainder(tallies(8), "none"), "label", "credits")
    assert len(eight) == 6 and ("3 more", 6.0) in eight


def test_coverage_pairs(make_spans):
    spans = make_spans(
        {"span_id": "a", "input": 100, "cached": 50, "reasoning": 3}, {"span_id": "b", "input": 900, "output": 0}, {"span_id": "c", "cached": 25},
        {"span_id": "d", "input": 100, "cached": 101})
    ratio = tally.cache_read_ratio(spans).first()
    assert (ratio.ratio, ratio.reported_calls, ratio.share) == (0.5, 1, 0.25)
    fields = {r.field: (r.tokens, r.reported_calls, r.share) for r in tally.token_coverage(spans).collect()}
    assert fields["reasoning"] == (3, 1, 0.25) and fields["output"] == (0, 1, 0.25) and fields["cache_write"] == (None, 0, 0.0)


def test_merge_prefers_known_store_values(make_spans):
    file = make_spans({"span_id": "a", "input": 5, "nano": 9, "effort": "high", "parent_known": True, "parent_span_id": "p", "user_name": "u", "user_source": "resource", "auxiliary": True})
    store = make_spans({"span_id": "a", "input": 0, "native_session_id": "n", "parent_known": False}, {"span_id": "b"})
    got = {r.span_id: r for r in merge.span_merge(file, store).collect()}
    a = got["a"]
    assert (a.input, a.nano, a.effort, a.parent_span_id, a.user_source, a.auxiliary, a.session_id) == (0, 9, "high", "p", "resource", True, "n")
    assert set(got) == {"a", "b"}


def test_session_labels_and_users(make_spans):
    agents = [{"span_id": f"a{i}", "operation": "invoke_agent", "native_session_id": "s", "start_ms": 10 * i + 1, "user_name": u, "repository": "o/r", "branch": None}
              for i, u in enumerate(["mona", "hubot", "mona", "alex", "blair"])]
    got = sessions.session_work(make_spans(*agents)).first()
    assert (got.users, got.user_label, got.work) == (4, "mona, hubot, alex, +1 more", "o/r")


def test_later_call_without_limit_clears_context(make_spans):
    spans = make_spans({"span_id": "a", "native_session_id": "s", "start_ms": 1, "prompt_limit": 100.0, "input": 5}, {"span_id": "b", "native_session_id": "s", "start_ms": 2, "input": 7})
    assert sessions.prompt_context(sessions.latest_call(spans)).count() == 0


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [float(v * v % 5000) for v in range(301)]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g STRING, v DOUBLE")
    want = df.agg(*[F.expr(f"percentile(v, {q})") for q in (0.0, 0.5, 0.95, 1.0)]).first()
    got = {r.q: r.value for r in exact_quantiles(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert [got[q] for q in (0.0, 0.5, 0.95, 1.0)] == pytest.approx(list(want))


def test_quantile_ranges_hold_about_equal_counts(spark):
    """A million distinct values between 0 and 1,024, and one outlier: no range holds more than twice its share."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 5, 1e12).otherwise(F.col("id") / 1000).alias("v"))
    assert ranged_values(df, ["g"], "v", 16).groupBy("_range").count().agg(F.max("count")).first()[0] <= 125_000
    want = df.agg(F.expr("percentile(v, 0.5)")).first()[0]
    got = exact_quantiles(df, ["g"], "v", [0.5], 16).first()
    assert (got.value, got.n) == (pytest.approx(want), 1_000_000)


def test_quantiles_without_groups_or_rows(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,)], "v DOUBLE")
    assert rows(exact_quantiles(df, [], "v", [0.5]), "q", "value", "n") == [(0.5, 2.0, 2)]
    assert exact_quantiles(df.where("v > 5"), [], "v", [0.5]).count() == 0


def test_throughput(make_spans):
    spans = make_spans({"span_id": "a", "output": 400, "start_ms": 1, "end_ms": 2001})
    assert speed.output_throughput(spans).first()[0] == 12000.0


def test_duplicates_and_order_change_nothing(spark):
    spans = bridge.spans(spark, SF)
    again = merge.span_dedup(spans.unionByName(spans.withColumn("ord", F.col("ord") + 10**9)).orderBy(F.rand(1)))
    for calc in (tally.chat_totals, sessions.session_rollup):
        assert rows(calc(again), *calc(spans).columns) == rows(calc(spans), *calc(spans).columns)


@pytest.mark.parametrize("odd", [None, 10**15])
def test_slices_hold_about_equal_rows_whatever_the_order_values(spark, odd):
    """Order fields that jump, and one wrong clock, leave no slice above twice the target."""
    from spanledger.operators.scan import SlicedScan

    df = spark.range(4000).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, F.lit(odd)).otherwise(F.col("id")).alias("t"), F.col("id").alias("v"))
    ordered = df.select("k", F.struct((F.col("t") % 3).alias("segment"), F.coalesce("t", F.lit(0)).alias("row")).alias("seq"), "v")
    scan = SlicedScan(ordered, ["k"], ["seq"], 500)
    assert scan.rows.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 1000
