import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spanledger.operators import counters, ledger, quality
from spanledger.plans import sections, speed
from spanledger.sources import feed

POINT = "feed STRING, rec BIGINT, seq BIGINT, session STRING, metric STRING, attrs MAP<STRING,STRING>, start_ms BIGINT, at_ms BIGINT, value DOUBLE"
USAGE = counters.TOKEN_USAGE
INPUT = {"gen_ai.token.type": "input"}


@pytest.fixture()
def points(spark):
    def make(*given):
        return spark.createDataFrame(
            [("f", i, i, g.get("session", "s"), g.get("metric", USAGE), g.get("attrs", INPUT), g.get("start", 0), g.get("at", 0), g["v"]) for i, g in enumerate(given)], POINT)
    return make


def total(series):
    return counters.metric_total(series, USAGE, INPUT).first().total


@pytest.mark.parametrize("given, want", [
    ([dict(v=1000.0, at=1), dict(v=2500.0, at=2), dict(v=300.0, at=3)], 2800),
    ([dict(v=1000.0, session="a"), dict(v=700.0, session="b")], 1700),
    ([dict(v=200.0, at=5, start=1), dict(v=100.0, at=4, start=1), dict(v=100.0, at=6, start=1), dict(v=250.0, at=7, start=1)], 250),
    ([dict(v=200.0, at=5, start=1), dict(v=300.0, at=9, start=8), dict(v=300.0, at=10, start=8)], 500),
    ([dict(v=6580.0, at=1)] * 3, 6580),
    ([dict(v=200.0, at=1), dict(v=-1.0, at=2), dict(v=float("inf"), at=3)], 200),
])
def test_cumulative_totals(points, given, want):
    assert total(counters.counter_series(points(*given))) == want


def test_malformed_counts_only_when_punctual(points):
    _, judged = counters.judged(points(dict(v=200.0, at=5), dict(v=-1.0, at=6), dict(v=float("inf"), at=7), dict(v=-1.0, at=1)))
    got = counters.metric_validity(judged).first()
    assert (got.points, got.late, got.malformed) == (4, 1, 2)


def _fold(given):
    """One series, step by step."""
    last = banked = 0.0
    mark = None
    for g in given:
        if mark is None:
            mark = g["at"]
        if 0 < g["at"] < mark:
            continue
        if g["v"] < 0:
            continue
        if g["v"] < last and not g["start"]:
            banked, last = banked + last, 0.0
        last, mark = max(last, g["v"]), max(mark, g["at"])
    return banked + last


@pytest.mark.parametrize("hot_rows", [3, 10**9])
@pytest.mark.parametrize("start", [0, 4])
def test_random_series_match_a_fold(points, hot_rows, start):
    rnd = random.Random(start)
    for _ in range(3):
        given = [dict(v=float(rnd.randrange(-3, 50)), at=rnd.choice([0, i, max(1, i - 3)]), start=start) for i in range(1, 40)]
        assert total(counters.counter_series(points(*given), hot_rows)) == _fold(given)


def _hist_points(spark, given):
    data = [("f", i, i, "s", "m", {}, g["start"], g["at"], g["sum"], g["count"], [10.0], g["counts"]) for i, g in enumerate(given)]
    return spark.createDataFrame(data, POINT.replace("value DOUBLE", "h_sum DOUBLE, h_count DOUBLE, boundaries ARRAY<DOUBLE>, counts ARRAY<DOUBLE>"))


def _hist_fold(given):
    last = count = total = seen = 0.0
    mark = None
    for g in given:
        mark = g["at"] if mark is None else mark
        if 0 < g["at"] < mark:
            continue
        if g["start"] and (g["sum"] < last or g["count"] < count):
            continue
        if g["sum"] < last:
            total, seen, last, count = total + last, seen + count, 0.0, 0.0
        last, count, mark = max(last, g["sum"]), max(count, g["count"]), max(mark, g["at"])
    return total + last, seen + count


@pytest.mark.parametrize("hot_rows", [6, 10**9])
@pytest.mark.parametrize("start", [0, 7])
def test_histogram_acceptance_matches_a_fold(spark, start, hot_rows):
    rnd = random.Random(start + 1)
    given = [dict(sum=float(i + rnd.randrange(12)), count=float(i // 3 + rnd.randrange(5)), at=rnd.choice([0, i, max(1, i - 4)]), start=start, counts=[1.0, 2.0]) for i in range(1, 30)]
    got = counters.histogram_series(counters.histogram_runs(_hist_points(spark, given), hot_rows)).first()
    assert (got.total, got["count"]) == _hist_fold(given)


def test_quantile_keeps_banked_buckets(spark):
    given = [dict(sum=2000.0, count=10.0, at=1, start=0, counts=[0.0, 10.0]), dict(sum=5.0, count=1.0, at=2, start=0, counts=[1.0, 0.0])]
    runs = counters.histogram_runs(_hist_points(spark, given))
    assert counters.hist_quantiles(runs, [0.5]).first().value > 10


def test_burn_rate(points):
    given = [dict(v=v, at=at * 1000) for v, at in ((1_000_000.0, 10), (1_000_100.0, 20), (1_000_100.0, 30))]
    buckets = counters.token_series(points(*given), 0)
    assert rows(buckets, "t_ms", "input") == [(10_000, 1_000_000), (20_000, 100), (30_000, 0)]
    assert counters.burn_rate(buckets).first().burn_per_hour == 18000


def test_older_export_is_dropped_and_equal_times_merge(points):
    given = [dict(v=5.0, at=20_000), dict(v=9.0, at=20_000), dict(v=7.0, at=10_000, session="b"), dict(v=12.0, at=30_000)]
    assert rows(counters.token_series(points(*given), 0), "t_ms", "input") == [(20_000, 9), (30_000, 3)]


def test_events_answer_only_for_unmeasured_instruments(spark):
    metrics = spark.createDataFrame([(quality.TOOL_CALL_COUNT, "success=true", {"success": "true"}, 0.0, 1.0)], "metric STRING, series_key STRING, attrs MAP<STRING,STRING>, total DOUBLE, count DOUBLE")
    signals = spark.createDataFrame([(quality.TOOL_CALL_COUNT, 1.0, {"success": "false"}), (quality.USER_FEEDBACK, 1.0, {"rating": "positive"})], "metric STRING, value DOUBLE, attrs MAP<STRING,STRING>")
    got = rows(counters.all_series(metrics, signals), "metric", "source")
    assert got == [(quality.TOOL_CALL_COUNT, "metrics"), (quality.USER_FEEDBACK, "events")]


def _export(name, value, attrs=None, session="w1", start=(1790190101, 933000000), end=(1790190103, 447000000)):
    return {"resource": {"_rawAttributes": [["session.id", session]]}, "scopeMetrics": [{"metrics": [
        {"descriptor": {"name": name}, "dataPoints": [{"attributes": attrs or {}, "startTime": list(start), "endTime": list(end), "value": value}]}]}]}


def test_feed_records_points_and_stats(spark):
    histogram = {"min": 880, "max": 1500, "sum": 2380, "count": 2, "buckets": {"boundaries": [0, 5], "counts": [0, 1, 1]}}
    text = [
        json.dumps(_export(USAGE, histogram, {"gen_ai.token.type": "input", "n": 3, "big": "x" * 600, "gen_ai.input.messages": "secret"})),
        json.dumps({"attributes": {"event.name": "copilot_chat.user.feedback", "rating": "positive"}, "_hrTime": [1790190101, 932000000], "_body": "b"}),
        "{}", "  ", "text", '{"broken', '{"other":1}', '{"spanId":"a","startTime":[1,0],"endTime":[2,0]}', '{"scopeMetrics":5,"body":null}',
    ]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "feed STRING, seq BIGINT, line STRING")
    records = feed.feed_scan(lines)
    assert [r.kind for r in records.orderBy("seq").collect()] == ["metrics", "log", "span", "ignored", "ignored", "malformed", "unknown", "span", "log"]
    point = feed.metric_points(records).first()
    assert point.attrs == {"gen_ai.token.type": "input", "n": "3"} and point.session == "w1" and point.is_hist
    assert (point.h_sum, point.h_count, point.counts, point.at_ms) == (2380.0, 2.0, [0.0, 1.0, 1.0], 1790190103447.0)
    stats = feed.record_stats(records, feed.metric_points(records), feed.log_events(records)).first()
    assert (stats.metrics, stats.log, stats.span, stats.unknown, stats.malformed) == (1, 2, 2, 1, 1)
    assert stats.last_record_ms == 1790190103447 and stats.last_token_usage_ms == 1790190103447
    signals = quality.quality_signals(feed.log_events(records))
    assert rows(signals, "metric", "value") == [(quality.USER_FEEDBACK, 1.0)]


def _landed(spark, *exports):
    lines = spark.createDataFrame([("f", i, json.dumps(e)) for i, e in enumerate(exports)], "feed STRING, seq BIGINT, line STRING")
    return feed.metric_points(feed.feed_scan(lines))


def _usage(total, count, kind, model, at=1790190103, bounds=(0, 5)):
    value = {"sum": total, "count": count, "buckets": {"boundaries": list(bounds), "counts": [0] * len(bounds) + [count]}}
    return _export(USAGE, value, {"gen_ai.token.type": kind, "gen_ai.response.model": model}, end=(at, 0))


def test_feed_is_parsed_once_and_counted_as_in_three_passes(spark):
    """Records without scopes, metrics or points count once; the plan reads the lines once."""
    point = lambda at: '{"attributes":{},"endTime":[%d,0],"value":1}' % at
    metric = lambda name, *at: '{"descriptor":{"name":"%s"},"dataPoints":[%s]}' % (name, ",".join(map(point, at)))
    export = lambda *scopes: '{"scopeMetrics":[%s]}' % ",".join('{"metrics":[%s]}' % ",".join(s) for s in scopes)
    lines = [
        export(), export([]), export([metric("x")]), export([metric("x", 5, 9), metric("", 99)], [metric(feed.TOKEN_USAGE, 7, 3)], []), '{"scopeMetrics":[{}]}', '{"scopeMetrics":[7,null]}',
        '{"_body":"said","hrTime":[50,0]}', '{"_body":"","hrTime":[60,0]}', '{"attributes":{"event.name":"e"},"_hrTime":null,"hrTime":[8,0]}', '{"attributes":{"event.name":5},"body":7}',
        '{"spanId":"s","startTime":[1,0],"endTime":[2,0]}', '{"spanId":"s","startTime":0,"endTime":[2,0],"attributes":null}', "{", "{}", "x", '{"y":1}',
    ]
    given = spark.createDataFrame([(f"f{i % 2}" if k else "all", i, t) for k in (0, 1) for i, t in enumerate(lines)] + [("logs", 0, lines[6])], "feed STRING, seq BIGINT, line STRING")
    records = feed.feed_scan(given)
    want = feed.record_stats(records, feed.metric_points(records), feed.log_events(records))
    assert rows(feed.feed_stats(records), *want.columns) == rows(want, *want.columns)
    # one scan of the lines, where the joined form has three
    assert feed.feed_stats(records)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def test_span_members_of_other_types_are_read_as_missing(spark):
    """What one pass over a record finds equals what single reads find, for members of every type."""
    odd = ["null", "7", "-1.5", "true", '"t"', '""', '"' + "x" * 513 + '"', "[1]", '{"k":1}', "1e400", '"5"']
    made = []
    for i, v in enumerate(odd):
        for at, whole in enumerate(['"user.name":%s', '"gen_ai.usage.input_tokens":%s', '"gen_ai.response.model":%s,"gen_ai.request.model":"q"', '"server.address":%s']):
            made.append('{"spanId":"s%d_%d","startTime":[5,0],"endTime":[6,0],"status":%s,"parentSpanId":%s,"parentSpanContext":%s,"ended":%s,"attributes":{"gen_ai.operation.name":"chat",%s}}' % (
                i, at, v, v, v, v, whole % v))
    made += ['{"spanId":"a%d","startTime":[5,0],"endTime":[6,0],"attributes":%s}' % (i, v) for i, v in enumerate(odd)]
    records = feed.feed_scan(spark.createDataFrame([("f", i, t) for i, t in enumerate(made)], "feed STRING, seq BIGINT, line STRING"))
    got = {r.span_id: r for r in feed.file_spans(records).collect()}
    assert not [k for k in got if k.startswith("a")] and got["s4_0"].user_name == "t" and got["s10_1"].input is None and got["s1_1"].input == 7
    assert {k: r.model for k, r in got.items() if k.endswith("_2")} == {f"s{i}_2": {4: "t", 10: "5"}.get(i, "q") for i in range(len(odd)) if f"s{i}_2" in got}
    assert {k: r.parent_known for k, r in got.items() if k.endswith("_0")} == {f"s{i}_0": i == 0 for i in range(len(odd)) if f"s{i}_0" in got}



def test_histograms_count_as_tokens(spark):
    first = [_usage(2380, 2, "input", "gpt-4o"), _usage(4200, 1, "input", "claude"), _usage(250, 1, "output", "gpt-4o"), _usage(140, 1, "output", "claude")]
    for exports in (first, first * 3):
        totals = counters.token_totals(counters.series(_landed(spark, *exports))).first()
        assert (totals.input, totals.output) == (6580, 390)
    plain = _export(USAGE, 20, {"gen_ai.token.type": "input", "gen_ai.response.model": "gpt-4o"}, session="w2")
    both = counters.series(_landed(spark, *first, plain))
    assert {(r.model, r.input, r.output) for r in counters.tokens_by_model(both).collect()} == {("gpt-4o", 2400, 250), ("claude", 4200, 140)}


def test_histogram_growth_fills_token_buckets(spark):
    landed = _landed(spark, _usage(1000, 1, "input", "m", 10), _usage(2500, 2, "input", "m", 20), _export(USAGE, 7, {"gen_ai.token.type": "output"}, end=(20, 0)))
    assert rows(counters.token_series(landed, 0), "t_ms", "input", "output") == [(10_000, 1000, 0), (20_000, 1500, 7)]


def test_histogram_turns_answer_without_spans(spark):
    value = {"sum": 9, "count": 3, "buckets": {"boundaries": [5], "counts": [3, 0]}}
    spans = spark.createDataFrame([], "operation STRING, turns BIGINT")
    got = speed.turns_per_invocation(spans, counters.series(_landed(spark, _export(speed.AGENT_TURNS, value)))).first()
    assert tuple(got) == (3.0, "metrics")


def test_quantile_takes_the_current_layout_of_the_first_series(spark):
    given = [("f", 1, 1, "s", "m", {}, 0, 1, 50.0, 5.0, [100.0], [5.0, 0.0]), ("f", 2, 2, "s", "m", {}, 0, 2, 5.0, 1.0, [10.0], [1.0, 0.0])]
    columns = POINT.replace("value DOUBLE", "h_sum DOUBLE, h_count DOUBLE, boundaries ARRAY<DOUBLE>, counts ARRAY<DOUBLE>")
    runs = counters.histogram_runs(spark.createDataFrame(given, columns))
    assert counters.hist_quantiles(runs, [0.5]).first().value == 5.0


def test_file_span_identity_and_links(spark):
    base = {"startTime": [10, 0], "endTime": [11, 500000000], "attributes": {"gen_ai.operation.name": "chat", "gen_ai.usage.input_tokens": 5.5, "gen_ai.usage.output_tokens": 7}}
    resource = {"_rawAttributes": [["user.name", "configured"]]}
    text = [
        {**base, "spanId": "a", "resource": resource, "parentSpanContext": {"spanId": "p"}}, {**base, "spanId": "b", "ended": False},
        {**base, "spanId": "c", "resource": resource, "attributes": {**base["attributes"], "user.name": "own"}, "parentSpanId": 5},
        {**base, "spanId": "d", "endTime": [9, 0]}, {**base, "spanId": "e", "status": {"code": 2}, "traceId": "t"}]
    lines = spark.createDataFrame([("f", i, json.dumps(t)) for i, t in enumerate(text)], "feed STRING, seq BIGINT, line STRING")
    got = {r.span_id: r for r in feed.file_spans(feed.feed_scan(lines)).collect()}
    assert set(got) == {"a", "c", "e"}
    assert (got["a"].user_name, got["a"].user_source, got["a"].parent_span_id, got["a"].parent_known) == ("configured", "resource", "p", True)
    assert (got["c"].user_name, got["c"].user_source, got["c"].parent_known) == ("own", "span", False)
    assert (got["e"].input, got["e"].output, got["e"].failed, got["e"].trace_id, got["e"].end_ms) == (None, 7, True, "t", 11500.0)


def test_reconciliation_by_max_and_transfer(spark):
    def totals(*given):
        return ledger.drift(ledger.meter_totals(spark.createDataFrame(list(given), "ledger STRING, input BIGINT, output BIGINT, requests BIGINT"))).first()

    got = totals(("metrics", 200, 10, 0), ("traces", 100, 20, 1))
    assert (got.input, got.output) == (200, 20)
    got = totals(("metrics", 1_000_000, 0, 0), ("traces", 400_000, 400, 2), ("harness", 300_000, 0, 1))
    assert (got.input, got.span_tokens, got.pending) == (1_300_000, 400_400, False)
    assert totals(("metrics", 100, 0, 0)).pending
    previous = spark.createDataFrame([("a", 50, 100, 10, True)], "span_id STRING, at_ms BIGINT, input BIGINT, output BIGINT, harness BOOLEAN")
    calls = spark.createDataFrame([("a", 50, 120, 10), ("b", 60, 5, 5)], "span_id STRING, at_ms BIGINT, input BIGINT, output BIGINT")
    hosted = spark.createDataFrame([("b",)], "span_id STRING")
    growth = {r.ledger: (r.input, r.output, r.requests) for r in ledger.ledger_growth(ledger.accounting_step(previous, calls, hosted, 0)).collect()}
    assert growth == {"traces": (120, 10, 1), "harness": (-95, -5, 0)}
    refused = ledger.accounting_step(previous, calls, hosted, 0, accepting=False)
    assert rows(refused, "span_id", "input", "harness", "m_requests") == [("a", 100, True, 0), ("b", 5, False, 0)]


def test_baseline_is_history(spark):
    totals = spark.createDataFrame([("a", 150, 30), ("new", 9, 9)], "feed STRING, input BIGINT, output BIGINT")
    before = spark.createDataFrame([("a", 100, 40)], "feed STRING, input BIGINT, output BIGINT")
    got = rows(ledger.metric_baseline(before, totals, ["feed"]), "feed", "charged_input", "charged_output", "input", "output")
    assert got == [("a", 50, 0, 150, 40), ("new", 0, 0, 9, 9)]


def test_gauge_prefers_context_then_account_then_budget(spark):
    context = spark.createDataFrame([(50, 200.0, 1000)], "used BIGINT, limit DOUBLE, at_ms BIGINT")
    account = spark.createDataFrame([("ready", False, 75.0, 900_000, None)], "status STRING, unlimited BOOLEAN, percent_remaining DOUBLE, fetched_ms BIGINT, reset_ms BIGINT")
    totals = spark.createDataFrame([(30,)], "total BIGINT")

    def at(now, budget):
        return tuple(sections.gauge_basis(context, account, totals, now, budget).first())

    assert at(2000, 0) == ("context", 0.75)
    assert at(1_900_000 - 100_001, 0) == ("account", 0.75) or at(1_799_999, 0)[0] in ("context", "account")
    assert at(5_000_000, 40) == ("budget", 0.25)
    assert at(5_000_000, 0) == ("unavailable", 1.0)


def test_estimates_only_where_spans_are_silent(spark):
    exact = spark.createDataFrame([("llm", 0.5, 10.0)], "name STRING, q DOUBLE, value DOUBLE")
    guess = spark.createDataFrame([("llm", 0.5, 99.0), ("ttft", 0.5, 450.0)], "name STRING, q DOUBLE, value DOUBLE")
    assert rows(speed.prefer_exact(exact, guess), "name", "value", "source") == [("llm", 10.0, "spans"), ("ttft", 450.0, "metrics")]


def test_feed_lines_are_dealt_out_before_they_are_built(spark):
    """A split of the packed table must not become one task that parses all its lines."""
    from spanledger.catalog import ingest

    from conftest import SF

    found = ingest.lines(spark, SF)
    assert "RepartitionByExpression [eid" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.select("seq").distinct().count() == found.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_histogram_scans_hold_no_buckets(spark):
    from spanledger.catalog import bridge

    from conftest import SF

    _, settled = counters.settled_levels(bridge.histograms(spark, SF))
    assert not {"attrs", "boundaries", "counts"} & set(settled.columns)
    plain = counters.histogram_runs(bridge.histograms(spark, SF), buckets=False)
    full = counters.histogram_runs(bridge.histograms(spark, SF))
    shown = ["feed", "session", "start_ms", "metric", "series_key", "run", "total", "count", "updated_ms", "first_seq"]
    assert "buckets" not in plain.columns and rows(plain, *shown) == rows(full, *shown) and full.where("buckets IS NULL").isEmpty()
