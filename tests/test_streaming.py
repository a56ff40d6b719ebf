import json
import random

from pyspark.sql import functions as F

from conftest import rows
from spanledger.operators import counters, ledger, windows
from spanledger.plans.snapshot import write_snapshot
from spanledger.streaming import feed as stream_feed
from spanledger.streaming import metering, series, windows as closing

EXPORT = {"resource": {"_rawAttributes": [["session.id", "w"]]}, "scopeMetrics": [{"metrics": [{"descriptor": {"name": counters.TOKEN_USAGE}, "dataPoints": [
    {"attributes": {"gen_ai.token.type": "input"}, "startTime": [0, 0], "endTime": [10, 0], "value": 5}]}]}]}
SPAN = {"spanId": "a", "startTime": [10, 0], "endTime": [11, 0], "attributes": {"gen_ai.operation.name": "chat", "gen_ai.usage.input_tokens": 7, "gen_ai.input.messages": "secret"}}


def _drain(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_feed_lands_once_across_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in" / "m1").mkdir(parents=True)
    (tmp_path / "in" / "m1" / "1.jsonl").write_text("\n".join([json.dumps(EXPORT), json.dumps(SPAN), "{}", "junk"]) + "\n")

    def run():
        _drain(stream_feed.land(stream_feed.feed_stream(spark, source), out, checkpoint))

    run()
    (tmp_path / "in" / "m1" / "2.jsonl").write_text(json.dumps({**EXPORT, "scopeMetrics": [{"metrics": [{"descriptor": {"name": counters.TOKEN_USAGE}, "dataPoints": [
        {"attributes": {"gen_ai.token.type": "input"}, "startTime": [0, 0], "endTime": [20, 0], "value": 3}]}]}]}) + "\n")
    run()
    run()
    points = spark.read.parquet(f"{out}/points")
    assert points.count() == 2
    assert counters.token_totals(counters.counter_series(points)).first().input == 8
    spans = spark.read.parquet(f"{out}/spans")
    assert rows(spans, "span_id", "input") == [("a", 7)] and "secret" not in str(spans.collect())
    assert spark.read.parquet(f"{out}/stats").agg(F.sum("span"), F.sum("ignored")).first()[:] == (2, 1)


SPANS = "span_id STRING, operation STRING, start_ms BIGINT, input BIGINT, output BIGINT, origin STRING"
DAY = 86_400_000


class Feed:
    """Files that land one after another, read by a query that starts anew each time."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.n = spark, root, schema, 0

    def land(self, *given):
        self.n += 1
        self.spark.createDataFrame(list(given), self.schema).coalesce(1).write.parquet(f"{self.root}/in/{self.n}")
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/in")

    def paths(self):
        return f"{self.root}/out", f"{self.root}/state"


def _metered(feed, *given, since=10, days=7):
    query = metering.usage_change_feed(metering.span_metering(feed.land(*given), since, days), *feed.paths(), days)
    _drain(query)
    return query


def _ledgers(spark, feed):
    changes = spark.read.parquet(f"{feed.root}/out/ledger").groupBy("ledger").agg(*[F.sum(c).alias(c) for c in ("input", "output", "requests")])
    return changes, rows(changes, "ledger", "input", "output", "requests")


def test_metering_charges_growth_and_moves_ledgers(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SPANS)
    _metered(feed, ("h", "chat", 100, 100, 10, "agent_host"), ("l", "chat", 100, 50, None, "feed"), ("old", "chat", 5, 1, 1, "feed"), ("tool", "execute_tool", 100, 1, 1, "feed"))
    assert _ledgers(spark, feed)[1] == [("harness", 100, 10, 1), ("traces", 50, 0, 1)]
    _metered(feed, ("h", "chat", 100, 120, 10, "store"), ("l", "chat", 100, 50, None, "store"), ("h", "chat", 100, 120, 10, "agent_host"))
    changes, told = _ledgers(spark, feed)
    assert told == [("harness", 0, 0, 0), ("traces", 170, 10, 2)]
    assert ledger.meter_totals(changes).first().input == 170
    # a lower copy charges nothing, another start of a span is the same span, and a run without news changes nothing
    _metered(feed, ("h", "chat", 100, 90, 3, "feed"), ("l", "chat", 200, 70, 2, "agent_host"))
    assert _ledgers(spark, feed)[1] == [("harness", 0, 0, 0), ("traces", 190, 12, 2)]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    state = metering.marks_table(spark, str(tmp_path))
    batch = spark.createDataFrame([("a", 1000, 5, 1, True), ("b", 1000, 7, None, False)], "span_id STRING, ms BIGINT, input BIGINT, output BIGINT, local BOOLEAN").withColumn("at", F.timestamp_millis("ms"))
    for batch_id in (0, 0, 1, 1):
        grown = batch.withColumn("input", F.col("input") + batch_id)
        step = state.step(batch_id, metering.charges(grown, state.before(batch_id)))
        assert step.agg(F.sum("input"), F.sum("requests")).first()[:] == ((12, 2) if batch_id == 0 else (2, 0))


def test_folds_hold_what_steps_held(spark, tmp_path):
    from spanledger.streaming.carried import Carried

    state = Carried(spark, str(tmp_path / "s"), "k STRING, n BIGINT", ["k"], {"n": F.max("n")}, every=3)
    for batch_id in range(8):
        assert rows(state.before(batch_id), "k", "n") == sorted((f"k{i}", max(range(i, batch_id, 2))) for i in range(min(2, batch_id)))
        state.step(batch_id, spark.createDataFrame([(f"k{batch_id % 2}", batch_id)], "k STRING, n BIGINT"))
    assert rows(state.before(), "k", "n") == [("k0", 6), ("k1", 7)]
    state.step(8, spark.createDataFrame([("k2", 8)], "k STRING, n BIGINT"), at="n", span=1)
    assert rows(state.before(9), "k", "n") == [("k1", 7), ("k2", 8)]


def test_retention_drops_state_and_counts_late_rows(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SPANS)
    told = [closing.state_counts(_metered(feed, *given, since=0, days=3)) for given in (
        [("a", "chat", 1 * DAY, 1, 1, "feed"), ("b", "chat", 9 * DAY, 2, 2, "feed")],
        [("c", "chat", 2 * DAY, 4, 4, "feed"), ("d", "chat", 8 * DAY, 8, 8, "feed"), ("b", "chat", 9 * DAY, 3, 2, "feed")])]
    assert [t["late"] for t in told] == [0, 1] and sum(t["expired"] for t in told) == 1 and told[-1]["left"] == 2
    # the span older than the watermark is not charged
    assert _ledgers(spark, feed)[1] == [("traces", 12, 11, 3)]


def test_transcript_growth_stream(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "session_id STRING, credits DOUBLE, updated_ms BIGINT")
    for given in ([("a", 5.0, 1), ("empty", None, 1), ("up", 1.0, 1), ("up", 4.0, 2)], [("a", 4.0, 2), ("empty", 3.0, 2)], [("a", 9.0, 3), ("empty", None, 3)]):
        _drain(metering.transcript_growth(feed.land(*given), *feed.paths()))
    total = spark.read.parquet(f"{tmp_path}/out/growth").where("kind = 'step'").groupBy("session_id").agg(F.sum("growth").alias("growth"))
    assert rows(total, "session_id", "growth") == [("a", 4.0), ("empty", 3.0), ("up", 3.0)]


def test_baseline_is_written_once(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "feed STRING, input BIGINT, output BIGINT")
    for given in ([("a", 100, 10), ("a", 90, 12)], [("a", 130, 5)], [("late", 70, 7), ("a", 50, 50)], [("late", 75, 7)]):
        _drain(metering.baseline_feed(feed.land(*given), *feed.paths()))
    charged = spark.read.parquet(f"{tmp_path}/out/charged").groupBy("feed").agg(F.max("input").alias("input"), F.max("output").alias("output"))
    assert rows(charged, "feed", "input", "output") == [("a", 30, 38), ("late", 5, 0)]
    versions = spark.read.parquet(f"{tmp_path}/out/baseline").where("batch >= 0")
    assert rows(versions, "feed", "input") == [("a", 100), ("late", 70)]


def test_late_points_carry_over_batches(spark, tmp_path):
    """Any split into batches, rows shuffled within each, gives the verdicts of one scan over everything."""
    rng = random.Random(4)
    points = [(f"f{rng.randrange(2)}", "s", f"m{rng.randrange(2)}", 0, i, rng.choice([0, 5, 10, 20, 40, 60, i, i, i]), rng.choice([1.0, 2.0, -1.0, float("nan")])) for i in range(120)]
    schema = "feed STRING, session STRING, metric STRING, start_ms BIGINT, seq BIGINT, at_ms BIGINT, value DOUBLE"
    with_attrs = lambda df: df.withColumn("attrs", F.create_map(F.lit("k"), F.lit("v")))
    want = rows(counters.judged(with_attrs(spark.createDataFrame(points, schema)))[1], "seq", "ok", "late")
    assert 5 < sum(late for _, _, late in want) < 100
    feed = Feed(spark, str(tmp_path), schema)
    for a, b in ((0, 1), (1, 50), (50, 53), (53, 120)):
        part = points[a:b]
        rng.shuffle(part)
        _drain(series.late_feed(with_attrs(feed.land(*part)), *feed.paths()))
    assert rows(spark.read.parquet(f"{tmp_path}/out/verdicts"), "seq", "ok", "late") == want


CALLS = "session_id STRING, operation STRING, start_ms BIGINT, input BIGINT, output BIGINT, nano BIGINT"
MINUTE = 60_000


def test_windows_of_a_table(spark):
    given = [("a", "chat", 0, 1, None, 5), ("a", "chat", 59 * MINUTE, 2, 3, None), ("a", "chat", 89 * MINUTE, 4, 1, 1), ("a", "chat", 200 * MINUTE, None, None, None), ("b", "execute_tool", 0, 9, 9, 9)]
    calls = windows.timed_calls(spark.createDataFrame(given, CALLS))
    assert rows(windows.usage_windows(calls), "window_start_ms", "calls", "input", "output", "output_calls") == [
        (0, 2, 3, 3, 1), (180 * MINUTE, 1, None, None, 0), (60 * MINUTE, 1, 4, 1, 1)]
    sliding = windows.usage_windows(calls, "1 hour", "30 minutes")
    assert sliding.agg(F.sum("calls")).first()[0] == 8 and rows(sliding.where(f"window_start_ms = {30 * MINUTE}"), "calls", "input") == [(2, 6)]
    assert rows(windows.usage_sessions(calls), "window_start_ms", "window_end_ms", "calls", "input") == [
        (0, 30 * MINUTE, 1, 1), (200 * MINUTE, 230 * MINUTE, 1, None), (59 * MINUTE, 119 * MINUTE, 2, 6)]
    assert windows.usage_windows(calls.limit(0)).count() == 0


def test_windows_close_behind_the_watermark(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), CALLS)
    out, state = feed.paths()

    def run(*given):
        calls = windows.timed_calls(feed.land(*given)).withWatermark("at", "10 minutes")
        query = closing.append_closed(windows.usage_sessions(calls), out, state)
        _drain(query)
        return closing.state_counts(query)["late"]

    assert run(("a", "chat", 0, 1, 1, 1), ("a", "chat", 20 * MINUTE, 1, 1, 1)) == 0
    assert spark.read.schema("calls BIGINT").parquet(out).count() == 0
    assert run(("b", "chat", 300 * MINUTE, 7, 1, 1)) == 0
    assert rows(spark.read.parquet(out), "session_id", "calls", "window_end_ms") == [("a", 2, 50 * MINUTE)]
    # older than all open windows: not added, but counted; the trailing call closes the session of b
    assert run(("a", "chat", 30 * MINUTE, 1, 1, 1), ("c", "chat", 900 * MINUTE, 1, 1, 1)) == 1
    assert rows(spark.read.parquet(out), "session_id", "calls") == [("a", 2), ("b", 1)]


def test_snapshot_sink_replaces_itself(spark, tmp_path):
    made = spark.createDataFrame([(7, "cost", "input", 1.0, None), (7, "speed", "sessions", 2.0, None)], "generated_ms BIGINT, section STRING, measure STRING, value DOUBLE, text STRING")
    for _ in range(2):
        write_snapshot(made, str(tmp_path / "s"))
    write_snapshot(made.withColumn("generated_ms", F.lit(8)), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
