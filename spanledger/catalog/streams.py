"""Queries that run the given events through streams, landed in segments of event order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import counters, windows
from ..session import shared_dir
from ..streaming import metering, series, windows as closing
from . import bridge
from .bridge import NOW_MS, with_points, with_spans
from .sections import chats

DAY = 86_400_000
HALF = NOW_MS - 15 * DAY
PARTS = 3
RETENTION_DAYS = 5
ALWAYS = 36_500  # days: nothing expires


class Landing:
    """A folder on shared storage into which parts of a table land one after another."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4()}"
        self.part = 0

    def land(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/in/{self.part}")
        self.part += 1

    def stream(self, schema: str) -> DataFrame:
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/in")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def _parts(spark, d) -> list[DataFrame]:
    """All events in contiguous thirds of their ids; one without an id belongs to the first."""
    events = bridge.table(spark, d, "events")
    ends = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    part = F.coalesce(F.floor((F.col("event_id") - lo) * PARTS / (hi - lo + 1)), F.lit(0))
    return [events.where(part == i) for i in range(PARTS)]


def _run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def _change_feed(spark, d):
    """Every event, in three runs of one restarted query. The agent host's copies come first, its local copies a part later."""
    place = Landing(spark)
    schema = bridge.SCHEMAS["events"] + ", origin STRING"
    hosted = None
    for rows in _parts(spark, d):
        auxiliary = F.get_json_object("props", "$.k").cast("int") % 10 == 0
        landed = rows.withColumn("origin", F.when(auxiliary, "agent_host").otherwise("feed"))
        # of the agent host's events, every other one is seen again by a local source
        place.land(landed if hosted is None else landed.unionByName(hosted.where(auxiliary & (F.col("event_id") % 2 == 0)).withColumn("origin", F.lit("store"))))
        hosted = landed
        spans = bridge.spans_of(spark, place.stream(schema), "origin")
        _run(metering.usage_change_feed(metering.span_metering(spans, 0, ALWAYS), place.path("out"), place.path("state"), ALWAYS))
    return spark.read.parquet(place.path("out/ledger")).groupBy("ledger").agg(*[F.sum(c).alias(c) for c in metering.FIELDS])


def _closed_windows(spark, d):
    """Hourly windows, appended as the watermark passes them; an event a day after the last closes what is open."""
    return _closed(spark, d, lambda calls: windows.usage_windows(calls, "1 hour"))


def _closed_sessions(spark, d):
    return _closed(spark, d, lambda calls: windows.usage_sessions(calls.where("session_id IS NOT NULL"), "30 minutes"))


def _closed(spark, d, windowed):
    place = Landing(spark)
    events = bridge.table(spark, d, "events")
    place.land(events)
    after = events.agg(F.max("ts").alias("last")).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.expr("last + INTERVAL 1 DAY").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 1}').alias("props")).where("ts IS NOT NULL")
    place.land(after)
    calls = windows.timed_calls(bridge.spans_of(spark, place.stream(bridge.SCHEMAS["events"]))).withWatermark("at", "1 hour")
    _run(closing.append_closed(windowed(calls), place.path("out"), place.path("state")))
    return spark.read.parquet(place.path("out"))


def _retention(spark, d):
    """The second half of the period first, then all that is older: state that expires, and rows that come too late."""
    place = Landing(spark)
    events = bridge.table(spark, d, "events")
    newer = F.expr(f"timestampdiff(MICROSECOND, {bridge.EPOCH}, ts) div 1000") >= HALF
    told = []
    for rows in (events.where(newer), events.where(~newer)):
        place.land(rows)
        spans = bridge.spans_of(spark, place.stream(bridge.SCHEMAS["events"])).withColumn("origin", F.lit("feed"))
        told.append(closing.state_counts(_run(metering.usage_change_feed(
            metering.span_metering(spans, 0, RETENTION_DAYS), place.path("out"), place.path("state"), RETENTION_DAYS))))
    charged = spark.read.parquet(place.path("out/ledger")).agg(F.sum("requests").alias("charged"))
    return charged.select(
        "charged", F.lit(sum(t["late"] for t in told)).cast("bigint").alias("late"), F.lit(sum(t["expired"] for t in told)).cast("bigint").alias("expired"),
        F.lit(told[-1]["left"]).cast("bigint").alias("remaining"))


def _baseline(spark, d):
    """Token totals of each feed after every third; those of the first run are history, and only growth beyond them is charged."""
    place = Landing(spark)
    kind, so_far = F.col("attrs")["gen_ai.token.type"], None
    for rows in _parts(spark, d):
        so_far = rows if so_far is None else so_far.unionByName(rows)
        points = spark.sql(bridge.POINT_RULES, events=bridge.event_columns(so_far))
        used = counters.matching(counters.counter_series(points), counters.TOKEN_USAGE)
        place.land(used.groupBy("feed").agg(*[F.coalesce(F.sum(F.when(kind == c, F.col("total"))), F.lit(0.0)).cast("bigint").alias(c) for c in ("input", "output")]))
        _run(metering.baseline_feed(place.stream("feed STRING, input BIGINT, output BIGINT"), place.path("out"), place.path("state")))
    return spark.read.parquet(place.path("out/charged")).groupBy("feed").agg(F.max("input").alias("charged_input"), F.max("output").alias("charged_output"))


def _late_points(spark, d):
    place = Landing(spark)
    for rows in _parts(spark, d):
        place.land(rows.orderBy("user_id"))  # rows of a batch come in any order
        _run(series.late_feed(spark.sql(bridge.POINT_RULES, events=bridge.event_columns(place.stream(bridge.SCHEMAS["events"]))), place.path("out"), place.path("state")))
    return spark.read.parquet(place.path("out/verdicts")).where("late").select("feed", "session", "metric", "seq", "at_ms")


def _transcripts(spark, d):
    """Chats as first seen, at half their credits if they are old, and again as they are."""
    place = Landing(spark)
    now = chats(spark, d).select("session_id", "credits", "updated_ms")
    for rows in (now.where(F.col("updated_ms") < HALF).withColumn("credits", F.col("credits") / 2).withColumn("updated_ms", F.col("updated_ms") - 1), now):
        place.land(rows)
        _run(metering.transcript_growth(place.stream("session_id STRING, credits DOUBLE, updated_ms BIGINT"), place.path("out"), place.path("state")))
    grown = spark.read.schema("session_id STRING, credits DOUBLE, growth DOUBLE, kind STRING, batch BIGINT").parquet(place.path("out/growth")).where("kind = 'step'")
    return grown.groupBy("session_id").agg(F.max("credits").alias("credits"), F.sum("growth").alias("growth"))


QUERIES = {
    "usage_windows": lambda spark, d: windows.usage_windows(windows.timed_calls(bridge.spans(spark, d)), "6 hours", "2 hours", ["model"]),
    "usage_windows_tumbling": lambda spark, d: windows.usage_windows(windows.timed_calls(bridge.spans(spark, d)), "1 day"),
    "usage_windows_session": lambda spark, d: windows.usage_sessions(windows.timed_calls(bridge.spans(spark, d)), "30 minutes"),
    "usage_windows_stream": _closed_windows,
    "usage_windows_session_stream": _closed_sessions,
    "usage_change_feed": _change_feed,
    "retention_state": _retention,
    "metric_baseline_stream": _baseline,
    "late_points_stream": _late_points,
    "transcript_growth_stream": _transcripts,
}

_SUMS = """count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, count(input) AS input_calls, CAST(sum(output) AS BIGINT) AS output, count(output) AS output_calls,
  CAST(sum(nano) AS BIGINT) AS nano, count(nano) AS credit_calls"""


def _window_sql(size: int, slide: int, by: str = "") -> str:
    return with_spans(f"""
SELECT w AS window_start_ms, w + {size} AS window_end_ms{by and ', ' + by}, {_SUMS}
FROM (SELECT *, start_ms // {slide} * {slide} - i * {slide} AS w FROM spans, range(0, {size // slide}) r(i) WHERE operation = 'chat') GROUP BY ALL""")


def _session_sql(gap: int, where: str = "") -> str:
    return with_spans(f""",
cl AS (SELECT *, coalesce(start_ms - lag(start_ms) OVER (PARTITION BY session_id ORDER BY start_ms) > {gap}, TRUE)::INT AS opens FROM spans WHERE operation = 'chat'{where}),
st AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY start_ms) AS place FROM cl)
SELECT min(start_ms) AS window_start_ms, max(start_ms) + {gap} AS window_end_ms, session_id, {_SUMS} FROM st GROUP BY session_id, place""")


_THIRD = f"coalesce(floor((eid - (SELECT min(eid) FROM ev)) * {PARTS}::DOUBLE / ((SELECT max(eid) - min(eid) + 1 FROM ev))), 0)"
ORACLES = {
    "usage_windows": _window_sql(6 * 3_600_000, 2 * 3_600_000, "model"),
    "usage_windows_tumbling": _window_sql(DAY, DAY),
    "usage_windows_session": _session_sql(1_800_000),
    "usage_windows_stream": _window_sql(3_600_000, 3_600_000),
    "usage_windows_session_stream": _session_sql(1_800_000, " AND session_id IS NOT NULL"),
    "usage_change_feed": with_spans(f""",
cl AS (SELECT *, auxiliary AND NOT (ord % 2 = 0 AND third < {PARTS - 1}) AS hosted FROM (SELECT *, {_THIRD.replace('(eid -', '(ord -')} AS third FROM spans)
  WHERE operation = 'chat' AND (input IS NOT NULL OR output IS NOT NULL))
SELECT ledger, CAST(coalesce(sum(CASE WHEN counts THEN input END), 0) AS BIGINT) AS input, CAST(coalesce(sum(CASE WHEN counts THEN output END), 0) AS BIGINT) AS output,
  CAST(count(*) FILTER (counts) AS BIGINT) AS requests
FROM (SELECT *, (ledger = 'harness') = hosted AS counts FROM cl, (VALUES ('harness'), ('traces')) v(ledger)) GROUP BY ledger"""),
    "retention_state": with_spans(f""",
cl AS (SELECT start_ms, start_ms >= {HALF} AS newer FROM spans WHERE operation = 'chat' AND (input IS NOT NULL OR output IS NOT NULL)),
wm AS (SELECT max(start_ms) - {RETENTION_DAYS * DAY} AS mark FROM cl WHERE newer)
SELECT CAST(count(*) FILTER (newer) AS BIGINT) AS charged, count(*) FILTER (NOT newer AND start_ms <= mark) AS late, count(*) FILTER (newer AND start_ms <= mark) AS expired,
  count(*) FILTER (start_ms > mark) AS remaining FROM cl, wm"""),
    "metric_baseline_stream": "WITH " + bridge.EVENTS_SQL.strip() + bridge.POINTS_SQL[len(bridge.EVENTS_SQL):] + f""",
third AS (SELECT feed, {_THIRD.replace('(eid -', '(seq -')} AS part, tag, grown FROM inc WHERE metric = 'gen_ai.client.token.usage'),
tops AS (SELECT feed, p AS part, coalesce(sum(grown) FILTER (tag = 'input'), 0) AS i, coalesce(sum(grown) FILTER (tag = 'output'), 0) AS o
  FROM third, range(0, {PARTS}) r(p) WHERE third.part <= p GROUP BY 1, 2),
base AS (SELECT feed, arg_min(i, part) AS i, arg_min(o, part) AS o FROM tops GROUP BY 1)
SELECT feed, CAST(max(t.i - b.i) AS BIGINT) AS charged_input, CAST(max(t.o - b.o) AS BIGINT) AS charged_output FROM tops t JOIN base b USING (feed) GROUP BY 1""",
    "late_points_stream": with_points(" SELECT feed, session, metric, seq, at_ms FROM marked WHERE late"),
    "transcript_growth_stream": "WITH " + bridge.REQUESTS_SQL.strip() + f""",
ch AS (SELECT session_id, credits, {", ".join(bridge.CHAT_COLUMNS)} FROM cost)
SELECT session_id, coalesce(credits, 0.0) AS credits, CASE WHEN updated_ms < {HALF} THEN coalesce(credits - credits / 2, 0.0) ELSE 0.0 END AS growth FROM ch""",
}
