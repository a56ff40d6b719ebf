"""The telemetry feed: JSON lines holding metric exports, log events and spans.

Content is dropped here: only listed fields are ever selected from a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import json as j
from ..functions.names import endpoint_host, identity_name, repository_name
from ..functions.parsing import reasoning_effort
from ..functions.values import hr_to_ms, nonnegative, short_text, span_failed, token_count
from .once import computed_once

TOKEN_USAGE = "gen_ai.client.token.usage"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(feed, seq, line). Feeds are directories of rotated segments, `<feed>/<n>.jsonl`.

    seq holds segment number, byte block and row order inside the block as
    fields that order by themselves; nothing is packed into one number.
    """
    row = F.monotonically_increasing_id()
    segment = F.coalesce(F.regexp_extract("_metadata.file_name", r"(\d+)\D*$", 1).try_cast("bigint"), F.lit(0))
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("feed"),
        F.struct(segment.alias("segment"), F.col("_metadata.file_block_start").alias("block"), row.alias("row")).alias("seq"), F.col("value").alias("line"),
    )


KIND_FIELDS = ["scopeMetrics", "spanId", "startTime", "endTime", "attributes", "_body", "body"]


def classify(record: Column) -> Column:
    """Structural kind of the `KIND_FIELDS` of a parsed, non-empty object. Containers are tested by cast, not by describing their schema."""
    logged = j.is_present(record["attributes"]) | j.is_present(record["_body"]) | j.is_present(record["body"])
    return (
        F.when(F.try_variant_get(record["scopeMetrics"], "$", "array<variant>").isNotNull(), F.lit("metrics"))
        .when(j.text_of(record["spanId"]).isNotNull() & j.is_truthy(record["startTime"]) & j.is_truthy(record["endTime"]), F.lit("span"))
        .when(logged, F.lit("log")).otherwise(F.lit("unknown"))
    )


def feed_scan(lines: DataFrame) -> DataFrame:
    """Input columns plus kind and record. Lines that do not open an object are `ignored`; `{}` needs no parsing."""
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    text = computed_once(lines, text=trimmed)
    t = F.col("text")
    empty = t.rlike(r"^\{\s*\}$")
    parsed = computed_once(text, record=F.when(t.startswith("{") & ~empty, F.try_parse_json(t)))
    found = computed_once(parsed, found=j.fields(F.col("record"), *KIND_FIELDS))
    kind = (
        F.when(~t.startswith("{"), F.lit("ignored")).when(empty, F.lit("span")).when(F.col("record").isNull(), F.lit("malformed"))
        .otherwise(F.coalesce(classify(F.col("found")), F.lit("unknown")))
    )
    return computed_once(found, kind=kind).drop("line", "text", "found")


def metric_points(records: DataFrame) -> DataFrame:
    """One row per data point: feed, rec, seq, session, metric, attrs, start_ms, at_ms, value or histogram columns."""
    metrics = (
        records.where(F.col("kind") == "metrics")
        .select("feed", F.col("seq").alias("rec"), F.coalesce(j.resource_attribute(F.col("record"), "session.id"), F.lit("")).alias("session"),
                F.posexplode(F.try_variant_get("record", "$.scopeMetrics", "array<variant>")).alias("spos", "scope"))
        .select("feed", "rec", "session", "spos", F.posexplode(F.try_variant_get("scope", "$.metrics", "array<variant>")).alias("mpos", "m"))
        .select("feed", "rec", "session", "spos", "mpos", j.text(F.col("m"), "descriptor", "name").alias("metric"),
                F.try_variant_get("m", "$.dataPoints", "array<variant>").alias("points"))
    )
    points = metrics.where(F.col("metric") != "").select("feed", "rec", "session", "metric", "spos", "mpos", F.posexplode("points").alias("ppos", "p"))
    found = computed_once(points, f=j.fields(F.col("p"), "attributes", "startTime", "endTime", "value"))
    value = F.col("f")["value"]
    read = computed_once(
        found, attrs=F.coalesce(j.redacted_attributes(F.col("f")["attributes"]), F.create_map().cast("map<string,string>")), own=value,
        v=j.fields(value, "sum", "count", buckets=["boundaries", "counts"]),
    )
    own, v = F.col("own"), F.col("v")
    boundaries, counts = v["buckets"]["boundaries"], v["buckets"]["counts"]
    listed = boundaries.isNotNull() & counts.isNotNull()
    return read.select(
        "feed", "rec", F.struct("rec", "spos", "mpos", "ppos").alias("seq"), "session", "metric",
        F.map_filter("attrs", lambda k, v: v.isNotNull()).alias("attrs"), j.clock_of(F.col("f")["startTime"]).alias("start_ms"), j.clock_of(F.col("f")["endTime"]).alias("at_ms"),
        F.coalesce(v["sum"].isNotNull(), F.lit(False)).alias("is_hist"), j.number_of(own).alias("value"),
        j.number_of(v["sum"]).alias("h_sum"), j.number_of(v["count"]).alias("h_count"),
        F.when(listed, F.try_variant_get(boundaries, "$", "array<double>")).alias("boundaries"),
        F.when(listed, F.try_variant_get(counts, "$", "array<double>")).alias("counts"),
    )


def log_events(records: DataFrame) -> DataFrame:
    """(feed, seq, name, time_ms, attributes VARIANT) of named log records."""
    read = _log_fields(records.where(F.col("kind") == "log"))
    return read.select("feed", "seq", *_name_and_time(), F.col("f")["attributes"].alias("attributes")).where(F.col("name") != "")


LOG_CLOCKS = ["_hrTime", "hrTime", "_hrTimeObserved"]


def _log_fields(records: DataFrame) -> DataFrame:
    found = computed_once(records, f=F.when(F.col("kind") == "log", j.fields(F.col("record"), "_body", "body", "attributes", *LOG_CLOCKS)))
    return computed_once(found, given=j.item(F.col("f")["attributes"], "event.name"))


def _name_and_time() -> list[Column]:
    f, given = F.col("f"), F.col("given")
    body = F.coalesce(j.text_of(f["_body"]), j.text_of(f["body"]))
    name = F.when(j.kind_of(given) == "STRING", j.text_of(given)).otherwise(body)
    time = F.coalesce(*[F.when(~F.coalesce(j.kind_of(f[c]) == "VOID", F.lit(True)), j.clock_of(f[c])) for c in LOG_CLOCKS], F.lit(0.0))
    return [name.alias("name"), time.alias("time_ms")]


def record_stats(records: DataFrame, points: DataFrame, events: DataFrame) -> DataFrame:
    """Per feed: records by kind, last record time and last token-usage time (0 = never)."""
    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(kind)

    kinds = records.groupBy("feed").agg(*[count(k) for k in ("metrics", "log", "span", "unknown", "malformed", "ignored")])
    last = points.groupBy("feed").agg(
        F.max("at_ms").alias("m"), F.max(F.when(F.col("metric") == TOKEN_USAGE, F.col("at_ms"))).alias("t"))
    said = events.groupBy("feed").agg(F.max("time_ms").alias("e"))
    return kinds.join(last, "feed", "left").join(said, "feed", "left").select(
        *kinds.columns, F.coalesce(F.greatest("m", "e"), F.lit(0.0)).cast("bigint").alias("last_record_ms"),
        F.coalesce("t", F.lit(0.0)).cast("bigint").alias("last_token_usage_ms"),
    )


def feed_stats(records: DataFrame) -> DataFrame:
    """`record_stats` in one pass over the records, so that each is parsed once."""
    name, time = _name_and_time()
    scopes = F.when(F.col("kind") == "metrics", F.try_variant_get("record", "$.scopeMetrics", "array<variant>"))
    said = _log_fields(records).select("feed", "kind", F.when(F.col("kind") == "log", name).alias("name"), time.alias("time_ms"), F.posexplode_outer(scopes).alias("spos", "scope"))
    metrics = said.select("feed", "kind", "name", "time_ms", "spos", F.posexplode_outer(F.try_variant_get("scope", "$.metrics", "array<variant>")).alias("mpos", "m"))
    points = computed_once(
        metrics, metric=j.text_of(j.item(F.col("m"), "descriptor", "name")), points=F.try_variant_get("m", "$.dataPoints", "array<variant>"),
    ).select("feed", "kind", "name", "time_ms", "spos", "mpos", "metric", F.posexplode_outer("points").alias("ppos", "p"))
    read = computed_once(points, at_ms=F.when((F.col("metric") != "") & F.col("ppos").isNotNull(), j.clock(F.col("p"), "endTime")))
    # of the rows that a record became
    first = (F.coalesce("spos", F.lit(0)) == 0) & (F.coalesce("mpos", F.lit(0)) == 0) & (F.coalesce("ppos", F.lit(0)) == 0)
    kinds = ["metrics", "log", "span", "unknown", "malformed", "ignored"]
    per_feed = read.groupBy("feed").agg(
        *[F.count_if(first & (F.col("kind") == k)).alias(k) for k in kinds], F.max("at_ms").alias("m"),
        F.max(F.when(F.col("metric") == TOKEN_USAGE, F.col("at_ms"))).alias("t"), F.max(F.when(F.col("name") != "", F.col("time_ms"))).alias("e"))
    return per_feed.select(
        "feed", *kinds, F.coalesce(F.greatest("m", "e"), F.lit(0.0)).cast("bigint").alias("last_record_ms"),
        F.coalesce("t", F.lit(0.0)).cast("bigint").alias("last_token_usage_ms"),
    )


def span_columns(read_text, read_number, operation: Column) -> list[Column]:
    """Canonical span columns from attribute readers; aliases are chosen by order, never added."""
    native = short_text(read_text("copilot_chat.chat_session_id"))
    conversation = short_text(read_text("gen_ai.conversation.id"))
    chat = operation == "chat"

    def count(*names: str) -> Column:
        return F.coalesce(*[token_count(read_number(n)) for n in names])

    def words(*names: str) -> Column:
        return F.coalesce(*[short_text(read_text(n)) for n in names])

    nano, sdk_nano = read_number("copilot_chat.copilot_usage_nano_aiu"), read_number("github.copilot.nano_aiu")
    return [
        F.coalesce(native, conversation).alias("session_id"), native.alias("native_session_id"), conversation.alias("conversation_id"),
        words("gen_ai.response.model", "gen_ai.request.model").alias("model"),
        count("gen_ai.usage.input_tokens").alias("input"), count("gen_ai.usage.output_tokens").alias("output"),
        count("gen_ai.usage.cache_read.input_tokens").alias("cached"),
        count("gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write.input_tokens").alias("cache_write"),
        count("gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens").alias("reasoning"),
        nonnegative(nano).cast("decimal(20,0)").cast("bigint").alias("nano"),
        (sdk_nano.isNotNull() | read_number("github.copilot.cost").isNotNull()).alias("sdk"),
        nonnegative(sdk_nano).cast("decimal(20,0)").cast("bigint").alias("sdk_nano"),
        nonnegative(read_number("copilot_chat.time_to_first_token")).alias("ttft_ms"),
        nonnegative(read_number("gen_ai.response.time_to_first_chunk") * 1000).alias("first_chunk_ms"),
        count("copilot_chat.turn_count", "github.copilot.turn_count").alias("turns"),
        words("gen_ai.tool.name").alias("tool"),
        nonnegative(read_number("copilot_chat.request.max_prompt_tokens")).alias("prompt_limit"),
        F.coalesce((read_text("copilot_chat.parent_chat_session_id") != "") | (read_text("copilot_chat.debug_log_label") != ""),
                   read_text("copilot_chat.parent_chat_session_id") != "", read_text("copilot_chat.debug_log_label") != "",
                   F.lit(False)).alias("auxiliary"),
        words("gen_ai.agent.name").alias("agent"), words("copilot_chat.parent_chat_session_id").alias("parent_session_id"),
        F.when(chat, reasoning_effort(read_text("copilot_chat.request.options"), read_text("gen_ai.request.reasoning.level"))).alias("effort"),
        F.coalesce(repository_name(read_text("github.copilot.git.repository")),
                   repository_name(read_text("copilot_chat.repo.remote_url"))).alias("repository"),
        words("github.copilot.git.branch", "copilot_chat.repo.head_branch_name").alias("branch"),
        identity_name(read_text("user.name")).alias("user_name"), identity_name(read_text("enduser.pseudo.id")).alias("actor_id"),
        F.when(chat, endpoint_host(read_text("server.address"))).alias("host"),
    ]


#: Attributes that `span_columns` reads as text and as numbers.
SPAN_TEXTS = [
    "gen_ai.operation.name", "copilot_chat.chat_session_id", "gen_ai.conversation.id", "gen_ai.response.model", "gen_ai.request.model", "gen_ai.tool.name",
    "copilot_chat.parent_chat_session_id", "copilot_chat.debug_log_label", "gen_ai.agent.name", "copilot_chat.request.options", "gen_ai.request.reasoning.level",
    "github.copilot.git.repository", "copilot_chat.repo.remote_url", "github.copilot.git.branch", "copilot_chat.repo.head_branch_name", "user.name", "enduser.pseudo.id",
    "server.address",
]
SPAN_NUMBERS = [
    "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_creation.input_tokens",
    "gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens", "copilot_chat.copilot_usage_nano_aiu",
    "github.copilot.nano_aiu", "github.copilot.cost", "copilot_chat.time_to_first_token", "gen_ai.response.time_to_first_chunk", "copilot_chat.turn_count",
    "github.copilot.turn_count", "copilot_chat.request.max_prompt_tokens",
]
SPAN_FIELDS = ["spanId", "traceId", "parentSpanId", "parentSpanContext", "startTime", "endTime", "ended", "status", "resource"]


def file_spans(records: DataFrame) -> DataFrame:
    """Canonical spans of the feed. The span's own user wins over a configured resource user.

    The members of a record are found in one pass, each is read once, and the rules work on plain columns.
    """
    f = F.col("f")
    found = computed_once(
        records.where(F.col("kind") == "span"), f=j.fields(F.col("record"), *SPAN_FIELDS, attributes=[*SPAN_TEXTS, *SPAN_NUMBERS]),
    ).where(
        f["attributes"].isNotNull()
        & ~F.coalesce((j.kind_of(f["ended"]) == "BOOLEAN") & ~F.try_variant_get(f["ended"], "$", "boolean"), F.lit(False))
    )
    a = f["attributes"]
    ids = {"span": f["spanId"], "trace": f["traceId"], "parent": f["parentSpanId"], "context": j.item(f["parentSpanContext"], "spanId")}
    own_user = j.is_present(a.getField("user.name"))
    read = computed_once(
        found,
        **{f"id_{n}": j.text_of(v) for n, v in ids.items()}, **{f"no_{n}": j.is_absent(v) for n, v in ids.items()}, no_parent_context=j.is_absent(f["parentSpanContext"]),
        start_hr=F.try_variant_get(f["startTime"], "$", "array<double>"), end_hr=F.try_variant_get(f["endTime"], "$", "array<double>"),
        **{f"t_{i}": j.text_of(a.getField(n)) for i, n in enumerate(SPAN_TEXTS)}, **{f"n_{i}": j.number_of(a.getField(n)) for i, n in enumerate(SPAN_NUMBERS)},
        code=F.try_variant_get(f["status"], "$.code", "string"), own=own_user, resource_user=F.when(~own_user, j.attribute_of(f["resource"], "user.name")),
    )

    def read_text(name: str) -> Column:
        own = F.col(f"t_{SPAN_TEXTS.index(name)}")
        return F.when(F.col("own"), own).otherwise(F.col("resource_user")) if name == "user.name" else own

    def read_number(name: str) -> Column:
        return F.col(f"n_{SPAN_NUMBERS.index(name)}")

    operation = short_text(read_text("gen_ai.operation.name"))
    out = read.select(
        short_text(F.col("id_span")).alias("span_id"), F.col("seq").alias("ord"), operation.alias("operation"),
        short_text(F.col("id_trace")).alias("trace_id"), short_text(F.coalesce("id_parent", "id_context")).alias("parent_span_id"),
        ((F.col("no_parent_context") | short_text(F.col("id_context")).isNotNull()) & (F.col("no_parent") | short_text(F.col("id_parent")).isNotNull())).alias("parent_known"),
        F.coalesce(hr_to_ms(F.col("start_hr")), F.lit(0.0)).alias("start_ms"), F.coalesce(hr_to_ms(F.col("end_hr")), F.lit(0.0)).alias("end_ms"),
        *span_columns(read_text, read_number, operation),
        span_failed(F.col("code")).alias("failed"), F.col("own").alias("_own"),
    )
    source = F.when(F.col("user_name").isNotNull(), F.when(F.col("_own"), F.lit("span")).otherwise(F.lit("resource")))
    return valid_spans(out.withColumn("user_source", source).drop("_own"))


def valid_spans(spans: DataFrame) -> DataFrame:
    """Usable spans: an id, an operation, a positive start and no end before it."""
    return spans.where(
        F.col("span_id").isNotNull() & F.col("operation").isNotNull() & (F.col("start_ms") > 0) & (F.col("end_ms") >= F.col("start_ms"))
    )
