"""Chat transcripts on disk: JSONL mutation logs, single JSON documents, and the history index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import json as j
from ..functions.names import clean_title
from ..functions.values import let, nonnegative
from .once import computed_once

# Record field and the name it is kept under.
REQUEST_FIELDS = {"modelId": "model", "copilotCredits": "credits", "sessionCopilotCredits": "session_credits"}


def transcript_scan(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, seq, line, updated_ms): log lines; a JSON document counts as one snapshot line.

    A `.json` next to a `.jsonl` of the same name is an older copy and is left out.
    """
    meta = [
        F.regexp_replace("_metadata.file_path", r"\.jsonl?$", "").alias("file_id"),
        F.unix_millis("_metadata.file_modification_time").alias("updated_ms"),
    ]
    row = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    logs = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path).select(
        *meta, row.alias("seq"), F.col("value").alias("line"))
    whole = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        *meta, F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit('{"kind":0,"v":'), F.col("value"), F.lit("}")).alias("line"))
    return logs.unionByName(whole.join(logs.select("file_id").distinct(), "file_id", "left_anti"))


def _string(v: Column, *names: str) -> Column:
    return let(j.item(v, *names), j.string_of)


def _request(v: Column, off: Column) -> Column:
    """One written request slot; bad values are unreported."""
    return F.struct(
        off.cast("bigint").alias("off"), F.lit(True).alias("whole"), F.lit(None).cast("string").alias("field"),
        j.text(v, "modelId").alias("model"), nonnegative(j.number(v, "copilotCredits")).alias("credits"),
        nonnegative(j.number(v, "sessionCopilotCredits")).alias("session_credits"),
    )


def parse_ops(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ops, headers) of log lines keyed by session_id (the file), with unreadable lines as op `bad`."""
    kept = lines.where(F.trim("line") != "").select(F.col("file_id").alias("session_id"), "seq", "line")
    parsed = computed_once(kept, r=F.try_parse_json("line")).drop("line")
    r, v, path = F.col("r"), F.col("v"), F.col("path")

    def whole_number(d: Column) -> Column:
        return let(d, lambda x: F.when(x == F.floor(x), x.cast("bigint")))

    def step(i: int) -> Column:
        return F.get(path, F.lit(i))

    def listed(found: Column) -> Column:
        return F.when(j.kind_of(found).startswith("ARRAY"), F.try_variant_get(found, "$", "array<variant>"))

    heads = computed_once(
        parsed, kind=j.number(r, "kind"), v=j.item(r, "v"), path=F.try_variant_get(r, "$.k", "array<variant>"),
        given_i=j.item(r, "i").isNotNull(), i=j.number(r, "i"))
    rows = computed_once(
        heads, depth=F.coalesce(F.size("path"), F.lit(0)), root=j.string_of(step(0)), slot=j.number(step(1)),
        field=j.string_of(step(2)), deletes=F.coalesce(F.col("kind") == 3, F.lit(False)))
    kind, depth, field = F.col("kind"), F.col("depth"), F.col("field")
    deletes, snapshot = F.col("deletes"), F.coalesce(kind == 0, F.lit(False))
    on_requests = F.coalesce(F.col("root") == "requests", F.lit(False)) & ~snapshot
    op = (
        F.when(F.coalesce(~j.kind_of(r).rlike("^(OBJECT|ARRAY)"), F.lit(True)), F.lit("bad"))
        .when(snapshot, F.lit("reset"))
        .when(on_requests & (depth == 1) & (kind == 2), F.when(F.col("given_i"), F.lit("splice")).otherwise(F.lit("push")))
        .when(on_requests & (depth == 1) & kind.isin(1, 3), F.lit("reset"))
        .when(on_requests & ((depth == 2) | ((depth == 3) & field.isin(*REQUEST_FIELDS))), F.lit("set"))
        .when(on_requests & (depth > 1), F.lit("check"))
    )
    empty = F.array().cast("array<variant>")
    written = F.when(deletes, empty).otherwise(F.coalesce(let(F.when(snapshot, j.item(v, "requests")).otherwise(v), listed), empty))
    index = F.when(F.col("op") == "splice", F.col("i")).when(F.col("op").isin("set", "check"), F.col("slot"))
    staged = computed_once(rows, op=op).where(F.col("op").isNotNull()).select(
        "session_id", "seq", "op", "v", "depth", "field", "deletes", whole_number(index).alias("idx"),
        F.when(F.col("op").isin("reset", "push", "splice"), written).alias("written"),
    )

    def own(name: str, value: Column) -> Column:
        return F.when(~deletes & (field == name), value)

    one_field = F.struct(
        F.lit(0).cast("bigint").alias("off"), F.lit(False).alias("whole"),
        F.coalesce(*[F.when(field == k, F.lit(n)) for k, n in REQUEST_FIELDS.items()]).alias("field"),
        own("modelId", j.text(v)).alias("model"), own("copilotCredits", nonnegative(j.number(v))).alias("credits"),
        own("sessionCopilotCredits", nonnegative(j.number(v))).alias("session_credits"),
    )
    slot = _request(F.when(deletes | v.isNull(), F.parse_json(F.lit("{}"))).otherwise(v), F.lit(0))
    ops = staged.select(
        "session_id", "seq", "op", "idx", F.coalesce(F.size("written"), F.lit(0)).cast("bigint").alias("n"),
        F.when((F.col("op") == "set") & (depth == 3), F.array(one_field)).when(F.col("op") == "set", F.array(slot))
        .when(F.col("written").isNotNull(), F.transform("written", _request)).alias("slots"),
    )
    named = (depth == 1) & (F.col("root") == "customTitle")
    title = F.when(snapshot, _string(v, "customTitle")).when(~deletes, j.string_of(v))
    headers = rows.where(snapshot | F.coalesce(named, F.lit(False))).select(
        "session_id", "seq", F.lit(True).alias("touches_title"), clean_title(title).alias("title"))
    return ops, headers


def history_index_scan(blobs: DataFrame) -> DataFrame:
    """Sessions of chat-history index blobs (source, value). Only version 1 is readable.

    An entry counts when its activity time is a number >= 0; its own id wins over the map key.
    """
    parsed = computed_once(blobs.select("source", "value"), i=F.try_parse_json("value")).where(j.number(F.col("i"), "version") == 1)
    entries = parsed.select("source", F.explode(F.try_variant_get("i", "$.entries", "map<string,variant>")).alias("id", "e"))
    e = F.col("e")
    return entries.select(
        "source", F.coalesce(_string(e, "sessionId"), F.col("id")).alias("session_id"),
        clean_title(_string(e, "title")).alias("title"), nonnegative(j.number(e, "lastMessageDate")).cast("bigint").alias("updated_ms"),
    ).where(F.col("updated_ms").isNotNull())


def index_status(blobs: DataFrame) -> DataFrame:
    """(source, status): ok, unsupported version, or malformed."""
    i = F.try_parse_json("value")
    return blobs.select(
        "source",
        F.when(i.isNull(), F.lit("malformed"))
        .when((j.number(i, "version") == 1) & j.kind_of(j.item(i, "entries")).startswith("OBJECT"), F.lit("ok"))
        .otherwise(F.lit("unsupported")).alias("status"),
    )
