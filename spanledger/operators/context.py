"""Time-correct attribution of model calls to the latest agent context.

A call asks, in order, its session, conversation, parent session and trace for
the latest agent span at or before its own start. Conversation and trace are
weak keys: an entry that names a different native chat must be skipped. Both
sides become keyed rows of one union; weak keys get one bucket per native chat,
so a running "last entry" per key answers every call without a range join. The
scan carries work (repository, branch) and identity (user, actor) together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scan import HOT_ROWS, Prefix, prefix_scan

NO_CHAT = "~"
WORK = ["repository", "branch"]
ACTOR = ["user_name", "actor_id", "user_source"]


def _key(kind: str, value: Column, bucket: Column | None = None) -> Column:
    parts = [F.lit(kind), value] + ([bucket] if bucket is not None else [])
    return F.when(value.isNotNull(), F.concat_ws("\x01", *parts))


def _rows(df: DataFrame, keyed: list[tuple[int, Column]], keep: list[Column]) -> DataFrame:
    """One row per (priority, key); each entry of `keyed` is an array of keys."""
    def ranked(pri: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(pri).alias("pri"), k.alias("key")))

    pairs = F.concat(*[ranked(pri, keys) for pri, keys in keyed])
    return df.select(*keep, F.explode(pairs).alias("_pk")).select(
        "*", F.col("_pk.pri").alias("pri"), F.col("_pk.key").alias("key")
    ).drop("_pk").where(F.col("key").isNotNull())


def agent_entries(spans: DataFrame) -> DataFrame:
    work = F.when(F.coalesce(*WORK).isNotNull(), F.struct("start_ms", "ord", *WORK))
    actor = F.when(F.coalesce(F.col("user_name"), F.col("actor_id")).isNotNull(), F.struct("start_ms", "ord", *ACTOR))
    chat = F.coalesce(F.col("native_session_id"), F.lit(NO_CHAT))
    agents = spans.where(
        (F.col("operation") == "invoke_agent") & F.coalesce(*WORK, F.col("user_name"), F.col("actor_id")).isNotNull()
    )
    keyed = [(0, F.array(
        _key("S", F.col("session_id")),
        _key("C", F.col("conversation_id"), chat), _key("CA", F.col("conversation_id")),
        _key("T", F.col("trace_id"), chat), _key("TA", F.col("trace_id")),
    ))]
    return _rows(agents, keyed, [
        F.col("start_ms"), F.lit(0).alias("is_call"), F.col("ord"), F.lit(None).cast("string").alias("span_id"),
        work.alias("work"), actor.alias("actor"),
    ])


def call_probes(spans: DataFrame) -> DataFrame:
    calls = spans.where(F.col("operation") == "chat")
    chats = F.array_distinct(F.filter(
        F.array(F.lit(NO_CHAT), F.col("native_session_id"), F.col("parent_session_id")), lambda c: c.isNotNull()
    ))

    def weak(kind: str, column: str) -> Column:
        value = F.col(column)
        return F.when(F.col("native_session_id").isNull(), F.array(_key(kind + "A", value))).otherwise(
            F.transform(chats, lambda c: _key(kind, value, c))
        )

    keyed = [
        (1, F.array(_key("S", F.col("session_id")))), (2, weak("C", "conversation_id")),
        (3, F.array(_key("S", F.col("parent_session_id")))), (4, weak("T", "trace_id")),
    ]
    return _rows(calls, keyed, [F.col("start_ms"), F.lit(1).alias("is_call"), F.col("ord"), F.col("span_id")])


def context_asof(spans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(span_id, work, actor) for every call that matched at least one key.

    `spans` holds one row per id. The first key with an entry decides, even when
    that entry's repository is NULL.
    """
    timeline = agent_entries(spans).unionByName(call_probes(spans), allowMissingColumns=True)
    scanned = prefix_scan(
        timeline, ["key"], ["start_ms", "is_call", "ord"],
        {"work_at": Prefix("last", F.col("work")), "actor_at": Prefix("last", F.col("actor"))}, hot_rows,
    ).where(F.col("is_call") == 1)

    def newest(column: str, pri: int) -> Column:
        return F.max(F.when(F.col("pri") == pri, F.col(column)))

    found = scanned.where(F.col("work_at").isNotNull() | F.col("actor_at").isNotNull())
    return found.groupBy("span_id").agg(
        F.coalesce(*[newest("work_at", p) for p in (1, 2, 3, 4)]).alias("work"),
        F.coalesce(*[newest("actor_at", p) for p in (1, 2, 3, 4)]).alias("actor"),
    )


def attributed_calls(spans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Chat spans with inherited work and identity.

    `user_by` keeps the provenance of the winning user; the analytics pseudonym
    (`actor_by`) stays separate and never becomes a user.
    """
    calls = spans.where(F.col("operation") == "chat")
    context = context_asof(spans, hot_rows)
    own = F.col("user_name").isNotNull()
    return calls.join(context, "span_id", "left").select(
        *calls.columns,
        F.col("work.repository").alias("work_repository"), F.col("work.branch").alias("work_branch"),
        F.coalesce(F.col("user_name"), F.col("actor.user_name")).alias("user_by"),
        F.when(own, F.col("user_source")).otherwise(F.col("actor.user_source")).alias("user_by_source"),
        F.coalesce(F.col("actor_id"), F.col("actor.actor_id")).alias("actor_by"),
    )
