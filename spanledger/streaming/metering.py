"""Metering of model calls and of transcript credits from streams.

High-water marks of calls are a streaming aggregation; what was charged before is
a table beside the stream (`carried`). Replays and late larger copies of a span
charge only the growth of its mark. `retention` ties both to event time: the
watermark drops the aggregation's older state and counts older rows, and folds of
the table keep no older span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from .carried import Carried

DAY_MS = 86_400_000
FIELDS = ("input", "output", "requests")


def span_metering(spans: DataFrame, since_ms: int, retention_days: int = 7) -> DataFrame:
    """Growing marks (span_id, at, input, output, local) of model calls, in update mode.

    spans: span_id, operation, start_ms, input, output, origin (feed, store, agent_host).
    """
    usable = (F.col("operation") == "chat") & (F.col("start_ms") >= since_ms) & F.coalesce("input", "output").isNotNull()
    calls = spans.where(usable).select("span_id", F.timestamp_millis("start_ms").alias("at"), "input", "output", (F.col("origin") != "agent_host").alias("local"))
    return calls.withWatermark("at", f"{retention_days} days").groupBy("span_id", "at").agg(
        F.max("input").alias("input"), F.max("output").alias("output"), F.max("local").alias("local"))


def charges(marks: DataFrame, before: DataFrame) -> DataFrame:
    """What each span adds to its ledger and moves from harness to traces. before: span_id, at_ms, top_input, top_output, local."""
    now = marks.groupBy("span_id").agg(
        F.max(F.unix_millis("at")).alias("at_ms"), F.coalesce(F.max("input"), F.lit(0)).alias("input"),
        F.coalesce(F.max("output"), F.lit(0)).alias("output"), F.max("local").alias("local"))
    old = before.select("span_id", *[F.col(c).alias(f"old_{c}") for c in ("at_ms", "top_input", "top_output", "local")])
    joined = now.join(old, "span_id", "left")
    known = F.col("old_local").isNotNull()
    local = F.col("local") | F.coalesce("old_local", F.lit(False))
    moving = known & ~F.col("old_local") & local
    was = {c: F.coalesce(f"old_top_{c}", F.lit(0)) for c in ("input", "output")}
    top = {c: F.greatest(c, was[c]) for c in ("input", "output")}
    return joined.select(
        "span_id", F.greatest("at_ms", "old_at_ms").alias("at_ms"), top["input"].alias("top_input"), top["output"].alias("top_output"), local.alias("local"),
        F.when(local, "traces").otherwise("harness").alias("ledger"), *[(top[c] - was[c]).alias(c) for c in ("input", "output")],
        F.when(known, 0).otherwise(1).cast("bigint").alias("requests"),
        *[F.when(moving, was[c]).otherwise(0).alias(f"moved_{c}") for c in ("input", "output")], moving.cast("bigint").alias("moved_requests"))


def ledger_rows(charged: DataFrame) -> DataFrame:
    """Signed ledger rows of charges: a move enters traces and leaves harness."""
    own = F.struct(F.col("ledger").alias("ledger"), *[F.col(c).alias(c) for c in FIELDS])
    into = F.struct(F.lit("traces").alias("ledger"), *[F.col(f"moved_{c}").alias(c) for c in FIELDS])
    out = F.struct(F.lit("harness").alias("ledger"), *[(-F.col(f"moved_{c}")).alias(c) for c in FIELDS])
    moved = F.when(F.col("moved_requests") > 0, F.array(into, out)).otherwise(F.array().cast("array<struct<ledger:string,input:bigint,output:bigint,requests:bigint>>"))
    return charged.select(F.explode(F.concat(F.array(own), moved)).alias("r")).select("r.*")


def marks_table(spark, out: str) -> Carried:
    return Carried(spark, f"{out}/marks", "span_id STRING, at_ms BIGINT, top_input BIGINT, top_output BIGINT, local BOOLEAN", ["span_id"],
                   {"at_ms": F.max("at_ms"), "top_input": F.max("top_input"), "top_output": F.max("top_output"), "local": F.max("local")})


def usage_change_feed(marks: DataFrame, out: str, checkpoint: str, retention_days: int = 7) -> StreamingQuery:
    """Append each micro-batch's ledger changes under `ledger/batch=<id>`; readers sum them with `meter_totals`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        state = marks_table(batch.sparkSession, out)
        # the batch is read once: every reading would run its stateful part again
        charged = state.step(batch_id, charges(batch, state.before(batch_id)), "at_ms", retention_days * DAY_MS)
        changes = ledger_rows(charged).groupBy("ledger").agg(*[F.sum(c).cast("bigint").alias(c) for c in FIELDS])
        changes.write.mode("overwrite").parquet(f"{out}/ledger/batch={batch_id}")

    return marks.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def credit_growth(sessions: DataFrame, before: DataFrame) -> DataFrame:
    """(session_id, credits, growth): highest credits so far, and what they grew by.

    First sight is a baseline. An observed session without credits counts as 0, so its first report counts in full.
    """
    now = sessions.groupBy("session_id").agg(F.max("credits").alias("top"), F.min_by(F.struct("credits"), "updated_ms").alias("first"))
    joined = now.join(before.select("session_id", F.col("credits").alias("old")), "session_id", "left")
    base = F.coalesce("old", "first.credits", F.lit(0.0))
    highest = F.greatest(base, F.col("top"))
    return joined.select("session_id", highest.alias("credits"), (highest - base).alias("growth"))


def transcript_growth(sessions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Credits growth per session and micro-batch under `growth`. sessions: session_id, credits, updated_ms."""
    def write(batch: DataFrame, batch_id: int) -> None:
        state = Carried(batch.sparkSession, f"{out}/growth", "session_id STRING, credits DOUBLE, growth DOUBLE", ["session_id"], {"credits": F.max("credits")})
        state.step(batch_id, credit_growth(batch, state.before(batch_id)))

    return sessions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def baseline_feed(totals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Charge what each feed's totals grow beyond those of its first sight. totals: feed, input, output.

    The first batch that sees a feed writes its baseline once, as a version of its own; later batches join the
    baselines and never lower or raise them. `charged` holds amounts since the baseline per batch, to be read by maximum.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = Carried(batch.sparkSession, f"{out}/baseline", "feed STRING, input BIGINT, output BIGINT", ["feed"], {c: F.min(c) for c in ("input", "output")})
        now = batch.persist()
        known = table.before(batch_id)
        table.step(batch_id, now.join(known, "feed", "left_anti"))
        base = table.before(batch_id + 1).select("feed", *[F.col(c).alias(f"base_{c}") for c in ("input", "output")])
        charged = now.join(base, "feed").select("feed", *[F.greatest(F.lit(0), F.col(c) - F.col(f"base_{c}")).alias(c) for c in ("input", "output")])
        charged.write.mode("overwrite").parquet(f"{out}/charged/batch={batch_id}")
        now.unpersist()

    grown = totals.groupBy("feed").agg(F.max("input").alias("input"), F.max("output").alias("output"))
    return grown.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
