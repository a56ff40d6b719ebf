"""Attribution coverage: how far usage can be followed from a call to a pull request.

Calls: session_key (counts sessions; NULL for trace-only links), linked (any
correlation key), nano, input, cached, repository, branch, has_work_ref, has_pr,
user, sub_agent, effort, link, at_ms, day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import DAY_MS, NANO, credit_sum, utc_day

STAGES = ["observed", "session", "repository", "branch", "workRef", "pullRequest"]
NO_KEY = "(none)"


def _credits(nano: Column) -> Column:
    return nano.cast("double") / F.lit(float(NANO))


def coverage_funnel(calls: DataFrame, emits_refs: bool) -> DataFrame:
    """(stage, emitted, sessions, calls, credits); a stage keeps only calls that passed all earlier ones.

    Each call's depth is counted per session first, so sessions per stage need
    no distinct over calls; the rest works on at most six rows.
    """
    flags = [F.lit(True), F.col("linked"), F.col("repository").isNotNull(), F.col("branch").isNotNull(),
             F.coalesce("has_work_ref", F.lit(False)), F.coalesce("has_pr", F.lit(False))]
    depth, upto = F.lit(0), F.lit(True)
    for f in flags[1:]:
        upto = upto & f
        depth = depth + upto.cast("int")
    cells = calls.groupBy("session_key", depth.alias("depth")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("nano").cast("decimal(20,0)")).alias("nano"))
    by_calls = cells.groupBy("depth").agg(F.sum("calls").alias("calls"), F.sum("nano").alias("nano"), F.lit(0).cast("bigint").alias("sessions"))
    reach = cells.where(F.col("session_key").isNotNull()).groupBy("session_key").agg(F.max("depth").alias("depth"))
    by_session = reach.groupBy("depth").agg(F.lit(0).cast("bigint").alias("calls"), F.lit(None).cast("decimal(38,0)").alias("nano"), F.count(F.lit(1)).alias("sessions"))
    passed = by_calls.withColumn("nano", F.col("nano").cast("decimal(38,0)")).unionByName(by_session).select(
        F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("place"), "calls", "nano", "sessions")
    every = calls.sparkSession.createDataFrame(
        [(i, s, emits_refs or s not in ("workRef", "pullRequest")) for i, s in enumerate(STAGES)], "place INT, stage STRING, emitted BOOLEAN")
    summed = passed.groupBy("place").agg(F.sum("sessions").alias("sessions"), F.sum("calls").alias("calls"), F.sum("nano").alias("nano"))
    return every.join(summed, "place", "left").select(
        "stage", "emitted", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("calls", F.lit(0)).alias("calls"),
        F.coalesce(_credits(F.col("nano")), F.lit(0.0)).alias("credits"))


def coverage_metrics(calls: DataFrame, emits_refs: bool, has_actor: bool) -> DataFrame:
    """One row of shares; NULL where the source cannot tell or nothing was credited."""
    nano = F.col("nano").cast("decimal(20,0)")

    def share(cond: Column, possible: bool = True) -> Column:
        part = F.coalesce(F.sum(F.when(F.coalesce(cond, F.lit(False)), nano)), F.lit(0)).cast("double")
        return F.when(F.lit(possible), F.try_divide(part, F.sum(nano).cast("double")))

    pair = F.col("cached") <= F.col("input")
    to_pr = F.col("linked") & F.col("repository").isNotNull() & F.col("branch").isNotNull() & F.col("has_work_ref") & F.col("has_pr")
    return calls.agg(
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credited_calls"), credit_sum(F.col("nano")).alias("credits"),
        F.try_divide(F.count("nano"), F.count(F.lit(1))).alias("credit_coverage"),
        share(F.col("repository").isNotNull()).alias("credits_to_repo_share"), share(to_pr, emits_refs).alias("credits_to_pr_share"),
        share(F.col("user").isNotNull(), has_actor).alias("credits_to_actor_share"), share(F.col("sub_agent")).alias("sub_agent_share"),
        F.try_divide(F.sum(F.when(pair, F.col("cached"))), F.sum(F.when(pair, F.col("input")))).alias("cache_read_ratio"),
        F.count(F.when(pair, F.lit(1))).alias("cache_pairs"),
    )


def coverage_breakdowns(calls: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, key, calls, credits) per breakdown in one pass; a missing key is '(none)'."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(c), F.lit(NO_KEY)).alias("key")) for kind, c in kinds.items()]))
    return calls.select(pairs.alias("p"), "nano").groupBy("p.kind", "p.key").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(credit_sum(F.col("nano")), F.lit(0.0)).alias("credits"))


def daily_usage(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("day").isNotNull()).groupBy("day").agg(
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credited_calls"), credit_sum(F.col("nano")).alias("credits"))


def iso_instant(ms: Column) -> Column:
    """ISO text with milliseconds, independent of the session time zone."""
    left = ms - F.floor(ms / DAY_MS) * DAY_MS
    parts = [F.floor(left / 3_600_000), F.floor(left % 3_600_000 / 60_000), F.floor(left % 60_000 / 1000), left % 1000]
    return F.concat(utc_day(ms), F.format_string("T%02d:%02d:%02d.%03dZ", *[p.cast("bigint") for p in parts]))


def source_freshness(calls: DataFrame) -> DataFrame:
    return calls.agg(iso_instant(F.min("at_ms")).alias("first"), iso_instant(F.max("at_ms")).alias("last"))


def trace_calls(attributed: DataFrame) -> DataFrame:
    """Calls of a trace store in coverage form. Only chat links make sessions; traces merely link."""
    chat = F.col("native_session_id")
    key = F.coalesce(chat, F.col("parent_session_id"))
    link = F.when(chat.isNotNull(), "chat session").when(F.col("parent_session_id").isNotNull(), "parent session").otherwise("none")
    return attributed.select(
        key.alias("session_key"), F.coalesce(key, F.col("conversation_id"), F.col("trace_id")).isNotNull().alias("linked"), "nano", "input", "cached",
        F.col("work_repository").alias("repository"), F.col("work_branch").alias("branch"), F.lit(None).cast("boolean").alias("has_work_ref"),
        F.lit(None).cast("boolean").alias("has_pr"), F.col("user_by").alias("user"),
        (chat.isNull() & F.col("parent_session_id").isNotNull()).alias("sub_agent"), "effort", link.alias("link"),
        F.col("start_ms").alias("at_ms"), utc_day(F.col("start_ms")).alias("day"))


def store_calls(usage: DataFrame) -> DataFrame:
    """Events of the CLI store in coverage form; it knows no user."""
    return usage.select(
        F.col("session_id").alias("session_key"), F.col("session_id").isNotNull().alias("linked"), "nano", "input", "cached", "repository", "branch",
        "has_work_ref", "has_pr", F.lit(None).cast("string").alias("user"), (F.col("initiator") == "sub-agent").alias("sub_agent"),
        F.col("reasoning_effort").alias("effort"), F.lit(None).cast("string").alias("link"), "at_ms", "day")


def concept_intersection(cells: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(concept, level) of concepts available on every surface: native if all are, else partial.

    cells: concept, surface, availability. surfaces: surface. No surface, no concept.
    """
    wanted = surfaces.select("surface").distinct()
    needed = wanted.agg(F.count(F.lit(1)).alias("n")).scalar()
    usable = cells.where(F.col("availability").isin("native", "partial", "derived")).join(wanted, "surface", "left_semi")
    return usable.groupBy("concept").agg(
        F.count_distinct("surface").alias("held"), F.bool_and(F.col("availability") == "native").alias("native")
    ).where(F.col("held") == needed).select("concept", F.when(F.col("native"), "native").otherwise("partial").alias("level"))


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("source", F.lit(s)) for s, f in frames.items()])
