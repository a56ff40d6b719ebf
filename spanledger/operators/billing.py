"""Reconciling local usage with billed quantities, and a bounded estimated share per work cycle.

Usage: `actors.usage_by_day`. Lines: `sources.billing.billing_parse` rows with
status ok. Grain: paying report, user, UTC day, lower-case model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .actors import github_actor

GRAIN = ["report_id", "actor", "day"]


def billed_models(lines: DataFrame) -> DataFrame:
    """(report_id, actor, day, model, gross, net) per model; reports with an error are absent."""
    return lines.where((F.col("status") == "ok") & F.col("model").isNotNull()).groupBy(
        "report_id", github_actor(F.col("user")).alias("actor"), "day", F.lower("model").alias("model")
    ).agg(F.sum("gross_quantity").cast("double").alias("gross"), F.sum("net_amount").cast("double").alias("net"))


def reports(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("status") == "ok").select("report_id", github_actor(F.col("user")).alias("actor"), "day").distinct()


def model_match(lines: DataFrame, usage: DataFrame, source: str) -> DataFrame:
    """billing_match: billed models with what the source observed; NULL where it reported nothing."""
    seen = usage.where((F.col("source") == source) & F.col("actor").isNotNull()).groupBy("actor", "day", "model").agg(
        F.sum("credits").alias("observed"), F.sum("calls").alias("calls"))
    return billed_models(lines).join(seen, ["actor", "day", "model"], "left").select(*GRAIN, "model", "gross", "net", "observed", "calls")


def billing_reconcile(lines: DataFrame, usage: DataFrame, source: str) -> DataFrame:
    """One row per report. Gaps of one model never hide those of another."""
    models = model_match(lines, usage, source)
    compared = models.groupBy("report_id").agg(
        F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.sum("observed").alias("observed"),
        F.sum(F.greatest(F.lit(0.0), F.col("gross") - F.coalesce("observed", F.lit(0.0)))).alias("unmatched_billing"),
        F.bool_or(F.coalesce(F.col("observed") > F.col("gross"), F.lit(False))).alias("local_exceeds_billing"))
    scope = reports(lines)
    local = usage.where(F.col("source") == source)
    outside = (
        local.where(F.col("actor").isNotNull()).groupBy("actor", "day", "model").agg(F.sum("credits").alias("c")).join(scope, ["actor", "day"])
        .join(billed_models(lines).select("report_id", "model"), ["report_id", "model"], "left_anti")
        .groupBy("report_id").agg(F.sum("c").alias("outside_model_scope")))
    unknown = local.where(F.col("actor").isNull()).groupBy("day").agg(F.sum("credits").alias("unknown_identity"))
    return scope.join(compared, "report_id", "left").join(outside, "report_id", "left").join(unknown, "day", "left").select(
        *GRAIN, "gross", "observed", (F.col("gross") - F.col("observed")).alias("difference"),
        F.coalesce("unmatched_billing", F.lit(0.0)).alias("unmatched_billing"), F.coalesce("outside_model_scope", F.lit(0.0)).alias("outside_model_scope"),
        F.coalesce("unknown_identity", F.lit(0.0)).alias("unknown_identity"), F.coalesce("local_exceeds_billing", F.lit(False)).alias("local_exceeds_billing"))


def billing_allocate(lines: DataFrame, usage: DataFrame, source: str) -> DataFrame:
    """(report, cycle_key, gross_quantity, net_amount, method): estimated shares of billed models not exceeded locally."""
    within = model_match(lines, usage, source).where((F.col("observed") <= F.col("gross")) & (F.col("gross") > 0))
    work = usage.where((F.col("source") == source) & F.col("cycle_key").isNotNull() & (F.col("credits") > 0)).select(
        "actor", "day", "model", "cycle_key", "credits")
    return within.join(work, ["actor", "day", "model"]).groupBy(*GRAIN, "cycle_key").agg(
        F.sum("credits").alias("gross_quantity"), F.sum(F.col("net") * F.col("credits") / F.col("gross")).alias("net_amount"),
        F.lit("estimated-share").alias("method"))


def unallocated_net(lines: DataFrame, usage: DataFrame, source: str) -> DataFrame:
    """(report, net, allocated, unallocated): what no work cycle can claim stays visible."""
    total = billed_models(lines).groupBy(*GRAIN).agg(F.sum("net").alias("net"))
    given = billing_allocate(lines, usage, source).groupBy("report_id").agg(F.sum("net_amount").alias("allocated"))
    return total.join(given, "report_id", "left").select(
        *GRAIN, "net", F.coalesce("allocated", F.lit(0.0)).alias("allocated"), (F.col("net") - F.coalesce("allocated", F.lit(0.0))).alias("unallocated"))
