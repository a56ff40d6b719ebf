"""Account quota responses as landed JSON. A response that cannot be used is an error row, never a zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json as j
from ..functions.parsing import date_only, timestamp_ms
from ..functions.values import DAY_MS, nonnegative
from .once import computed_once

MAX_DATE_MS = 8_640_000_000_000_000


def _decimal(v: Column, *names: str) -> Column:
    """A number, or digits given as text."""
    words = F.when(j.kind_of(j.item(v, *names)) == "STRING", F.try_variant_get(v, j.key_path(*names), "string"))
    return F.coalesce(nonnegative(j.number(v, *names)), nonnegative(F.when(words.rlike(r"^\d+(?:\.\d+)?$"), words.try_cast("double"))))


def _boolean(v: Column, *names: str) -> Column:
    return F.when(j.kind_of(j.item(v, *names)) == "BOOLEAN", F.try_variant_get(v, j.key_path(*names), "boolean"))


def quota_parse(responses: DataFrame) -> DataFrame:
    """responses: login, fetched_ms, body. One row each, status ready or error with a reason."""
    parsed = computed_once(responses.select("login", "fetched_ms", "body"), d=F.try_parse_json("body"))
    data = F.col("d")

    def snapshot(name: str) -> Column:
        found = j.item(data, "quota_snapshots", name)
        return F.when(j.kind_of(found).startswith("OBJECT"), found)

    staged = computed_once(
        parsed, premium=F.coalesce(snapshot("premium_interactions"), snapshot("premium_models")), chat=snapshot("chat"))
    premium = F.col("premium")
    use_premium = premium.isNotNull() & (
        F.coalesce(_boolean(premium, "unlimited"), F.lit(False)) | F.coalesce(_decimal(premium, "entitlement") != 0, F.lit(True)))
    d, s = F.col("d"), F.col("s")
    chosen = computed_once(staged, paid=use_premium, s=F.when(use_premium, premium).otherwise(F.col("chat")))
    day = F.coalesce(*[F.try_variant_get(d, f"$.{n}", "string") for n in ("quota_reset_date_utc", "quota_reset_date", "limited_user_reset_date")])
    day_ms = F.unix_date(date_only(day).cast("date")).cast("double") * DAY_MS
    reset = _decimal(s, "quota_reset_at")
    by_clock = F.when(reset > 0, reset * 1000)
    reads = chosen.select(
        "login", "fetched_ms", "paid", _boolean(s, "unlimited").alias("unlimited"), _boolean(s, "has_quota").alias("has_quota"),
        F.when(~_boolean(s, "unlimited"), _decimal(s, "entitlement")).alias("allowance"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(F.abs(j.number(s, "percent_remaining")) < F.lit(float("inf")), j.number(s, "percent_remaining")))).alias("pct"),
        j.number(s, "percent_remaining").isNotNull().alias("has_pct"),
        _decimal(s, "quota_remaining").alias("remaining"), _decimal(s, "credits_used").alias("credits_used"),
        (F.coalesce(_boolean(d, "token_based_billing"), F.lit(False)) | F.coalesce(_boolean(s, "token_based_billing"), F.lit(False))).alias("tokens"),
        F.when(F.length(j.text(d, "copilot_plan")) <= 128, j.text(d, "copilot_plan")).alias("plan"),
        F.coalesce(by_clock, F.coalesce(timestamp_ms(day).cast("double"), day_ms)).alias("reset_ms"),
        (by_clock.isNotNull() | day.isNotNull()).alias("has_reset"),
    ).withColumn("percent_remaining", F.when(F.col("has_pct"), F.col("pct")))
    error = (
        F.when(F.col("unlimited").isNull(), F.lit("no usable quota"))
        .when(~F.col("unlimited") & F.col("percent_remaining").isNull(), F.lit("remaining allowance not reported"))
        .when(F.col("has_reset") & (F.col("reset_ms").isNull() | (F.col("reset_ms") > MAX_DATE_MS)), F.lit("invalid reset date"))
    )
    exact = F.col("allowance") - F.col("remaining")
    estimate = F.col("allowance") * (100 - F.col("percent_remaining")) / 100
    used = F.when((F.col("allowance") > 0) & F.col("percent_remaining").isNotNull(), F.greatest(F.lit(0.0), F.coalesce(exact, estimate)))
    unit = F.when(F.col("tokens"), "credits").when(F.col("paid"), "premium requests").otherwise("chat requests")
    good = error.isNull()
    values = {
        "plan": F.col("plan"), "unit": unit, "unlimited": F.col("unlimited"), "has_quota": F.col("has_quota"), "allowance": F.col("allowance"),
        "used": used, "approximate": used.isNotNull() & F.col("remaining").isNull(), "percent_remaining": F.col("percent_remaining"),
        "credits_used": F.when(F.col("unlimited"), F.col("credits_used")), "reset_ms": F.col("reset_ms").cast("bigint"),
    }
    return reads.select(
        "login", "fetched_ms", F.when(good, F.lit("ready")).otherwise(F.lit("error")).alias("status"), error.alias("reason"),
        *[F.when(good, v).alias(n) for n, v in values.items()],
    )
