"""Billing usage reports: scope checks, line checks, and a quarantine instead of zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json as j
from .once import computed_once

ITEM_NUMBERS = [
    "pricePerUnit", "grossQuantity", "grossAmount", "discountQuantity", "discountAmount", "netQuantity", "netAmount",
]
AMOUNT = "decimal(38,9)"


def billing_scope(scopes: DataFrame, today: str) -> DataFrame:
    """Scopes (level, account, user, day, ...) with `scope_ok`: a known level, plain names, a completed UTC day."""
    name = r"^[A-Za-z0-9](?:[A-Za-z0-9_-]{0,98}[A-Za-z0-9])?$"
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("day").try_cast("date"))
    ok = (
        F.col("level").isin("organization", "enterprise", "user") & F.col("account").rlike(name) & F.col("user").rlike(name)
        & (day < F.lit(today).cast("date")) & ((F.col("level") != "user") | (F.lower("account") == F.lower("user")))
    )
    return scopes.withColumn("scope_ok", F.coalesce(ok, F.lit(False)))


def billing_parse(reports: DataFrame, product: str = "Copilot") -> DataFrame:
    """reports: report_id, level, account, user, day, body. One row per line, plus one per report without lines.

    A report whose scope disagrees or with any unusable line is an error as a
    whole: status `error`, no amounts. An explicit empty list is valid.
    """
    echoed = {"organization": "organization", "enterprise": "enterprise", "user": "user"}
    r = computed_once(reports, b=F.try_parse_json("body"))
    b = F.col("b")
    items = F.try_variant_get(b, "$.usageItems", "array<variant>")

    def agrees(name: str, want: Column) -> Column:
        said = j.text(b, name)
        return said.isNull() | (F.lower(said) == F.lower(want))

    of_level = F.coalesce(*[F.when(F.col("level") == k, agrees(n, F.col("account"))) for k, n in echoed.items()], F.lit(False))
    period = F.format_string(
        "%04d-%02d-%02d", j.number(b, "timePeriod", "year").cast("int"), j.number(b, "timePeriod", "month").cast("int"),
        j.number(b, "timePeriod", "day").cast("int"))
    dated = F.when(j.number(b, "timePeriod", "day").isNotNull() & j.number(b, "timePeriod", "month").isNotNull(), period)
    head_ok = F.coalesce(
        of_level & agrees("user", F.col("user")) & agrees("product", F.lit(product)) & (dated == F.col("day")) & items.isNotNull(), F.lit(False))

    def item_ok(v: Column) -> Column:
        numbers = F.lit(True)
        for n in ITEM_NUMBERS:
            numbers = numbers & F.coalesce(j.number(v, n) >= 0, F.lit(False))
        return (
            numbers & F.coalesce(j.text(v, "unitType") == "AI credits", F.lit(False)) & j.text(v, "model").isNotNull()
            & j.text(v, "sku").isNotNull() & F.coalesce(j.text(v, "product") == product, F.lit(False))
        )

    valid = head_ok & F.coalesce(F.forall(items, item_ok), F.lit(False))
    checked = computed_once(r, ok=valid)
    rows = checked.select("report_id", "level", "account", "user", "day", "ok", F.explode_outer(F.when(F.col("ok"), items)).alias("v"))
    v = F.col("v")
    snake = {"pricePerUnit": "price", "grossQuantity": "gross_quantity", "grossAmount": "gross_amount", "discountQuantity": "discount_quantity",
             "discountAmount": "discount_amount", "netQuantity": "net_quantity", "netAmount": "net_amount"}
    return rows.select(
        "report_id", "level", "account", "user", "day", F.when(F.col("ok"), "ok").otherwise("error").alias("status"),
        j.text(v, "sku").alias("sku"), j.text(v, "model").alias("model"),
        *[F.try_variant_get(v, f"$.{n}", AMOUNT).alias(snake[n]) for n in ITEM_NUMBERS],
    )
