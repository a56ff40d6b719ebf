"""Call tallies by one key. NULL is a real group; unreported credits are unknown, not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import NANO, credit_sum

ROWS_SHOWN = 5


def chat(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("operation") == "chat")


def tally(calls: DataFrame, key: Column) -> DataFrame:
    """(key, calls, credit_calls, nano, credits); nano is exact, credits its double."""
    return (
        calls.groupBy(key.alias("key"))
        .agg(F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credit_calls"),
             F.coalesce(F.sum(F.col("nano").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("nano"))
        .withColumn("credits", F.col("nano").cast("double") / F.lit(float(NANO)))
    )


def credits_by(calls: DataFrame, key: str) -> DataFrame:
    return tally(chat(calls), F.col(key)).drop("nano")


def topk_by(rows: DataFrame, groups: list[str], k: int = ROWS_SHOWN) -> DataFrame:
    """Per group, the top `k` rows by credits then calls, the rest folded into one "N more" row.

    rows: groups..., key, unknown, calls, credit_calls, nano. With at most k + 1
    rows nothing is folded. The rank filter is applied before the shuffle, and
    the remainder is the group total minus the top, so no key set is ordered whole.
    """
    measures = ["calls", "credit_calls", "nano"]
    best = Window.partitionBy(*groups).orderBy(F.desc("nano"), F.desc("calls"), F.asc_nulls_last("key"))
    top = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    totals = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t_{c}") for c in measures])
    few = Window.partitionBy(*groups)

    def beyond(c: str) -> Column:
        return F.col(f"t_{c}") - F.sum(F.when(F.col("place") <= k, F.col(c)).otherwise(0)).over(few)

    marked = top.join(totals, groups).select("*", *[beyond(c).alias(f"r_{c}") for c in measures])
    folds = F.col("n") > k + 1
    nano_type = "decimal(38,0)"
    own = F.struct(F.coalesce("key", "unknown").alias("label"), "calls", "credit_calls", F.col("nano").cast(nano_type).alias("nano"))
    rest = F.struct(
        F.concat((F.col("n") - k).cast("string"), F.lit(" more")).alias("label"), F.col("r_calls").alias("calls"),
        F.col("r_credit_calls").alias("credit_calls"), F.col("r_nano").cast(nano_type).alias("nano"))
    shown = F.array_compact(F.array(F.when(~folds | (F.col("place") <= k), own), F.when(folds & (F.col("place") == 1), rest)))
    return marked.select(*groups, F.explode(shown).alias("r")).select(
        *groups, "r.label", "r.calls", "r.credit_calls", (F.col("r.nano").cast("double") / F.lit(float(NANO))).alias("credits"))


def topk_with_remainder(rows: DataFrame, unknown: str, k: int = ROWS_SHOWN) -> DataFrame:
    """`topk_by` over one tally."""
    return topk_by(rows.select(F.lit(0).alias("all"), "*", F.lit(unknown).alias("unknown")), ["all"], k).drop("all")


def chat_totals(spans: DataFrame) -> DataFrame:
    """Token subtotals (zero where nothing is reported, as numeric ledgers) and credits of model calls."""
    def zero(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)

    return chat(spans).agg(
        zero("input"), zero("output"), zero("cached"), zero("reasoning"), zero("cache_write"),
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credit_calls"),
        F.coalesce(credit_sum(F.col("nano")), F.lit(0.0)).alias("credits"),
    )


def sessionless_credits(spans: DataFrame) -> DataFrame:
    return chat(spans).where(F.col("session_id").isNull()).agg(
        F.count(F.lit(1)).alias("calls"), F.count("nano").alias("credit_calls"),
        F.coalesce(credit_sum(F.col("nano")), F.lit(0.0)).alias("credits"),
    )


TOKEN_FIELDS = ["input", "output", "cached", "cache_write", "reasoning"]


def token_coverage(calls: DataFrame) -> DataFrame:
    """Per token field: reported subtotal (NULL if none), reporting calls and their share."""
    one = calls.agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(f).alias(f"sum_{f}") for f in TOKEN_FIELDS], *[F.count(f).alias(f"n_{f}") for f in TOKEN_FIELDS],
    )
    fields = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"sum_{f}").alias("tokens"), F.col(f"n_{f}").alias("reported_calls"))
        for f in TOKEN_FIELDS
    ]))
    return one.select("calls", fields.alias("f")).select(
        "f.field", "f.tokens", "f.reported_calls", F.try_divide("f.reported_calls", "calls").alias("share")
    )


def cache_read_ratio(calls: DataFrame) -> DataFrame:
    """Cache-read share over calls reporting both counts with cache <= input."""
    pair = F.col("cached") <= F.col("input")
    return calls.agg(
        F.try_divide(F.sum(F.when(pair, F.col("cached"))), F.sum(F.when(pair, F.col("input")))).alias("ratio"),
        F.count(F.when(pair, F.lit(1))).alias("reported_calls"),
        F.try_divide(F.count(F.when(pair, F.lit(1))), F.count(F.lit(1))).alias("share"),
    )


def configured_user_calls(attributed: DataFrame) -> DataFrame:
    return attributed.agg(
        F.count_if(F.col("user_by").isNotNull() & (F.col("user_by_source") == "resource")).alias("configured_user_calls"),
        F.count("user_by").alias("user_calls"),
    )
