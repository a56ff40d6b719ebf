"""Usage ledgers: metering by high-water marks, transfers between ledgers, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import round_half_up

LEDGERS = ["metrics", "traces", "harness", "manual"]
DRIFT_PERCENT = 2.0


def saneness(value: Column) -> Column:
    """Rounded positive amount; anything else counts nothing."""
    d = value.cast("double")
    return F.when((d > 0) & (d < F.lit(float("inf"))), round_half_up(d)).otherwise(F.lit(0).cast("bigint"))


def manual_reports(reports: DataFrame) -> DataFrame:
    """Explicitly reported usage as one manual ledger row; empty reports are not requests."""
    i, o = saneness(F.col("input")), saneness(F.col("output"))
    used = (i + o) > 0
    return reports.agg(
        F.lit("manual").alias("ledger"), F.coalesce(F.sum(i), F.lit(0)).alias("input"),
        F.coalesce(F.sum(o), F.lit(0)).alias("output"), F.count_if(used).alias("requests"),
    )


def metered_calls(spans: DataFrame, since_ms: int, cutoff_ms: int) -> DataFrame:
    """(span_id, at_ms, input, output): high-water marks of model calls, so replays charge nothing."""
    usable = (
        (F.col("operation") == "chat") & (F.col("start_ms") >= since_ms) & (F.col("start_ms") >= cutoff_ms)
        & F.coalesce("input", "output").isNotNull()
    )
    return spans.where(usable).groupBy("span_id").agg(
        F.max("start_ms").alias("at_ms"), F.coalesce(F.max("input"), F.lit(0)).alias("input"),
        F.coalesce(F.max("output"), F.lit(0)).alias("output"),
    )


def accounting_step(previous: DataFrame, calls: DataFrame, harness_ids: DataFrame, cutoff_ms: int, accepting: bool = True) -> DataFrame:
    """One scan of span metering as a join of the charged state with the current calls.

    previous: span_id, at_ms, input, output, harness. calls: `metered_calls`.
    Result per span: the new state plus what this scan charges (ledger, d_*) and
    moves out of the harness ledger (m_*). While the meter rejects usage a charge
    leaves no harness mark and a pending move is kept for the next scan.
    """
    # Unlike unsent charges, high-water marks advance even while the meter rejects.
    p = previous.where(F.col("at_ms") >= cutoff_ms).select("span_id", *[F.col(c).alias(f"p_{c}") for c in ("at_ms", "input", "output", "harness")])
    only = harness_ids.select("span_id", F.lit(True).alias("only_host"))
    joined = p.join(calls, "span_id", "full_outer").join(only, "span_id", "left")
    seen, now = F.col("p_input").isNotNull(), F.col("input").isNotNull()
    was, host = F.coalesce("p_harness", F.lit(False)), F.coalesce("only_host", F.lit(False))
    moving = now & was & ~host
    to_harness = now & host & (~seen | was)
    top = {c: F.greatest(F.coalesce(f"p_{c}", F.lit(0)), F.coalesce(c, F.lit(0))) for c in ("input", "output")}
    ok = F.lit(accepting)
    keeps_move = moving & ~ok
    state = {c: F.when(keeps_move, F.col(f"p_{c}")).otherwise(top[c]).alias(c) for c in ("input", "output")}
    mark = F.when(~now, was).when(moving, ~ok).when(to_harness & ~seen, ok).otherwise(was)
    return joined.select(
        "span_id", F.coalesce("at_ms", "p_at_ms").alias("at_ms"), state["input"], state["output"], mark.alias("harness"),
        F.when(to_harness, F.lit("harness")).when(now, F.lit("traces")).alias("ledger"),
        *[F.when(now & ok, top[c] - F.coalesce(f"p_{c}", F.lit(0))).otherwise(0).alias(f"d_{c}") for c in ("input", "output")],
        (now & ~seen & ok).cast("bigint").alias("d_requests"),
        *[F.when(moving & ok, F.col(f"p_{c}")).otherwise(0).alias(f"m_{c}") for c in ("input", "output")],
        (moving & ok).cast("bigint").alias("m_requests"),
    )


def ledger_growth(step: DataFrame) -> DataFrame:
    """(ledger, input, output, requests) deltas of a step; a move leaves harness and enters traces."""
    fields = ("input", "output", "requests")
    charged = step.where(F.col("ledger").isNotNull()).select("ledger", *[F.col(f"d_{c}").alias(c) for c in fields])
    moved = step.where(F.col("m_requests") > 0).select(
        F.explode(F.array(
            F.struct(F.lit("traces").alias("ledger"), *[F.col(f"m_{c}").alias(c) for c in fields]),
            F.struct(F.lit("harness").alias("ledger"), *[(-F.col(f"m_{c}")).alias(c) for c in fields]),
        )).alias("m")).select("m.*")
    return charged.unionByName(moved).groupBy("ledger").agg(*[F.sum(c).cast("bigint").alias(c) for c in fields])


def metric_baseline(baseline: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Charge growth beyond what was already there at first sight; the baseline never goes down.

    A feed without a baseline row is new: all it holds is history.
    """
    b = baseline.select(*keys, F.col("input").alias("b_input"), F.col("output").alias("b_output"))
    joined = totals.join(b, keys, "left")

    def charge(c: str) -> Column:
        return F.greatest(F.lit(0), F.col(c) - F.coalesce(f"b_{c}", F.col(c))).alias(f"charged_{c}")

    return joined.select(
        *keys, charge("input"), charge("output"),
        *[F.greatest(F.col(c), F.col(f"b_{c}")).alias(c) for c in ("input", "output")],
    )


def meter_totals(ledgers: DataFrame, keys: list[str] | None = None, count_input: bool = True, count_output: bool = True) -> DataFrame:
    """Reconciled usage: max(metrics, traces) per dimension, plus harness and manual."""
    keys = keys or []

    def of(ledger: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ledger") == ledger, F.col(c))), F.lit(0)).cast("bigint")

    def side(c: str) -> Column:
        return F.greatest(of("metrics", c), of("traces", c)) + of("harness", c) + of("manual", c)

    spans = of("traces", "input") + of("traces", "output")
    metrics = of("metrics", "input") + of("metrics", "output")
    harness = of("harness", "input") + of("harness", "output")
    return ledgers.groupBy(*keys).agg(
        side("input").alias("input"), side("output").alias("output"),
        ((side("input") if count_input else F.lit(0)) + (side("output") if count_output else F.lit(0))).alias("total"),
        (of("traces", "requests") + of("harness", "requests") + of("manual", "requests")).alias("requests"),
        F.when(spans + metrics + harness > 0, F.lit("otel")).otherwise(F.lit("none")).alias("source"),
        (of("manual", "input") + of("manual", "output")).alias("manual_tokens"),
        metrics.alias("metric_tokens"), spans.alias("span_tokens"),
    )


def drift(totals: DataFrame, metrics: str = "metric_tokens", spans: str = "span_tokens") -> DataFrame:
    """How far the two overlapping sources disagree; pending until both have reported."""
    m, s = F.col(metrics), F.col(spans)
    pending = (m == 0) | (s == 0)
    percent = (m - s) / F.when(F.greatest(m, s) == 0, F.lit(1)).otherwise(F.greatest(m, s)) * 100
    return totals.select(
        "*", (m - s).alias("delta_tokens"), percent.alias("delta_percent"), pending.alias("pending"),
        (pending | (F.abs(percent) <= DRIFT_PERCENT)).alias("agreeing"),
    )
