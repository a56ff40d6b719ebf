"""Root classification of runtime invocations by walking parent links.

Pointer doubling: every span carries a summary of the ancestors walked so far
and a pointer to the next one, so each join round doubles the distance. Rounds carry
the rows that are still open. A round that settles nothing proves that what is left runs in a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.values import credit_sum
from ..session import cut


def classify_roots(spans: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(span_id, root) with root in root / nested / unknown, for runtime agent spans.

    `ancestors` are parent links without an operation; a span wins over an
    ancestor of the same id. Ids are unique within each input.
    """
    links = ["span_id", "trace_id", "parent_span_id", "parent_known", "operation"]
    nodes = spans.select(*links, ((F.col("operation") == "invoke_agent") & F.col("sdk")).alias("wanted"))
    if ancestors is not None:
        extra = ancestors.select(*links[:-1], F.lit("").alias("operation"), F.lit(False).alias("wanted"))
        nodes = nodes.unionByName(extra.join(spans.select("span_id"), "span_id", "left_anti"))
    # hop: what one step from a node to its parent adds. bad = unknown, whatever follows.
    start = nodes.select(
        "span_id", "trace_id", "wanted",
        F.when(F.col("parent_known"), F.col("parent_span_id")).alias("up"),
        (~F.col("parent_known")).alias("bad"),
        (F.col("operation") == "invoke_agent").alias("self_agent"),
        F.lit(False).alias("nested"),
        F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"),
    )
    # The parent's own operation and trace enter with the first hop.
    own = start.select(
        F.col("span_id").alias("p_id"), F.col("up").alias("p_up"), F.col("bad").alias("p_bad"),
        F.col("self_agent").alias("p_agent"), F.col("trace_id").alias("p_trace"),
    )
    state = start.join(own, F.col("up") == F.col("p_id"), "left").select(
        "span_id", "trace_id", "wanted", "self_agent", F.col("p_up").alias("next"),
        (F.col("bad") | (F.col("up").isNotNull() & F.col("p_id").isNull()) | F.coalesce("p_bad", F.lit(False))).alias("bad"),
        F.coalesce("p_agent", F.lit(False)).alias("nested"),
        F.col("p_trace").alias("lo"), F.col("p_trace").alias("hi"),
    )
    walking = F.col("next").isNotNull() & ~F.col("bad")
    state = cut(state)
    # what is settled is kept as it was written; a round writes open rows only
    settled, left = [state.where(~walking)], state.where(walking)
    open_before = None
    while True:
        still_open = left.count()
        if still_open == 0 or still_open == open_before:
            break
        open_before = still_open
        jump = reduce(DataFrame.unionByName, settled, left).select(
            F.col("span_id").alias("j_id"), F.col("next").alias("j_next"), F.col("bad").alias("j_bad"),
            F.col("nested").alias("j_nested"), F.col("lo").alias("j_lo"), F.col("hi").alias("j_hi"),
            F.col("trace_id").alias("j_trace"), F.col("self_agent").alias("j_agent"),
        )
        # `next` itself is an ancestor too, but its summary starts after it.
        moved = left.join(jump, F.col("next") == F.col("j_id"), "left").select(
            "span_id", "trace_id", "wanted", "self_agent", F.col("j_next").alias("next"),
            (F.col("j_id").isNull() | F.coalesce("j_bad", F.lit(False))).alias("bad"),
            (F.col("nested") | F.coalesce("j_nested", F.lit(False)) | F.coalesce("j_agent", F.lit(False))).alias("nested"),
            F.least("lo", "j_lo", "j_trace").alias("lo"), F.greatest("hi", "j_hi", "j_trace").alias("hi"),
        )
        moved = cut(moved)
        settled.append(moved.where(~walking))
        left = moved.where(walking)
    foreign = F.col("trace_id").isNotNull() & ((F.col("lo") != F.col("trace_id")) | (F.col("hi") != F.col("trace_id")))
    unknown = F.col("bad") | F.col("next").isNotNull() | F.coalesce(foreign, F.lit(False))
    return reduce(DataFrame.unionByName, settled, left).where("wanted").select(
        "span_id", F.when(unknown, "unknown").when(F.col("nested"), "nested").otherwise("root").alias("root")
    )


def sdk_root_credits(spans: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """Confirmed root invocations and their native credits; never added to model-call credits."""
    roots = classify_roots(spans, ancestors)
    sdk = spans.where(F.col("sdk")).join(roots, "span_id", "left")
    is_root = F.col("root") == "root"
    return sdk.agg(
        F.count_if(F.col("operation") == "chat").alias("model_calls"),
        F.count_if(is_root).alias("invocations"),
        F.count(F.when(is_root, F.col("sdk_nano"))).alias("reported_invocations"),
        F.coalesce(credit_sum(F.when(is_root, F.col("sdk_nano"))), F.lit(0.0)).alias("credits"),
        F.count_if(F.col("root") == "unknown").alias("unclassified"),
    )
