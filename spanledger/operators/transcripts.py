"""Chat transcripts: request usage after replaying the mutation log, session cost, history index.

The log is folded without visiting it row by row. A request slot survives iff
no later truncation starts at or before it, and the list length before each
operation is a running max-plus sum, so both are prefix scans. An operation is
rejected when its index exceeds that length. Lengths computed while rejected
operations are still counted can only be too long, so whatever exceeds them is
surely rejected; dropping those and repeating reaches the exact answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import nonnegative
from ..session import cut
from .scan import HOT_ROWS, Prefix, SlicedScan

FIELDS = ["model", "credits", "session_credits"]


def _length_scan(ops: DataFrame, hot_rows: int) -> DataFrame:
    """Add `len_before`, assuming every operation present is accepted."""
    scan = SlicedScan(ops, ["session_id"], ["seq"], hot_rows)
    pushed = F.when(F.col("op") == "push", F.col("n")).otherwise(0).cast("bigint")
    fixed = F.col("op").isin("reset", "splice")
    epochs = scan.run(scan.rows, {
        "epoch": Prefix("sum", fixed.cast("bigint")), "pushes": Prefix("sum", pushed),
    }).withColumn(
        # Length right after the operation, less the pushes so far: what later operations build on.
        "floor_len",
        F.when(F.col("op") == "reset", F.col("n")).when(F.col("op") == "splice", F.col("idx") + F.col("n"))
        .when(F.col("op") == "set", F.col("idx") + 1) - F.col("pushes"),
    )
    inner = SlicedScan(epochs.drop("_slice"), ["session_id", "epoch"], ["seq"], hot_rows)
    reach = inner.run(inner.rows, {"reach": Prefix("max", F.col("floor_len"))}).drop("_slice")
    # State just before a row is the state just after the row before it.
    after = F.greatest(F.coalesce("reach", F.when(F.col("epoch") == 0, F.lit(0))), F.when(F.col("epoch") == 0, F.lit(0))) + F.col("pushes")
    outer = SlicedScan(reach.withColumn("len_after", after), ["session_id"], ["seq"], hot_rows)
    return outer.run(outer.rows, {"len_before": Prefix("last", F.col("len_after"), inclusive=False)}).withColumn(
        "len_before", F.coalesce("len_before", F.lit(0))
    ).drop("_slice", "epoch", "pushes", "floor_len", "reach", "len_after")


def accepted_ops(ops: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Operations that apply. Each round drops all that surely do not, until none is left."""
    indexed = F.col("op").isin("splice", "set", "check")
    current = cut(ops.where(~indexed | F.coalesce(F.col("idx") >= 0, F.lit(False))))
    while True:
        sized = _length_scan(current, hot_rows)
        judged = cut(sized.withColumn("fits", ~indexed | (F.col("idx") <= F.col("len_before"))))
        kept = judged.where("fits").drop("fits", "len_before")
        if judged.where(~F.col("fits")).isEmpty():
            return kept
        current = kept


def replay(ops: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Surviving requests: (session_id, idx, model, credits, session_credits).

    ops: session_id, seq, op in reset / push / splice / set / check, idx, n and
    `slots` ARRAY<STRUCT<off, whole, model, credits, session_credits, field>>,
    the request values the operation writes. `reset` sets the whole list, and
    `check` only validates its index.
    """
    kept = _length_scan(accepted_ops(ops, hot_rows), hot_rows)
    base = F.when(F.col("op").isin("splice", "set"), F.col("idx")).when(F.col("op") == "push", F.col("len_before")).otherwise(0)
    cuts_at = F.when(F.col("op") == "reset", F.lit(0)).when(F.col("op") == "splice", F.col("idx"))
    scan = SlicedScan(kept, ["session_id"], ["seq"], hot_rows, reverse=True)
    later = scan.run(scan.rows, {"later_cut": Prefix("min", cuts_at, inclusive=False)})
    written = later.select("session_id", "seq", "later_cut", base.alias("base"), F.explode("slots").alias("s")).select(
        "session_id", "seq", (F.col("base") + F.col("s.off")).alias("idx"), "later_cut", "s.*"
    ).where(F.col("later_cut").isNull() | (F.col("later_cut") > F.col("idx")))

    def newest(field: str) -> Column:
        touches = F.when(F.col("whole") | (F.col("field") == field), F.col("seq"))
        return F.max_by(field, touches).alias(field)

    return written.groupBy("session_id", "idx").agg(*[newest(f) for f in FIELDS])


def session_fields(headers: DataFrame) -> DataFrame:
    """Latest title per log: (session_id, title). A snapshot replaces it, a set or delete changes it."""
    return headers.where("touches_title").groupBy("session_id").agg(F.max_by("title", "seq").alias("title"))


def session_cost(requests: DataFrame) -> DataFrame:
    """max(sum of turn credits, largest session total); NULL if neither was reported."""
    turn, whole = nonnegative(F.col("credits")), nonnegative(F.col("session_credits"))
    return requests.groupBy("session_id").agg(
        F.greatest(F.sum(turn), F.max(whole)).alias("credits"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("idx"))).alias("model"),
    )


def index_transcript_merge(index: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Newest transcript file per session; the index's title and activity override it.

    index: session_id, title, updated_ms, ord; its later row wins equal times.
    transcripts: session_id, title, updated_ms, credits, model, ord.
    """
    i = index.groupBy("session_id").agg(F.max_by(F.struct("title", "updated_ms"), F.struct("updated_ms", "ord")).alias("i"))
    t = transcripts.groupBy("session_id").agg(
        F.max_by(F.struct("title", "updated_ms", "credits", "model"), F.struct("updated_ms", -F.col("ord"))).alias("t")
    )
    return i.join(t, "session_id", "full_outer").select(
        "session_id", F.coalesce("i.title", "t.title").alias("title"), F.coalesce("i.updated_ms", "t.updated_ms").alias("updated_ms"),
        F.col("t.credits").alias("credits"), F.col("t.model").alias("model"),
    )


def transcript_growth(previous: DataFrame, sessions: DataFrame, observed: DataFrame) -> DataFrame:
    """Credits growth per session against the highest seen; first sight is a baseline.

    previous: session_id, credits. observed: session ids backed by a transcript;
    one without credits is remembered at 0, so its first report counts in full.
    """
    p = previous.select("session_id", F.col("credits").alias("p"))
    o = observed.select("session_id").distinct().withColumn("here", F.lit(True))
    joined = p.join(sessions.select("session_id", "credits"), "session_id", "full_outer").join(o, "session_id", "left")
    seen, now = F.col("p"), F.col("credits")
    growth = F.when(seen.isNotNull() & now.isNotNull(), F.greatest(F.lit(0.0), now - seen)).otherwise(F.lit(0.0))
    state = F.when(now.isNotNull(), F.greatest(seen, now)).when(F.coalesce("here", F.lit(False)), F.coalesce(seen, F.lit(0.0))).otherwise(seen)
    return joined.select("session_id", state.alias("credits"), growth.alias("growth")).where(F.col("credits").isNotNull())
